"""Data-quality checks: a count, what it is of, thresholds and example rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Check:
    """found: the faulty rows, or for duplicates, groups with ``excess``; of: the rows they are among."""

    name: str
    found: Callable[[Tables], DataFrame]
    of: str
    warn: float = 0.0
    fail: float = 0.1


def excess(rows: DataFrame, *keys: Column) -> DataFrame:
    """Groups of equal keys with more than one row, and by how many rows they exceed one. NULL keys don't count."""
    named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    known = rows.select(*named).dropna()
    return known.groupBy(*known.columns).agg((F.count("*") - 1).alias("excess")).where("excess > 0")


def run(checks: list[Check], tables: Tables) -> DataFrame:
    """``(check_name, n, total, share, status)`` of all checks, as one plan.

    status: ok up to ``warn``, warning up to ``fail``, else error; an empty denominator is ok.
    """
    out = None
    for c in checks:
        found = c.found(tables)
        n = F.coalesce(F.sum("excess"), F.lit(0)) if "excess" in found.columns else F.count("*")
        counted = found.agg(n.cast("bigint").alias("n")).withColumn("check_name", F.lit(c.name)).withColumn("of", F.lit(c.of)).withColumn("warn", F.lit(c.warn)).withColumn("fail", F.lit(c.fail))
        out = counted if out is None else out.unionByName(counted)
    totals = None
    for name in sorted({c.of for c in checks}):
        t = tables[name].agg(F.count("*").alias("total")).withColumn("of", F.lit(name))
        totals = t if totals is None else totals.unionByName(t)
    joined = out.join(F.broadcast(totals), "of")  # a row for each table
    share = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("n") / F.col("total"))
    status = F.when(F.col("n") == 0, "ok").when(share <= F.col("warn"), "ok").when(share <= F.col("fail"), "warning").otherwise("error")
    return joined.select("check_name", "n", "total", F.round(share, 6).alias("share"), status.alias("status"))


def examples(check: Check, tables: Tables, order: list[str], limit: int) -> DataFrame:
    """The first rows behind a check; the limit is kept within 1 and 5000."""
    return check.found(tables).orderBy(*order).limit(max(1, min(5000, limit)))


def field_statistics(df: DataFrame) -> DataFrame:
    """``(field, nulls, rows, null_share)`` of every column, in one pass."""
    counts = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"n_{k}") for k, c in enumerate(df.columns)])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"n_{k}").alias("nulls")) for k, c in enumerate(df.columns)]))
    return counts.select("rows", pairs.alias("p")).select("p.field", "p.nulls", "rows", F.round(F.when(F.col("rows") > 0, F.col("p.nulls") / F.col("rows")).otherwise(0.0), 6).alias("null_share"))


def count_checks(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``(check_name, n, total)`` of checks that look at one row each, in one scan; NULL counts as no fault."""
    counts = rows.agg(F.count("*").alias("total"), *[F.count_if(p).alias(f"n_{k}") for k, p in enumerate(checks.values())])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(f"n_{k}").alias("n")) for k, c in enumerate(checks)]))
    return counts.select("total", pairs.alias("p")).select("p.check_name", "p.n", "total")


def run_isolated(checks: list[Check], tables: Tables) -> DataFrame:
    """As ``run``; a check that can't be planned (a table or column is not there) has status ``failed`` and no counts, and the others run."""
    good, bad = [], []
    for c in checks:
        try:
            c.found(tables).schema  # noqa: B018  analysis alone
            good.append(c)
        except Exception:
            bad.append(c)
    names = next(iter(tables.values())).sparkSession.createDataFrame([(c.name,) for c in bad], "check_name string")
    failed = names.select("check_name", F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("total"), F.lit(None).cast("double").alias("share"), F.lit("failed").alias("status"))
    return run(good, tables).union(failed) if good else failed


def worst_first(results: DataFrame) -> DataFrame:
    """Results in the order of a report: failed, error, warning, ok; then the larger share, then the name."""
    rank = F.when(F.col("status") == "failed", 0).when(F.col("status") == "error", 1).when(F.col("status") == "warning", 2).otherwise(3)
    return results.orderBy(rank, F.col("share").desc_nulls_first(), "check_name")
