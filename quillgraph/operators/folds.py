"""Folding the records of one entity: ranks, first known values, ordered unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank(c: Column, kind: str) -> Column:
    """Whether a field says nothing: NULL, an empty string or an empty list."""
    if kind == "string":
        return c.isNull() | (c == "")
    return c.isNull() | (F.size(c) == 0) if kind.startswith("array") else c.isNull()


def completeness(df: DataFrame, fields: list[str]) -> Column:
    """How many of the fields say something."""
    kinds = dict(df.dtypes)
    return sum((F.when(blank(F.col(c), kinds[c]), 0).otherwise(1) for c in fields), F.lit(0))


def record_day(date: Column, year: Column) -> Column:
    """The date, else the last day of the year: what a record is ranked by."""
    return F.coalesce(date, F.make_date(year, F.lit(12), F.lit(31)))


def fold(records: DataFrame, key: str, rank: list[Column], scalars: list[str], lists: list[str], flags: list[str]) -> DataFrame:
    """One row for each key, of its records in rank order (smallest first).

    scalars: the first value that says something; lists: all elements, first seen first; flags: OR.
    A scalar is a partially aggregated minimum, so a key with very many records is folded before they meet.
    """
    kinds, place = dict(records.dtypes), F.struct(*[r.alias(f"r{k}") for k, r in enumerate(rank)])
    ranked = records.withColumn("_rank", place)
    out = [F.min_by(F.when(~blank(F.col(c), kinds[c]), F.col(c)), F.when(~blank(F.col(c), kinds[c]), F.col("_rank"))).alias(c) for c in scalars]
    for c in lists:
        parts = F.array_sort(F.collect_list(F.when(~blank(F.col(c), kinds[c]), F.struct("_rank", F.col(c).alias("v")))))
        out.append(F.array_distinct(F.flatten(F.transform(parts, lambda x: x["v"]))).alias(c))
    out += [F.bool_or(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in flags]
    return ranked.groupBy(key).agg(*out)


def inventory(rows: DataFrame, key: str, ids: str, at: str) -> DataFrame:
    """``(key, ids, at)``: the union of lists, NULL if any is unknown, and the latest time."""
    union = F.array_sort(F.array_distinct(F.flatten(F.collect_list(ids))))
    return rows.groupBy(key).agg(F.when(F.bool_or(F.col(ids).isNull()), F.lit(None)).otherwise(union).alias(ids), F.max(at).alias(at))


def supported(evidence: Column, complete: Column, flag: Column) -> Column:
    """Membership: any evidence supports it, complete coverage without evidence does not, else the flag stays."""
    return F.when(evidence, F.lit(True)).when(complete, F.lit(False)).otherwise(flag)


def keyed_union(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of first, and those of second whose keys first lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))
