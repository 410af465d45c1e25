"""Choosing one value for each key: votes, newest values, ranks with ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.checkpoints import checkpoint


def majority(votes: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, value)``: the value with most votes; of equal ones the smallest. NULL values don't vote."""
    counted = votes.where(F.col(value).isNotNull()).groupBy(key, value).count()
    best = F.min(F.struct((-F.col("count")).alias("n"), F.col(value).alias("v")))
    return counted.groupBy(key).agg(best.alias("b")).select(key, F.col("b.v").alias(value))


def first_known(keys: DataFrame, key: str, value: str, sources: list[DataFrame]) -> DataFrame:
    """``(key, value)`` for every key: from the first source that has one."""
    out = keys.select(key).distinct()
    for k, s in enumerate(sources):
        out = out.join(s.select(key, F.col(value).alias(f"v{k}")), key, "left")
    return out.select(key, F.coalesce(*[f"v{k}" for k in range(len(sources))]).alias(value))


def newest(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """``(key, value)``: the value that is not NULL of the row with the largest order columns."""
    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def latest_rows(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given; a hot key is sorted, not gathered."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def agreed_latest(rows: DataFrame, key: str, at: str, payload: str) -> DataFrame:
    """``(key, payload)``: the payload of the latest time, NULL if rows of that time disagree."""
    last = rows.groupBy(key, at).agg(F.min(payload).alias("low"), F.max(payload).alias("high")).groupBy(key).agg(F.max_by(F.struct("low", "high"), at).alias("x"))
    return last.select(key, F.when(F.col("x.low") == F.col("x.high"), F.col("x.low")).alias(payload))


def best_match(candidates: DataFrame, key: str, value: str, score: list[Column]) -> DataFrame:
    """``(key, value, ambiguous)``: the best scored value; ambiguous, and then NULL, if two share the top score."""
    ranked = candidates.groupBy(key, value).agg(F.max(F.struct(*score)).alias("s"))
    top = ranked.withColumn("r", F.rank().over(Window.partitionBy(key).orderBy(F.col("s").desc()))).where("r = 1")
    return top.groupBy(key).agg(F.when(F.count("*") == 1, F.min(value)).alias(value), (F.count("*") > 1).alias("ambiguous"))


def dense_ids(rows: DataFrame, order: list[Column], to: str) -> DataFrame:
    """rows with numbers from 0 in a total order, without gaps.

    Rows are sorted over all tasks and numbered where they are; only how many each task has comes together.
    """
    placed = checkpoint(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    task, earlier = F.expr("_at div 8589934592"), Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))  # a row for each task
    before = counts.select("_task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_from"))
    numbered = placed.withColumn("_task", task).join(F.broadcast(before), "_task")
    return numbered.withColumn(to, F.col("_from") + F.col("_at") % 8589934592).select(*rows.columns, to)


def bit_sets(rows: DataFrame, owner: str, member: str) -> tuple[DataFrame, list[str]]:
    """``(owner, bits_0, bits_1, …)`` and the names of the latter: which of the members an owner has, 64 in each long.

    Members are few, such as departments: each owner has a bit for every one. NULL is no member.
    """
    rows = checkpoint(rows.select(owner, member).distinct())
    ids = checkpoint(dense_ids(rows.select(member).dropna().distinct(), [F.col(member)], "_k"))
    columns = [f"bits_{w}" for w in range(max(1, -(-ids.count() // 64)))]
    bit = F.expr("shiftleft(1L, cast(_k % 64 as int))")
    each = [F.bit_or(F.when(F.col("_k").between(64 * w, 64 * w + 63), bit).otherwise(F.lit(0).cast("bigint"))).alias(c) for w, c in enumerate(columns)]
    return rows.join(ids, member, "left").groupBy(owner).agg(*each), columns


def scaled_rank(rows: DataFrame, value: str, to: str, digits: int = 3) -> DataFrame:
    """rows with ``to``: a value's position among the distinct values over their number, rounded.

    Distinct values are numbered alone and joined back, so rows never meet in one task.
    """
    values = checkpoint(rows.select(value).where(F.col(value).isNotNull()).distinct())
    place = dense_ids(values, [F.col(value)], "_k").select(value, F.bround((F.col("_k") + 1) / F.lit(max(1, values.count())), digits).alias(to))
    return rows.join(place, value, "left")


def capped(rows: DataFrame, key: str, exempt: Column, order: list[str], most: int) -> DataFrame:
    """All rows where exempt holds, and the first ``most`` others of each key."""
    r = F.row_number().over(Window.partitionBy(key, exempt).orderBy(*order))
    return rows.withColumn("_r", r).where(exempt | (F.col("_r") <= most)).drop("_r")


def page(rows: DataFrame, order: list[Column], size: int, number: int = 0) -> DataFrame:
    """A page of rows in a total order."""
    return rows.orderBy(*order).offset(size * number).limit(size)


def stable_sample(rows: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """n rows with the least md5 of ``seed:key``: growing the table replaces few of them."""
    return rows.orderBy(F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string"))), key).limit(n)
