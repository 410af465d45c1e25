"""Joins with keys that very many rows share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.checkpoints import checkpoint

#: At most so many keys count as hot: those of more than one row in MOST_HOT.
MOST_HOT = 1000
SALTS = 1024


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], n: str, total: int | None = None) -> DataFrame:
    """The inner join of left with right, which has each key once and in ``n`` how many rows of left have it.

    Keys of more than one in MOST_HOT of those rows are looked up in a broadcast table, which
    therefore has MOST_HOT rows at most, whatever the input; their rows are dealt out by a salt. All
    other keys meet by shuffle, where none can fill a task. left is read once. Join keys are not NULL.
    total: the sum of ``n``, if known; else right is stored and summed first.
    """
    values = [c for c in right.columns if c not in keys]
    right = right.select(*keys, F.struct(*values).alias("_v"), F.col(n).alias("_n"))
    if total is None:
        right = checkpoint(right)
        total = right.agg(F.sum("_n")).first()[0] or 0
    hot = right.where(F.col("_n") > total / MOST_HOT).select(*keys, F.col("_v").alias("_hot"))
    cold = right.where(F.col("_n") <= total / MOST_HOT).select(*keys, F.lit(0).alias("_salt"), "_v")
    salt = F.when(F.col("_hot").isNotNull(), F.monotonically_increasing_id() % SALTS + 1).otherwise(F.lit(0)).cast("int")
    marked = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt)
    found = marked.join(cold, [*keys, "_salt"], "left").withColumn("_v", F.coalesce("_hot", "_v")).where("_v IS NOT NULL")
    return found.select(*left.columns, "_v.*")


def join_dealt(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], counted: DataFrame | None = None) -> DataFrame:
    """The inner join of left with right, which has each key once, for values of any size.

    A key of more than one in MOST_HOT of left's rows is dealt out in parts by the hash of ``by``, and its row of right is
    repeated for each part. Only the hot keys and their numbers of parts are broadcast: MOST_HOT rows at most. Join keys are
    not NULL. counted: rows with left's keys as often, where left itself is dear to read twice.
    """
    counts = checkpoint((left if counted is None else counted).groupBy(*keys).agg(F.count("*").alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("_n") > total / MOST_HOT).select(*keys, F.ceil(F.col("_n") * MOST_HOT / total).cast("int").alias("_parts")))
    salted = left.join(hot, keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*by), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    copies = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return salted.join(copies, [*keys, "_salt"]).drop("_salt")
