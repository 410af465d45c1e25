"""Few groups that hold everyone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.checkpoints import checkpoint
from quillgraph.operators.skew import join_counted


def greedy_cover(members: DataFrame, group: str, person: str) -> DataFrame:
    """``(person, group)``: each person once, in the groups that a greedy choice takes: most persons left, then the smallest name.

    A group that is first in that order for every one of its persons left is taken at once with all others of the kind: gains
    only fall, so nothing that shares a person with it can come before it. The result is that of taking one by one, in as many
    rounds as such choices wait for each other. A round counts, looks the counts up and compares; large groups are dealt out.
    Rows with a NULL are left out, repeated rows count once.
    """
    left = checkpoint(members.select(F.col(group).alias("g"), F.col(person).alias("p")).dropna().distinct())
    out = None
    while not left.isEmpty():
        gains = checkpoint(left.groupBy("g").agg(F.count("*").alias("n")))
        rows = join_counted(left, gains.select("g", "n", F.col("n").alias("gain")), ["g"], "n").select("g", "p", "gain")
        first = rows.groupBy("p").agg(F.min(F.struct((-F.col("gain")).alias("n"), "g")).alias("b")).select("p", F.col("b.g").alias("g"))
        first = checkpoint(first)
        wins = first.groupBy("g").agg(F.count("*").alias("w"))
        taken = checkpoint(wins.join(gains, "g").where("w = n").select("g", "n"))
        placed = checkpoint(join_counted(first, taken, ["g"], "n").select("p", "g"))
        out = placed if out is None else out.union(placed)
        left = checkpoint(left.join(placed.select("p"), "p", "left_anti").select("g", "p"))
    out = left.select("p", "g") if out is None else out
    return out.select(F.col("p").alias(person), F.col("g").alias(group))
