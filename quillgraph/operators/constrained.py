"""Components that decided pairs join in a fixed order, unless that would bring together what must stay apart."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.checkpoints import checkpoint
from quillgraph.operators.components import connected_components
from quillgraph.operators.votes import dense_ids

#: Decided pairs of one island that one task settles; larger islands are settled in turns of so many pairs.
LOCAL = 250_000
#: Pairs that must stay apart which one task holds with them; a turn that has more is halved.
APART = 1_000_000


def _settle(edges: pd.DataFrame, apart: pd.DataFrame) -> list[tuple[int, int, bool]]:
    """(rank, component after all, accepted) of an island's edges (rank, a, b), in order of rank; the component is by smallest member."""
    of: dict[int, int] = {}
    barred: dict[int, set[int]] = {}

    def top(x: int) -> int:
        while of.get(x, x) != x:
            of[x] = of.get(of[x], of[x])
            x = of[x]
        return x

    for a, b in apart[["a", "b"]].itertuples(index=False):
        barred.setdefault(a, set()).add(b)
        barred.setdefault(b, set()).add(a)
    done = []
    for rank, a, b in edges.sort_values("rank")[["rank", "a", "b"]].itertuples(index=False):
        x, y = top(a), top(b)
        held = barred.get(x, set()) | barred.get(y, set())
        accepted = not held & {x, y}
        if accepted and x != y:
            keep, gone = min(x, y), max(x, y)
            of[gone] = keep
            for other in barred.pop(gone, set()):
                barred[other].discard(gone)
                barred[other].add(keep)
                barred.setdefault(keep, set()).add(other)
        done.append((rank, a, b, accepted))
    return [(r, top(a), a, b, ok) for r, a, b, ok in done]


def _islands(edges: DataFrame, apart: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """edges with their island ``i``; (i, a, b) of apart within one; and (i, n, held), how many of either an island has."""
    island = connected_components(edges, "a", "b")
    loops = edges.where("a = b").select(F.col("a").alias("node")).distinct().join(island, "node", "left_anti").select("node", F.col("node").alias("component"))
    island = checkpoint(island.union(loops))
    edges = checkpoint(edges.join(island.toDF("a", "i"), "a").select("i", "rank", "a", "b"))
    barred = checkpoint(apart.join(island.toDF("a", "i"), "a").join(island.toDF("b", "j"), "b").where("i = j").select("i", "a", "b"))
    held = barred.groupBy("i").agg(F.count("*").alias("held"))
    sizes = edges.groupBy("i").agg(F.count("*").alias("n")).join(held, "i", "left").select("i", "n", F.coalesce("held", F.lit(0)).alias("held"))
    return edges, barred, checkpoint(sizes)


def _settled(edges: DataFrame, barred: DataFrame) -> DataFrame:
    """``(rank, top, a, b, accepted)`` of whole islands (i), one task each."""

    def few(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = _settle(left, right) if len(left) else []
        return pd.DataFrame([(r, t, a, b, ok) for r, t, a, b, ok in rows], columns=["rank", "top", "a", "b", "accepted"])

    return checkpoint(edges.groupBy("i").cogroup(barred.groupBy("i")).applyInPandas(few, "rank bigint, top bigint, a bigint, b bigint, accepted boolean"))


def _moves(settled: DataFrame) -> DataFrame:
    """(old, new): components that accepted pairs brought into others."""
    ends = settled.where("accepted").select(F.explode(F.array("a", "b")).alias("old"), F.col("top").alias("new"))
    return checkpoint(ends.where("old <> new").distinct())


def _turns(edges: DataFrame, apart: DataFrame, local: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Decisions (rank, accepted) and moves (old, new) of edges and apart, both between components, ``local`` pairs at a time by rank.

    A turn's pairs depend on earlier turns only by what has become of their components, and on one another within an island of
    the turn. So turns grow with the pairs, and no task holds more than a turn's; one of which an island has more than ``most`` pairs apart is halved.
    """
    spark = edges.sparkSession
    edges = checkpoint(dense_ids(edges.select("rank", "a", "b"), [F.col("rank")], "at"))
    n, start, size = edges.count(), 0, local
    settled = spark.createDataFrame([], "rank bigint, accepted boolean")
    total = spark.createDataFrame([], "old bigint, new bigint")

    def moved(pairs: DataFrame, moves: DataFrame) -> DataFrame:
        for c in "ab":
            pairs = pairs.join(moves.toDF("old", "new"), pairs[c] == F.col("old"), "left").withColumn(c, F.coalesce("new", c)).drop("old", "new")
        return pairs

    while start < n:
        now = checkpoint(moved(edges.where(F.col("at").between(start, start + size - 1)).select("rank", "a", "b"), total))
        now, barred, sizes = _islands(now, apart)
        if size > 1 and not sizes.where(F.col("held") > most).isEmpty():
            size //= 2
            continue
        done = _settled(now, barred)
        moves = _moves(done)
        settled = checkpoint(settled.union(done.select("rank", "accepted")))
        # a component that has moved may move on
        total = checkpoint(total.join(moves.toDF("new", "next"), "new", "left").select("old", F.coalesce("next", "new").alias("new")).union(moves))
        apart = checkpoint(moved(apart, moves).distinct())
        start, size = start + size, min(local, 2 * size)
    return settled, total


def constrained_components(automatic: DataFrame, same: DataFrame, different: DataFrame, local: int = LOCAL, most: int = APART) -> tuple[DataFrame, DataFrame]:
    """``(node, component)`` and ``(rank, a, b, accepted)``: automatic pairs (a, b) join at once; same pairs (rank, a, b) one by one.

    A pair of ``same`` is refused if the component that it would make holds both ends of a pair of ``different`` (a, b); refused
    pairs join nothing, and what is refused may depend on pairs accepted before it. Nodes are integers; ranks order the pairs and
    are distinct. A node without an accepted or automatic pair has no row; a component is named by its smallest node. Pairs
    with a NULL end are left out, as loops are. Only components that ``same`` touches take part: islands of them that few
    decided pairs connect are settled in one task each, those of over ``local`` pairs, or with over ``most`` pairs apart, in turns of ``local``.
    """
    joined = checkpoint(connected_components(automatic, "a", "b"))

    def lifted(pairs: DataFrame) -> DataFrame:
        for c in "ab":
            of = joined.toDF("n", "m")
            pairs = pairs.join(of, pairs[c] == of["n"], "left").withColumn(c, F.coalesce("m", c)).drop("n", "m")
        return pairs

    given = checkpoint(same.where("a <> b").select("rank", "a", "b"))
    edges = checkpoint(lifted(given))
    apart = checkpoint(lifted(different.where("a <> b").select("a", "b")).distinct())
    edges, barred, sizes = _islands(edges, apart)
    fits = (F.col("n") <= local) & (F.col("held") <= most)
    whole, wide = (checkpoint(sizes.where(test).select("i")) for test in (fits, ~fits))
    small = _settled(edges.join(whole, "i", "left_semi"), barred.join(whole, "i", "left_semi"))
    verdicts, moves = small.select("rank", "accepted"), _moves(small)
    if not wide.isEmpty():
        later, more = _turns(edges.join(wide, "i", "left_semi"), barred.join(wide, "i", "left_semi").select("a", "b"), local, most)
        verdicts, moves = verdicts.union(later), checkpoint(moves.union(more))
    touched = checkpoint(edges.join(verdicts, "rank").where("accepted"))
    nodes = joined.union(touched.select("a", "a")).union(touched.select("b", "b"))
    nodes = nodes.groupBy("node").agg(F.min("component").alias("component"))
    placed = nodes.join(moves, nodes["component"] == moves["old"], "left").select("node", F.coalesce("new", "component").alias("component"))
    return placed, given.join(verdicts, "rank").select("rank", "a", "b", "accepted")
