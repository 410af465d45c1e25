"""Edges between members of shared groups: pairs, weights, top-k, synchronisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.checkpoints import checkpoint
from quillgraph.operators.skew import join_counted

#: Members of an uncapped group that meet the whole group in one part, and the least of a group that is larger still.
PART, LEAST_PART = 1000, 100
#: Pairs of an uncapped group's part, about, and of a task.
PART_PAIRS, TASK_PAIRS = 1 << 20, 1 << 18
#: Rows of either side in a block of ``all_meetings``.
BLOCK = 2048


def member_pairs(members: DataFrame, group: str, member: str, cap: int | None, carry: list[str] | None = None) -> DataFrame:
    """``(group, a, b, k)`` for each two members a < b of a group of k; groups of more than cap members are left out.

    Members are distinct in a group. The cap bounds what a group adds; it is part of the operator:
    beyond it, sharing a group says little. Without a cap (None) no group is left out, and the members of a
    large one are dealt out in parts, each of which meets the whole group; tasks are as many as the pairs ask for, however few bytes the members have. ``carry``: columns of a member, as ``a_<name>`` and ``b_<name>``.
    """
    carry = carry or []
    m = members.select(group, member, *carry).dropna(subset=[group, member]).dropDuplicates([group, member])
    m = m if cap is not None else checkpoint(m)
    sized = m.groupBy(group).agg(F.count("*").alias("k")).where((F.col("k") > 1) & (F.col("k") <= cap if cap is not None else F.lit(True)))
    a = m.select(group, F.col(member).alias("a"), *[F.col(c).alias(f"a_{c}") for c in carry])
    b = m.select(group, F.col(member).alias("b"), *[F.col(c).alias(f"b_{c}") for c in carry])
    if cap is not None:
        return a.join(sized, group).join(b, group).where("a < b")
    sized = checkpoint(sized)
    pairs = sized.agg(F.sum(F.col("k").cast("double") * F.col("k"))).first()[0] or 0
    tasks = min(10_000, max(8, int(pairs / TASK_PAIRS)))
    each = F.greatest(F.lit(LEAST_PART), F.least(F.lit(PART), PART_PAIRS / F.col("k")))
    parts = F.ceil(F.col("k") / each).cast("int")
    a = a.join(sized, group).withColumn("_part", F.pmod(F.xxhash64("a"), parts).cast("int")).repartition(tasks, group, "_part")
    b = b.join(sized, group).withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("k").repartition(tasks, group, "_part")
    # members are few bytes and their pairs many: a broadcast or fewer tasks would save nothing
    return a.join(b.hint("merge"), [group, "_part"]).where("a < b").drop("_part")


def meeting_pairs(left: DataFrame, right: DataFrame, group: str, member: str) -> DataFrame:
    """``(a, b)``: each member of left with each of right in its group, dealt out as in ``member_pairs``; both are distinct in a group, and no group is left out."""
    left, right = (checkpoint(x.select(group, F.col(member).alias(end)).dropna().distinct()) for x, end in ((left, "a"), (right, "b")))
    sized = left.groupBy(group).agg(F.count("*").alias("n")).join(right.groupBy(group).agg(F.count("*").alias("k")), group)
    sized = checkpoint(sized)
    pairs = sized.agg(F.sum(F.col("n").cast("double") * F.col("k"))).first()[0] or 0
    tasks = min(10_000, max(8, int(pairs / TASK_PAIRS)))
    each = F.greatest(F.lit(LEAST_PART), PART_PAIRS / F.col("n"))
    parts = F.ceil(F.col("k") / each).cast("int")
    dealt = right.join(sized, group).select(group, "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("_part")).repartition(tasks, group, "_part")
    wide = left.join(sized, group).select(group, "a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part")).repartition(tasks, group, "_part")
    return dealt.join(wide.hint("merge"), [group, "_part"]).select("a", "b")


def all_meetings(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """The rows of left with those of right of the same group, as often as they are there; no group is left out, and NULL is none.

    Either side of a large group is dealt out by its other columns in parts of about BLOCK rows, and each two parts meet in a block of their own: a row is
    repeated for the other side's parts only, and a task's blocks are bounded however large a group is.
    """
    sides = [checkpoint(x.where(F.col(group).isNotNull())) for x in (left, right)]
    n, k = (x.groupBy(group).agg(F.count("*").alias(c)) for x, c in zip(sides, "nk", strict=True))
    sized = checkpoint(n.join(k, group).select(group, *[F.ceil(F.col(c) / BLOCK).cast("int").alias(f"_{c}") for c in "nk"], F.col("n").alias("_left"), F.col("k").alias("_right")))
    blocks = sized.agg(F.sum(F.col("_n").cast("double") * F.col("_k")), F.sum("_left"), F.sum("_right")).first()
    tasks = min(10_000, max(8, int(blocks[0] or 0)))

    def dealt(side: DataFrame, count: str, total: int | None, own: str, other: str) -> DataFrame:
        found = join_counted(side, sized.select(group, count, "_n", "_k"), [group], count, total or 0).drop(count)
        values = [c for c in side.columns if c != group]
        part, rest = F.pmod(F.xxhash64(*values), own).cast("int").alias(f"_of{own}"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"_of{other}")
        return found.select(group, *values, part, rest).repartition(tasks, group, "_of_n", "_of_k")

    a, b = dealt(sides[0], "_left", blocks[1], "_n", "_k"), dealt(sides[1], "_right", blocks[2], "_k", "_n")
    return a.join(b.hint("merge"), [group, "_of_n", "_of_k"]).drop("_of_n", "_of_k")


def pair_weights(members: DataFrame, group: str, member: str, cap: int | None = None) -> DataFrame:
    """``(a, b, w)``: how many groups two members share; groups of more than ``cap`` members, if given, do not count."""
    return member_pairs(members, group, member, cap).groupBy("a", "b").agg(F.count("*").alias("w"))


def coauthor_weights(authorship: DataFrame, internal: DataFrame, hyper: int = 50) -> DataFrame:
    """``(a, b, w)`` of persons ``per`` by the publications ``pid`` they share.

    A publication of more than ``hyper`` authors counts only for pairs with a person of ``internal`` (per).
    Such a pair is made from the internal side, so a list of thousands does not meet itself.
    """
    m = authorship.select("pid", "per").dropna().distinct()
    large = m.groupBy("pid").count().where(F.col("count") > hyper).select("pid")
    small_pairs = member_pairs(m.join(large, "pid", "left_anti"), "pid", "per", hyper).select("pid", "a", "b")
    wide = m.join(large, "pid", "left_semi")
    inside = wide.join(internal.select("per").distinct(), "per", "left_semi").select("pid", F.col("per").alias("i"))
    mixed = inside.join(wide, "pid").where("i <> per").select("pid", F.least("i", "per").alias("a"), F.greatest("i", "per").alias("b")).distinct()
    return small_pairs.union(mixed).groupBy("a", "b").agg(F.count("*").alias("w"))


def shared_weights(members: DataFrame, group: str, member: str, cap: int = 60) -> DataFrame:
    """``(a, b, w)``: each shared group of k members adds 1 / (k - 1)."""
    return member_pairs(members, group, member, cap).groupBy("a", "b").agg(F.sum(1 / (F.col("k") - 1)).alias("w"))


def combine_signals(signals: dict[str, DataFrame]) -> DataFrame:
    """``(a, b, w, via)``: weights added over named signals, and the names that contribute, in the order given."""
    parts = [d.select("a", "b", F.col("w").cast("double").alias("w"), F.lit(k).alias("k"), F.lit(n).alias("name")) for k, (n, d) in enumerate(signals.items())]
    union = parts[0]
    for p in parts[1:]:
        union = union.union(p)
    via = F.array_sort(F.collect_set(F.struct("k", "name")))
    return union.groupBy("a", "b").agg(F.sum("w").alias("w"), F.transform(via, lambda x: x["name"]).alias("via"))


def both_ways(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Every edge from either end: ``(node, other, …)``."""
    rest = [c for c in edges.columns if c not in (a, b)]
    return edges.select(F.col(a).alias("node"), F.col(b).alias("other"), *rest).union(edges.select(F.col(b), F.col(a), *rest))


def top_edges(edges: DataFrame, k: int, weight: str = "w") -> DataFrame:
    """Edges ``(a, b, weight)`` that are among the k heaviest of either end; ties go to the smaller neighbour."""
    order = Window.partitionBy("node").orderBy(F.col(weight).desc(), "other")
    kept = both_ways(edges).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return kept.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), weight).distinct()


def collapse(edges: DataFrame, ends: list[str], later: Column, last: list[str], any_true: list[str], union: list[str], if_equal: list[str]) -> DataFrame:
    """One edge for each pair of ends.

    last: the value of the latest edge; any_true: OR; union: distinct elements of all lists, sorted;
    if_equal: the value if all edges agree on it, else NULL.
    """
    def agreed(c: str) -> Column:
        return F.when((F.count_distinct(F.col(c)) == 1) & (F.count(F.col(c)) == F.count("*")), F.min(c)).alias(c)

    return edges.groupBy(*ends).agg(
        *[F.max_by(c, later).alias(c) for c in last],
        *[F.bool_or(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in any_true],
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>")))))).alias(c) for c in union],
        *[agreed(c) for c in if_equal],
    )


def attach(edges: DataFrame, src: DataFrame, tgt: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """(edges whose ends both exist, edges that miss one); src and tgt have the key columns a and b."""
    known_a, known_b = src.select(a).distinct().withColumn("_a", F.lit(True)), tgt.select(b).distinct().withColumn("_b", F.lit(True))
    joined = edges.join(known_a, a, "left").join(known_b, b, "left")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return joined.where(both).drop("_a", "_b"), joined.where(~both).drop("_a", "_b")


def sync_plan(live: DataFrame, desired: DataFrame, keys: list[str], props: list[str]) -> DataFrame:
    """``(keys, action)``: create, delete or update what makes live edges the desired ones; unchanged ones are left out."""
    old = live.select(*keys, F.struct(*props).alias("old"), F.lit(True).alias("is_old"))
    new = desired.select(*keys, F.struct(*props).alias("new"), F.lit(True).alias("is_new"))
    joined = old.join(new, keys, "full")
    action = F.when(F.col("is_old").isNull(), "create").when(F.col("is_new").isNull(), "delete").when(~F.col("old").eqNullSafe(F.col("new")), "update")
    return joined.select(*keys, action.alias("action")).where("action IS NOT NULL")


def without_nodes(edges: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Edges (a, b) that touch no node of ``removed``."""
    gone = removed.select(F.col(key).alias("x")).distinct()
    return edges.join(gone, edges["a"] == gone["x"], "left_anti").join(gone, edges["b"] == gone["x"], "left_anti")


def between(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Edges (a, b) with both ends among nodes."""
    seen = nodes.select(F.col(key).alias("x")).distinct()
    return edges.join(seen, edges["a"] == seen["x"], "left_semi").join(seen, edges["b"] == seen["x"], "left_semi")
