"""Pairs of groups without a cap: every pair once, and tasks by the number of pairs, not by bytes."""

from pyspark.sql import functions as F

from quillgraph.functions.text import bits_jaccard
from quillgraph.operators import edges, votes


def test_a_group_of_few_bytes_and_many_pairs_takes_many_tasks(spark):
    found = edges.member_pairs(spark.range(4000).select(F.lit(1).alias("g"), F.col("id").alias("m")), "g", "m", None).select("a", "b")
    busy = found.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sum(r["count"] for r in busy) == found.distinct().count() == 4000 * 3999 // 2
    assert len(busy) > 8 and max(r["count"] for r in busy) < 4000 * 3999 // 8


def test_meeting_pairs_are_whole(spark, monkeypatch):
    monkeypatch.setattr(edges, "PART_PAIRS", 1)
    monkeypatch.setattr(edges, "LEAST_PART", 2)
    left, right = [(1, 1), (1, 2), (2, 3), (None, 4), (4, 9), (1, 1)], [(1, 10 + k) for k in range(9)] + [(2, 30), (2, None), (3, 40), (None, 41)]
    found = [tuple(r) for r in edges.meeting_pairs(spark.createDataFrame(left, "g long, m long"), spark.createDataFrame(right, "g long, m long"), "g", "m").collect()]
    assert sorted(found) == sorted([(a, 10 + k) for a in (1, 2) for k in range(9)] + [(3, 30)])


def test_bit_sets_beyond_one_long(spark):
    sets = {1: set(range(150)), 2: set(range(60, 70)), 3: {63, 64, 149}, 4: set()}
    rows = [(o, m) for o, s in sets.items() for m in s or {None}] + [(1, 3)]
    s, bits = votes.bit_sets(spark.createDataFrame(rows, "o long, m long"), "o", "m")
    assert len(bits) == 3
    a, b = (s.select(F.col("o").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in bits]) for end in "ab")
    sides = ([F.col(f"{end}_{c}") for c in bits] for end in "ab")
    for r in a.crossJoin(b).select("a", "b", bits_jaccard(*sides).alias("j")).collect():
        x, y = sets[r.a], sets[r.b]
        assert r.j == (len(x & y) / len(x | y) if x | y else 0.0)
