"""Pairs of siblings, all of them, however their records are dealt out."""

from collections import Counter

from quillgraph.operators import edges
from quillgraph.plans.record_queries import p15_version_siblings


def test_siblings_are_all_pairs(spark):
    pids = [2, 102, 3, 103, 203, 4, 5, 7, 98, 1, None, 3, 102]
    rows = p15_version_siblings({"works": spark.createDataFrame([(p,) for p in pids], "pid long")}).collect()
    known = [p for p in pids if p is not None]
    assert Counter((r.shorter, r.longer) for r in rows) == Counter((a, b) for a in known for b in known if a % 2 == 0 and b % 2 == 1 and b % 100 - 1 == a % 100)


def test_meetings_in_blocks_are_all_meetings(spark, monkeypatch):
    monkeypatch.setattr(edges, "BLOCK", 3)
    left, right = [("x", k % 9) for k in range(20)] + [("y", 1), (None, 2), ("z", 3)], [("x", -k) for k in range(10)] + [("y", 5), ("y", 5), (None, 6)]
    found = edges.all_meetings(spark.createDataFrame(left, "g string, a int"), spark.createDataFrame(right, "g string, b int"), "g")
    assert Counter((r.g, r.a, r.b) for r in found.collect()) == Counter((g, a, b) for g, a in left for h, b in right if g is not None and g == h)
