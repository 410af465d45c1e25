"""Islands that are too large for one task are settled in turns, as many as their pairs ask for."""

from quillgraph.operators import constrained


def test_a_hub_takes_few_turns(spark, monkeypatch):
    """Every pair touches node 0, so settling only pairs that come first at both ends would take a round for each of them."""
    looked, real = [], constrained._islands
    monkeypatch.setattr(constrained, "_islands", lambda *frames: looked.append(1) or real(*frames))
    same = spark.createDataFrame([(k, 0, k) for k in range(1, 41)], "rank bigint, a bigint, b bigint")
    different = spark.createDataFrame([(k, k + 1) for k in range(1, 40)], "a bigint, b bigint")
    none = spark.createDataFrame([], "a bigint, b bigint")
    nodes, verdicts = constrained.constrained_components(none, same, different, local=20)
    assert {r["rank"] for r in verdicts.where("accepted").collect()} == set(range(1, 41, 2))
    assert {tuple(r) for r in nodes.collect()} == {(k, 0) for k in [0, *range(1, 41, 2)]}
    assert len(looked) == 3  # the whole, then two turns


def test_turns_are_halved_where_much_stays_apart(spark):
    same = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 4), (4, 1, 4)], "rank bigint, a bigint, b bigint")
    different = spark.createDataFrame([(1, 3), (2, 4)], "a bigint, b bigint")
    nodes, verdicts = constrained.constrained_components(spark.createDataFrame([], "a bigint, b bigint"), same, different, most=1)
    assert [r["accepted"] for r in verdicts.orderBy("rank").collect()] == [True, False, True, False]
    assert {tuple(r) for r in nodes.collect()} == {(1, 1), (2, 1), (3, 3), (4, 3)}
