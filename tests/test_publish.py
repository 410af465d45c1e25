"""The publish program and its prune plan on a graph small enough to read."""

import pytest

from quillgraph.operators import publish

NODE, EDGES, PAIR = "node string", "rel string, src string, tgt string", "old string, new string"


@pytest.fixture
def program(spark):
    def make(**changed):
        make_df = spark.createDataFrame
        parts = {
            "rows": make_df([("P:1", True), ("P:2", True), ("R:1", True), ("R:9", False), ("L:a", True), ("L:b", True), ("A:1", True), ("A:2", True), ("A:3", True), (None, True)], "node string, written boolean"),
            "edges": make_df([("WROTE", "A:1", "P:1"), ("WROTE", "A:3", "P:1"), ("WROTE", "A:2", "P:2"), ("SEES", "P:1", "L:a"), ("SEES", "P:2", "L:b"), ("SEES", "P:2", "R:8")], EDGES),
            "folds": make_df([("A:3", "A:2"), ("A:2", "A:1")], PAIR),
            "promotions": make_df([("L:a", "R:1"), ("L:b", "R:9")], PAIR),
            "checked": make_df([("SEES", "P:1", True), ("SEES", "P:2", False)], "rel string, owner string, complete boolean"),
            "owner_end": {"SEES": "src"},
            "dropped": make_df([("WROTE", "A:2", "P:2")], EDGES),
            "claimed": make_df([("SEES", "P:1", "R:7")], EDGES),
            "claimed_nodes": make_df([("R:7",)], NODE),
        }
        return publish.Program(**{**parts, **changed})

    return make


@pytest.fixture
def live(spark):
    nodes = spark.createDataFrame([("P:1",), ("A:3",), ("R:9",), ("R:7",), ("R:6",), ("L:a",)], NODE)
    edges = spark.createDataFrame([("WROTE", "A:3", "P:1"), ("SEES", "P:1", "R:7"), ("SEES", "P:1", "R:6"), ("SEES", "P:2", "R:6"), ("NEAR", "A:3", "A:1"), ("KNOWS", "R:6", "P:1")], EDGES)
    return nodes, edges


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_publish_folds_promotes_and_ends_only_what_was_checked_in_full(program, live):
    nodes, edges = publish.published(program(), *live)
    assert rows(nodes) == {("P:1", "kept"), ("P:2", "created"), ("R:1", "created"), ("L:b", "created"), ("A:1", "created"), ("A:3", "removed"), ("L:a", "removed"), ("R:9", "kept"), ("R:7", "kept"), ("R:6", "kept")}
    assert rows(edges) == {
        ("WROTE", "A:1", "P:1", "kept"), ("SEES", "P:1", "R:1", "created"), ("SEES", "P:2", "L:b", "created"),
        ("SEES", "P:1", "R:7", "kept"), ("SEES", "P:1", "R:6", "removed"), ("SEES", "P:2", "R:6", "kept"), ("KNOWS", "R:6", "P:1", "kept"),
    }


def test_prune_takes_what_neither_rows_nor_hands_explain(program, live):
    nodes, edges = publish.prune_plan(program(owned=("KNOWS",)), *live)
    assert rows(nodes) == {("P:1", "keep"), ("P:2", "create"), ("R:1", "create"), ("L:b", "create"), ("A:1", "create"), ("A:3", "fold"), ("L:a", "fold"), ("R:9", "keep"), ("R:7", "hand"), ("R:6", "delete")}
    assert rows(edges) == {
        ("WROTE", "A:1", "P:1", "keep"), ("SEES", "P:1", "R:1", "create"), ("SEES", "P:2", "L:b", "create"),
        ("SEES", "P:1", "R:7", "hand"), ("SEES", "P:1", "R:6", "delete"), ("SEES", "P:2", "R:6", "delete"),
    }


def test_evidence_of_a_folded_owner_that_is_not_complete_stays(spark, program, live):
    both = spark.createDataFrame([("P:2", "P:1")], PAIR)
    _, edges = publish.published(program(folds=both), *live)
    assert ("SEES", "P:1", "R:6", "kept") in rows(edges)


def test_a_circle_of_folds_is_refused_before_anything_is_planned(spark, program, live):
    with pytest.raises(ValueError, match="cycle"):
        publish.published(program(folds=spark.createDataFrame([("A:1", "A:2"), ("A:2", "A:1")], PAIR)), *live)


def test_empty_program_and_graph(spark, program):
    none = lambda schema: spark.createDataFrame([], schema)
    p = publish.Program(none("node string, written boolean"), none(EDGES), none(PAIR), none(PAIR), none("rel string, owner string, complete boolean"), {"SEES": "src"}, none(EDGES), none(EDGES), none(NODE))
    for nodes, edges in (publish.published(p, none(NODE), none(EDGES)), publish.prune_plan(p, none(NODE), none(EDGES))):
        assert nodes.count() == 0 and edges.count() == 0
