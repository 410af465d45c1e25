"""Edges that have no owner are dealt out to tasks."""

from quillgraph.operators import publish


def test_edges_without_an_owner_are_not_in_one_task(spark):
    df = spark.createDataFrame
    edge, pair = "rel string, src string, tgt string", "old string, new string"
    edges = [("AUTHORED", f"Person:{k % 40}", f"Publication:{k}") for k in range(400)] + [("MENTIONS", f"Publication:{k}", "Repository:1") for k in range(40)]
    nodes = df([(n,) for n in {x for _, *ends in edges for x in ends}], "node string")
    checked = [("MENTIONS", f"Publication:{k}", k % 2 == 0) for k in range(40)] + [("AUTHORED", "Person:1 Publication:1", True), ("AUTHORED", None, True)]
    none = df([], edge)
    program = publish.Program(
        rows=nodes.selectExpr("node", "true AS written"), edges=df(edges[400:410], edge), folds=df([], pair), promotions=df([], pair), checked=df(checked, "rel string, owner string, complete boolean"),
        owner_end={"MENTIONS": "src"}, dropped=none, claimed=none, claimed_nodes=df([], "node string"),
    )
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        _, found = publish.published(program, nodes, df(edges, edge))
        parts = found.rdd.glom().map(len).collect()
        states = {(r.rel, r.src, r.tgt): r.state for r in found.collect()}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert max(parts) < 200 and sum(parts) == 440
    assert states == {e: "removed" if e[0] == "MENTIONS" and 10 <= int(e[1][12:]) and int(e[1][12:]) % 2 == 0 else "kept" for e in edges}
