"""A publish program over the graph's tables: the graph after it, and the plan of a prune."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import publish
from quillgraph.plans.registry import graph_query

#: name: (columns, query over the graph's tables). One definition serves Spark and the oracle.
_PARTS = {
    "live_nodes": """SELECT concat('Publication:', pid) AS node FROM publications WHERE pid % 9 <> 4 UNION ALL SELECT concat('Person:', per) FROM persons WHERE per % 8 <> 3
UNION ALL SELECT concat('Person:x', per) FROM persons WHERE per % 15 = 0 UNION ALL SELECT concat('Repository:', rid) FROM repositories WHERE rid % 6 <> 1
UNION ALL SELECT concat('LinkCandidate:', rid) FROM repositories WHERE rid % 4 <> 1""",
    "live_edges": """SELECT 'AUTHORED' AS rel, concat('Person:', per) AS src, concat('Publication:', pid) AS tgt FROM authorship WHERE (pid + per) % 5 <> 0
UNION ALL SELECT 'IMPLEMENTS', concat('Repository:', rid), concat('Publication:', pid) FROM repo_pubs WHERE (rid + pid) % 7 <> 2
UNION ALL SELECT 'MENTIONS', concat('Publication:', pid), concat('LinkCandidate:', rid) FROM repo_pubs WHERE (rid + pid) % 5 <> 1
UNION ALL SELECT 'COAUTHOR', concat('Person:', per), concat('Person:', did) FROM persons WHERE per <> did""",
    "prog_rows": """SELECT concat('Publication:', pid) AS node, true AS written FROM publications UNION ALL SELECT concat('Person:', per), true FROM persons
UNION ALL SELECT concat('Repository:', rid), rid % 11 <> 0 FROM repositories UNION ALL SELECT concat('LinkCandidate:', rid), true FROM repo_pubs WHERE (rid + pid) % 3 = 0""",
    "prog_edges": """SELECT 'AUTHORED' AS rel, concat('Person:', per) AS src, concat('Publication:', pid) AS tgt FROM authorship
UNION ALL SELECT 'IMPLEMENTS', concat('Repository:', rid), concat('Publication:', pid) FROM repo_pubs WHERE (rid + pid) % 4 <> 3
UNION ALL SELECT 'MENTIONS', concat('Publication:', pid), concat('LinkCandidate:', rid) FROM repo_pubs WHERE (rid + pid) % 3 = 0""",
    "folds": """SELECT concat('Person:', a.per) AS old, concat('Person:', b.per) AS new FROM persons a JOIN persons b ON b.per = a.per - 1 WHERE a.per % 10 IN (6, 7)
UNION ALL SELECT concat('Repository:', a.rid), concat('Repository:', b.rid) FROM repositories a JOIN repositories b ON b.rid = a.rid - 1 WHERE a.rid % 20 = 13""",
    "promotions": "SELECT concat('LinkCandidate:', rid) AS old, concat('Repository:', rid) AS new FROM repositories WHERE rid % 2 = 0",
    "checked": """SELECT 'MENTIONS' AS rel, concat('Publication:', pid) AS owner, pid % 3 <> 0 AS complete FROM publications
UNION ALL SELECT 'IMPLEMENTS', concat('Publication:', pid), pid % 2 = 0 FROM publications""",
    "dropped": "SELECT 'AUTHORED' AS rel, concat('Person:', per) AS src, concat('Publication:', pid) AS tgt FROM authorship WHERE (pid + per) % 13 = 0",
    "claimed": "SELECT 'IMPLEMENTS' AS rel, concat('Repository:', rid) AS src, concat('Publication:', pid) AS tgt FROM repo_pubs WHERE (rid + pid) % 12 = 3",
    "claimed_nodes": "SELECT concat('Person:x', per) AS node FROM persons WHERE per % 30 = 0",
}

_SQL = "".join(f", {name} AS ({sql})\n" for name, sql in _PARTS.items()) + """, written AS (SELECT DISTINCT node FROM prog_rows WHERE written),
steps AS (SELECT old, new FROM folds UNION SELECT old, new FROM promotions WHERE new IN (SELECT node FROM written)),
walk AS (SELECT old, new FROM steps UNION ALL SELECT w.old, s.new FROM walk w JOIN steps s ON w.new = s.old),
al AS (SELECT old, new FROM walk WHERE new NOT IN (SELECT old FROM steps)),
wn AS (SELECT node FROM written WHERE node NOT IN (SELECT old FROM al)),
there AS (SELECT node FROM wn UNION SELECT node FROM live_nodes WHERE node NOT IN (SELECT old FROM al)),
allp AS (SELECT 'l' AS part, * FROM live_edges UNION ALL SELECT 'w', * FROM prog_edges p WHERE NOT EXISTS (SELECT 1 FROM dropped d WHERE (d.rel, d.src, d.tgt) = (p.rel, p.src, p.tgt)) UNION ALL SELECT 'c', * FROM claimed),
led AS (SELECT DISTINCT part, rel, coalesce(a.new, src) AS src, coalesce(b.new, tgt) AS tgt FROM allp LEFT JOIN al a ON a.old = src LEFT JOIN al b ON b.old = tgt WHERE coalesce(a.new, src) <> coalesce(b.new, tgt)),
ef AS (SELECT rel, src, tgt, bool_or(part = 'l') AS live, bool_or(part = 'w' AND src IN (SELECT node FROM there) AND tgt IN (SELECT node FROM there)) AS wanted, bool_or(part = 'c') AS claimed FROM led GROUP BY 1, 2, 3),
ch AS (SELECT rel, owner, bool_and(complete) AS complete FROM checked GROUP BY 1, 2),
ln AS (SELECT DISTINCT node FROM live_nodes)
"""


def _parts(t):
    """The program and the live graph, by the same SQL as the oracle's, run by Spark."""
    p = {}
    for name, sql in _PARTS.items():
        frames = {k: v for k, v in t.items() if k in sql}
        for k in frames:
            sql = sql.replace(f"FROM {k}", f"FROM {{{k}}}").replace(f"JOIN {k}", f"JOIN {{{k}}}")
        p[name] = next(iter(frames.values())).sparkSession.sql(sql, **frames)
    program = publish.Program(
        rows=p["prog_rows"], edges=p["prog_edges"], folds=p["folds"], promotions=p["promotions"], checked=p["checked"], owner_end={"MENTIONS": "src", "IMPLEMENTS": "tgt"},
        dropped=p["dropped"], claimed=p["claimed"], claimed_nodes=p["claimed_nodes"], owned=("COAUTHOR",),
    )
    return program, p["live_nodes"], p["live_edges"]


def _both(nodes, edges, label):
    none = F.lit(None).cast("string")
    return nodes.select(none.alias("rel"), F.col("node").alias("src"), none.alias("tgt"), label).union(edges.select("rel", "src", "tgt", label))


@graph_query(_SQL + """SELECT NULL::VARCHAR AS rel, node AS src, NULL::VARCHAR AS tgt, CASE WHEN node IN (SELECT old FROM al) THEN 'removed' WHEN node IN (SELECT node FROM ln) THEN 'kept' ELSE 'created' END AS state
FROM (SELECT node FROM ln UNION SELECT node FROM wn) UNION ALL
SELECT ef.rel, src, tgt, CASE WHEN NOT wanted AND NOT claimed AND coalesce(complete, false) THEN 'removed' WHEN live THEN 'kept' ELSE 'created' END
FROM ef LEFT JOIN ch ON ch.rel = ef.rel AND ch.owner = CASE ef.rel WHEN 'MENTIONS' THEN src WHEN 'IMPLEMENTS' THEN tgt END WHERE live OR wanted""")
def k18_published(t):
    """The graph after a publish: nodes, promoted candidates, edges, folds and evidence that was checked again."""
    return _both(*publish.published(*_parts(t)), "state")


@graph_query(_SQL + """SELECT NULL::VARCHAR AS rel, node AS src, NULL::VARCHAR AS tgt, CASE WHEN node IN (SELECT old FROM al) THEN 'fold' WHEN node NOT IN (SELECT node FROM ln) THEN 'create'
WHEN node IN (SELECT node FROM prog_rows) THEN 'keep' WHEN node IN (SELECT node FROM claimed_nodes) THEN 'hand' ELSE 'delete' END AS action
FROM (SELECT node FROM ln UNION SELECT node FROM wn) UNION ALL
SELECT rel, src, tgt, CASE WHEN NOT live THEN 'create' WHEN wanted THEN 'keep' WHEN claimed THEN 'hand' ELSE 'delete' END FROM ef WHERE (live OR wanted) AND rel <> 'COAUTHOR'""")
def g22_prune_plan(t):
    """What a prune would do to the live graph, by the state that the publish program asks for."""
    return _both(*publish.prune_plan(*_parts(t)), "action")
