"""Queries of identities, history, decisions and health over the publication graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.operators import edges, groups, health, history, votes
from quillgraph.plans.registry import graph_query, query


def _versions(t):
    """A publication's record as two stores saw it: those of odd prices were changed later."""
    p = t["publications"].select("pid", "title", "type")
    odd = F.col("pid") % 3 == 0
    incoming = p.where("pid % 5 <> 0").withColumn("type", F.when(odd, F.lit("X")).otherwise(F.col("type")))
    return p.where("pid % 7 <> 0").withColumn("_version", F.lit(1)), incoming


_VERSIONS = """, cur AS (SELECT pid, title, type FROM publications WHERE pid % 7 <> 0),
inc AS (SELECT pid, title, CASE WHEN pid % 3 = 0 THEN 'X' ELSE type END AS type FROM publications WHERE pid % 5 <> 0)
"""


@graph_query(_VERSIONS + """SELECT pid, coalesce(i.title, c.title) AS title, coalesce(i.type, c.type) AS type,
CASE WHEN c.pid IS NOT NULL AND i.pid IS NOT NULL AND (i.title, i.type) IS DISTINCT FROM (c.title, c.type) THEN 2 ELSE 1 END AS _version FROM cur c FULL JOIN inc i USING (pid)""")
def k02_upsert(t):
    return history.upsert(*_versions(t), "pid")[0]


@graph_query(_VERSIONS + "SELECT pid, c.title, c.type, 1 AS _version FROM cur c JOIN inc i USING (pid) WHERE (i.title, i.type) IS DISTINCT FROM (c.title, c.type)")
def k02_revisions(t):
    return history.upsert(*_versions(t), "pid")[1]


@graph_query("""SELECT pid, CASE WHEN pid % 3 = 1 THEN 'b' WHEN pid % 2 = 0 THEN 'b,a' ELSE 'a' END AS groups FROM publications WHERE pid % 2 = 0 OR pid % 3 <> 1
OR FALSE""")
def k03_replace_group(t):
    both = F.when(F.col("pid") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    rows = t["publications"].select("pid", both.alias("groups"))
    out = history.replace_group(rows, rows.where("pid % 3 <> 1"), "pid", "a")
    return out.select("pid", F.array_join(F.reverse(F.array_sort("groups")), ",").alias("groups"))


@graph_query("SELECT CASE WHEN year >= 1998 THEN 'kept' ELSE 'dropped' END AS part, count(*) AS n FROM publications GROUP BY 1")
def k06_retention(t):
    kept, dropped = history.trim(t["publications"], "year", F.lit(1998))
    return kept.select(F.lit("kept").alias("part")).union(dropped.select(F.lit("dropped"))).groupBy("part").agg(F.count("*").alias("n"))


@graph_query("SELECT pid, per FROM authorship WHERE pid % 4 = 0 OR per % 9 = 0")
def k11_unmatched_edges(t):
    src, tgt = t["publications"].where("pid % 4 <> 0"), t["persons"].where("per % 9 <> 0")
    return edges.attach(t["authorship"].select("pid", "per"), src, tgt, "pid", "per")[1].select("pid", "per")


@graph_query("SELECT per AS a, pid AS b FROM authorship WHERE per % 9 <> 0 AND pid % 9 <> 0")
def k14_delete_nodes(t):
    gone = t["publications"].where("pid % 9 = 0").select("pid").union(t["persons"].where("per % 9 = 0").select("per"))
    return edges.without_nodes(t["authorship"].select(F.col("per").alias("a"), F.col("pid").alias("b")), gone, "pid")


@graph_query("SELECT 'publications' AS name, 0 AS repeated UNION ALL SELECT 'venue_date', (SELECT count(*)::INTEGER FROM (SELECT 1 FROM publications GROUP BY venue, date HAVING count(*) > 1))")
def k30_unique_keys(t):
    def repeated(name, *keys):
        return health.excess(t["publications"], *map(F.col, keys)).agg(F.count("*").cast("int").alias("repeated")).select(F.lit(name).alias("name"), "repeated")

    return repeated("publications", "pid").union(repeated("venue_date", "venue", "date"))


@graph_query("SELECT venue AS key, arg_min(pid, (date, pid)) AS owner FROM publications GROUP BY venue")
def i01_first_claims(t):
    return history.first_claims(t["publications"].select(F.col("venue").alias("key"), F.col("pid").alias("owner"), "date"), "key", "owner", ["date", "owner"])


@graph_query(""", reg AS (SELECT per, did AS owner FROM persons WHERE per % 3 <> 0)
SELECT pid, CASE WHEN min(owner) = max(owner) THEN min(owner) END AS owner, CASE WHEN min(owner) IS NULL THEN 'new' WHEN min(owner) = max(owner) THEN 'known' ELSE 'conflict' END AS state
FROM authorship LEFT JOIN reg USING (per) GROUP BY pid""")
def i05_identity_owners(t):
    registry = t["persons"].where("per % 3 <> 0").select("per", F.col("did").alias("owner"))
    return history.owners(t["authorship"].select("pid", "per"), registry, "pid", "per", "owner")


@graph_query(""", al AS (SELECT per AS old, per - per % 10 AS new FROM persons WHERE per % 10 <> 0 AND per > 10),
a0 AS (SELECT per AS x, pid % 100 + 1 AS y, CASE WHEN position = 7 THEN 'different' WHEN corresponding THEN 'same' ELSE 'unsure' END AS verdict, pid AS ts FROM authorship),
a1 AS (SELECT coalesce(b.new, x) AS x, coalesce(c.new, y) AS y, verdict, ts FROM a0 LEFT JOIN al b ON b.old = x LEFT JOIN al c ON c.old = y)
SELECT least(x, y) AS a, greatest(x, y) AS b, CASE WHEN bool_or(verdict = 'different') THEN 'different' ELSE max_by(verdict, (ts, verdict)) END AS verdict FROM a1 WHERE x <> y GROUP BY 1, 2""")
def i13_decisions(t):
    aliases = t["persons"].where("per % 10 <> 0 AND per > 10").select(F.col("per").alias("old"), (F.col("per") - F.col("per") % 10).alias("new"))
    verdict = F.when(F.col("position") == 7, "different").when(F.col("corresponding"), "same").otherwise("unsure")
    answers = t["authorship"].select(F.col("per").alias("x"), (F.col("pid") % 100 + 1).alias("y"), verdict.alias("verdict"), F.col("pid").alias("at"))
    return history.decisions(answers, aliases)


@graph_query("SELECT sha256('{\"pid\":' || pid || ',\"title\":\"' || title || '\"}') AS request, pid FROM publications")
def i21_verdict_cache_key(t):
    return t["publications"].select(F.sha2(F.to_json(F.struct("pid", "title")), 256).alias("request"), "pid")


@graph_query("""SELECT pid, title, CASE WHEN pid % 11 = 0 THEN 'Z' ELSE type END AS type, CASE WHEN pid % 11 = 0 THEN type END AS covered FROM publications""")
def i24_overrides(t):
    rows = t["publications"].select("pid", "title", "type")
    return history.with_overrides(rows, rows.where("pid % 11 = 0").select("pid", F.lit("Z").alias("value")), "pid", "type")


@graph_query("SELECT venue, arg_max(cents, (date, pid)) AS value, arg_min(cents, (date, pid)) AS auto FROM publications GROUP BY venue")
def i25_override_merge(t):
    at = F.struct("date", "pid")
    return t["publications"].groupBy("venue").agg(F.max_by("cents", at).alias("value"), F.min_by("cents", at).alias("auto"))


@graph_query("SELECT venue, type, arg_max(title, (date, pid)) AS title FROM publications GROUP BY 1, 2")
def a50_latest_write(t):
    return history.latest_writes(t["publications"], ["venue", "type"], ["date", "pid"], "title")


@graph_query(""", l AS (SELECT venue, arg_max(title, (date, pid)) AS latest, arg_min(title, (date, pid)) AS recorded FROM publications GROUP BY venue)
SELECT venue, latest, recorded FROM l WHERE latest IS DISTINCT FROM recorded""")
def a51_conflicts(t):
    at = F.struct("date", "pid")
    last = history.latest_writes(t["publications"], ["venue"], ["date", "pid"], "title").withColumnRenamed("title", "latest")
    recorded = t["publications"].groupBy("venue").agg(F.min_by("title", at).alias("recorded"))
    return last.join(recorded, "venue").where("NOT (latest <=> recorded)")


@graph_query(""", o AS (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY date, pid) AS v FROM publications),
n AS (SELECT venue, v, title AS t0, lead(title) OVER w AS t1, type AS y0, lead(type) OVER w AS y1, lead(v) OVER w AS nx FROM o WINDOW w AS (PARTITION BY venue ORDER BY v))
SELECT venue, v, 'title' AS field, t0 AS old, t1 AS new FROM n WHERE nx IS NOT NULL AND t0 IS DISTINCT FROM t1 UNION ALL SELECT venue, v, 'type', y0, y1 FROM n WHERE nx IS NOT NULL AND y0 IS DISTINCT FROM y1""")
def a52_version_diffs(t):
    v = F.row_number().over(Window.partitionBy("venue").orderBy("date", "pid"))
    return history.version_diffs(t["publications"].withColumn("v", v), "venue", "v", ["title", "type"])


@graph_query("""SELECT i.pid, i.date::VARCHAR AS date FROM publications i LEFT JOIN (SELECT pid, CASE WHEN pid % 2 = 0 THEN date + 1 ELSE date - 1 END AS date FROM publications WHERE pid % 3 <> 0) s USING (pid) WHERE s.date IS NULL OR i.date > s.date""")
def j22_fresher(t):
    p = t["publications"].select("pid", "date")
    stored = p.where("pid % 3 <> 0").withColumn("date", F.expr("if(pid % 2 = 0, date + 1, date - 1)"))
    return history.fresher(stored, p, "pid", "date").select("pid", F.col("date").cast("string").alias("date"))


@graph_query("""SELECT venue, CASE WHEN min(title) = max(title) THEN min(title) END AS title FROM publications JOIN (SELECT venue, max(year) AS year FROM publications GROUP BY venue) USING (venue, year) GROUP BY venue, year""")
def s27_agreed_latest(t):
    return votes.agreed_latest(t["publications"], "venue", "year", "title")


_EDGES = "(SELECT rid AS a, min(rid) OVER (PARTITION BY owner, stars) AS b FROM repositories)"


@graph_query(f""", e AS (SELECT DISTINCT a, b FROM {_EDGES} WHERE a <> b), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(node, r) AS (SELECT DISTINCT a, a FROM both_ UNION SELECT reach.node, both_.b FROM reach JOIN both_ ON reach.r = both_.a)
SELECT node, min(r) AS grp FROM reach GROUP BY node""")
def g01_components(t):
    keyed = t["repositories"].select("rid", F.concat_ws("|", "owner", "stars").alias("key"))
    return groups.groups_of(groups.key_links(keyed, "rid", "key")).withColumnRenamed("group", "grp")


@graph_query("SELECT per AS old, 1::BIGINT AS new FROM persons WHERE per > 1")
def g04_alias_closure(t):
    chain = t["persons"].where("per > 1").select(F.col("per").alias("old"), F.expr("per div 2").alias("new"))
    return groups.alias_closure(chain)


@graph_query(""", k AS (SELECT rid, 's' || stars || '|' || substr(owner, 7, 1) AS key FROM repositories UNION ALL SELECT rid, 'l' || language || stars FROM repositories),
e AS (SELECT DISTINCT rid AS a, m AS b FROM (SELECT rid, min(rid) OVER (PARTITION BY key) AS m FROM k) WHERE rid <> m), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(node, r) AS (SELECT rid, rid FROM repositories UNION SELECT reach.node, both_.b FROM reach JOIN both_ ON reach.r = both_.a)
SELECT node AS rid, min(r) AS grp FROM reach GROUP BY node""")
def g05_identity_groups(t):
    r = t["repositories"].select("rid", F.concat(F.lit("s"), "stars", F.lit("|"), F.substring("owner", 7, 1)).alias("k1"), F.concat(F.lit("l"), "language", "stars").alias("k2"))
    return groups.identity_groups(r, "rid", ["k1", "k2"]).withColumnRenamed("group", "grp")


@graph_query("""SELECT per, pid, (pid % 10) AS root FROM authorship""")
def g07_repoint(t):
    aliases = t["publications"].where("pid > 9").select(F.col("pid").alias("old"), (F.col("pid") % 10).alias("new"))
    moved = t["authorship"].select("per", "pid", F.col("pid").alias("root"))
    return groups.repoint(moved, aliases, "root")


def _owner_links(t):
    keyed = t["repositories"].where("stars <= 3").select("rid", F.concat_ws("|", "owner", "stars").alias("key"))
    return groups.key_links(keyed, "rid", "key")


@graph_query(""", g AS (SELECT rid, min(rid) OVER (PARTITION BY owner, CASE WHEN stars <= 3 THEN stars ELSE 1000000 + rid END) AS component FROM repositories),
s AS (SELECT component, count(*) AS size FROM g GROUP BY 1), big AS (SELECT component FROM s WHERE size > 1 ORDER BY size DESC, component LIMIT 1)
SELECT rid, component, size, CASE WHEN component IN (SELECT component FROM big) THEN 'giant' WHEN size > 1 THEN 'small' ELSE 'single' END AS kind FROM g JOIN s USING (component)""")
def g09_component_sizes(t):
    return groups.component_sizes(t["repositories"], "rid", _owner_links(t))


def _walk(t):
    """Authorship as edges from a person, numbered from -1 down, to a publication."""
    return t["authorship"].select((-1 - F.col("per")).alias("a"), F.col("pid").alias("b"))


@graph_query(""", l0 AS (SELECT per, -1 - per AS r FROM persons WHERE internal),
l1 AS (SELECT pid, min(r) AS low, max(r) AS high FROM authorship JOIN l0 USING (per) GROUP BY pid),
l2 AS (SELECT per, min(low) AS low, max(high) AS high FROM authorship JOIN l1 USING (pid) WHERE per NOT IN (SELECT per FROM l0) GROUP BY per),
l3 AS (SELECT pid, min(low) AS low, max(high) AS high FROM authorship JOIN l2 USING (per) WHERE pid NOT IN (SELECT pid FROM l1) GROUP BY pid)
SELECT r AS node, r AS root, 0 AS dist FROM l0 UNION ALL SELECT pid, low, 1 FROM l1 WHERE low = high UNION ALL SELECT -1 - per, low, 2 FROM l2 WHERE low = high UNION ALL SELECT pid, low, 3 FROM l3 WHERE low = high""")
def w05_nearest_root(t):
    """Staff are the roots; the walk goes on until nothing new is met (here every external has written with staff, so three steps)."""
    return groups.nearest_root(_walk(t), t["persons"].where("internal").select((-1 - F.col("per")).alias("node")))


@graph_query("""SELECT -1 - per AS node, 0 AS ring FROM persons WHERE per = 1 UNION ALL SELECT DISTINCT pid, 1 FROM authorship WHERE per = 1
UNION ALL SELECT DISTINCT -1 - per, 2 FROM authorship WHERE per <> 1 AND pid IN (SELECT pid FROM authorship WHERE per = 1)""")
def g08_ring_walk(t):
    e = _walk(t)
    return groups.ring_walk(e.union(e.select("b", "a")), t["persons"].where("per = 1").select((-1 - F.col("per")).alias("node")), 2)


@graph_query(""", g AS (SELECT did AS grp, per, internal FROM persons)
SELECT grp, per, min(per) OVER (PARTITION BY grp, internal) AS part FROM g""")
def g03_split_conflicts(t):
    return groups.split_conflicts(t["persons"].select(F.col("did").alias("grp"), "per", F.col("internal").cast("string").alias("orcid")), "grp", "per", ["orcid"])


CHECKS = [
    health.Check("pub_no_authors", lambda t: t["publications"].join(t["authorship"], "pid", "left_anti"), "publications"),
    health.Check("pub_no_internal_author", lambda t: t["publications"].join(t["authorship"].join(t["persons"].where("internal"), "per"), "pid", "left_anti"), "publications"),
    health.Check("pub_no_corresponding", lambda t: t["publications"].join(t["authorship"].where("corresponding"), "pid", "left_anti"), "publications", 0.1, 0.6),
    health.Check("pub_no_department", lambda t: t["publications"].join(t["pub_depts"], "pid", "left_anti"), "publications"),
    health.Check("title_latin_only", lambda t: t["publications"].where(F.col("title").rlike(r"^[\p{IsLatin}\s]+$")), "publications"),
    health.Check("dup_venue_date", lambda t: health.excess(t["publications"], F.col("venue"), F.col("date")), "publications"),
    health.Check("person_no_work", lambda t: t["persons"].join(t["authorship"], "per", "left_anti"), "persons"),
    health.Check("person_same_name", lambda t: health.excess(t["persons"], F.lower(F.trim("name"))), "persons"),
    health.Check("external_person", lambda t: t["persons"].where("NOT internal"), "persons", 0.05, 0.5),
    health.Check("repo_no_publication", lambda t: t["repositories"].join(t["repo_pubs"], "rid", "left_anti"), "repositories"),
    health.Check("repo_same_name", lambda t: health.excess(t["repositories"], F.lower("name")), "repositories"),
    health.Check("dept_same_name", lambda t: health.excess(t["departments"], F.lower(F.trim("dname"))), "departments"),
    health.Check("edge_no_publication", lambda t: t["authorship"].join(t["publications"], "pid", "left_anti"), "authorship"),
    health.Check("year_mismatch", lambda t: t["publications"].where("year <> year(date)"), "publications"),
    health.Check("repeated_authorship", lambda t: health.excess(t["authorship"], F.col("pid"), F.col("per")), "authorship"),
]


@graph_query(""", c AS (SELECT 'pub_no_authors' AS check_name, 'p' AS o, 0.0 AS warn, 0.1 AS fail, (SELECT count(*) FROM publications WHERE pid NOT IN (SELECT pid FROM authorship)) AS n
UNION ALL SELECT 'pub_no_internal_author', 'p', 0, 0.1, (SELECT count(*) FROM publications WHERE pid NOT IN (SELECT pid FROM authorship JOIN persons USING (per) WHERE internal))
UNION ALL SELECT 'pub_no_corresponding', 'p', 0.1, 0.6, (SELECT count(*) FROM publications WHERE pid NOT IN (SELECT pid FROM authorship WHERE corresponding))
UNION ALL SELECT 'pub_no_department', 'p', 0, 0.1, (SELECT count(*) FROM publications WHERE pid NOT IN (SELECT pid FROM pub_depts))
UNION ALL SELECT 'title_latin_only', 'p', 0, 0.1, (SELECT count(*) FROM publications WHERE regexp_full_match(title, '[A-Za-z\\s]+'))
UNION ALL SELECT 'dup_venue_date', 'p', 0, 0.1, (SELECT coalesce(sum(k - 1), 0) FROM (SELECT count(*) AS k FROM publications GROUP BY venue, date))
UNION ALL SELECT 'person_no_work', 'q', 0, 0.1, (SELECT count(*) FROM persons WHERE per NOT IN (SELECT per FROM authorship))
UNION ALL SELECT 'person_same_name', 'q', 0, 0.1, (SELECT coalesce(sum(k - 1), 0) FROM (SELECT count(*) AS k FROM persons GROUP BY lower(trim(name))))
UNION ALL SELECT 'external_person', 'q', 0.05, 0.5, (SELECT count(*) FROM persons WHERE NOT internal)
UNION ALL SELECT 'repo_no_publication', 'r', 0, 0.1, (SELECT count(*) FROM repositories WHERE rid NOT IN (SELECT rid FROM repo_pubs))
UNION ALL SELECT 'repo_same_name', 'r', 0, 0.1, (SELECT coalesce(sum(k - 1), 0) FROM (SELECT count(*) AS k FROM repositories GROUP BY lower(name)))
UNION ALL SELECT 'dept_same_name', 'd', 0, 0.1, (SELECT coalesce(sum(k - 1), 0) FROM (SELECT count(*) AS k FROM departments GROUP BY lower(trim(dname))))
UNION ALL SELECT 'edge_no_publication', 'a', 0, 0.1, (SELECT count(*) FROM authorship WHERE pid NOT IN (SELECT pid FROM publications))
UNION ALL SELECT 'year_mismatch', 'p', 0, 0.1, (SELECT count(*) FROM publications WHERE year <> year(date))
UNION ALL SELECT 'repeated_authorship', 'a', 0, 0.1, (SELECT coalesce(sum(k - 1), 0) FROM (SELECT count(*) AS k FROM authorship GROUP BY pid, per))),
o AS (SELECT 'p' AS o, count(*) AS total FROM publications UNION ALL SELECT 'q', count(*) FROM persons UNION ALL SELECT 'r', count(*) FROM repositories UNION ALL SELECT 'd', count(*) FROM departments UNION ALL SELECT 'a', count(*) FROM authorship)
SELECT check_name, n::BIGINT AS n, total, round(n / total, 6) AS share, CASE WHEN n = 0 OR n / total <= warn THEN 'ok' WHEN n / total <= fail THEN 'warning' ELSE 'error' END AS status FROM c JOIN o USING (o)""")
def h35_health(t):
    return health.run(CHECKS, t)


@graph_query("SELECT rid, name, stars, owner, language FROM repositories WHERE rid NOT IN (SELECT rid FROM repo_pubs) ORDER BY rid LIMIT 20")
def h34_check_examples(t):
    check = next(c for c in CHECKS if c.name == "repo_no_publication")
    return health.examples(check, t, ["rid"], 20).select("rid", "name", "stars", "owner", "language")


@query("""SELECT 'props' AS field, count(*) FILTER (json_extract_string(props, '$.missing') IS NULL) AS nulls, count(*) AS rows, 1.0::DOUBLE AS null_share FROM events
UNION ALL SELECT 'user_id', count(*) FILTER (user_id % 2 = 0), count(*), round(count(*) FILTER (user_id % 2 = 0) / count(*), 6) FROM events""")
def a25_field_statistics(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return health.field_statistics(e.select(F.get_json_object("props", "$.missing").alias("props"), F.when(F.col("user_id") % 2 == 1, F.col("user_id")).alias("user_id")))
