"""Queries of joins, weights, votes, counts and ranks over the publication graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.functions.text import bits_jaccard
from quillgraph.operators import edges, folds, health, votes
from quillgraph.plans.registry import graph_query as query

HYPER = 5


@query(""", x AS (SELECT pid, string_agg(per, ',' ORDER BY position, per) AS authors, count(*) AS n FROM authorship GROUP BY pid) SELECT * FROM x""")
def j01_authorship_index(t):
    placed = F.array_sort(F.collect_list(F.struct("position", "per")))
    return t["authorship"].groupBy("pid").agg(F.array_join(F.transform(placed, lambda x: x["per"].cast("string")), ",").alias("authors"), F.count("*").alias("n"))


@query("""SELECT rid, r.owner, n.language, n.stars FROM repositories r JOIN (SELECT owner, max(language) AS language, max(stars) AS stars FROM repositories GROUP BY owner) n USING (owner)""")
def j03_repository_owner_profile(t):
    profiles = t["repositories"].groupBy("owner").agg(F.max("language").alias("language"), F.max("stars").alias("stars"))
    return t["repositories"].select("rid", "owner").join(profiles, "owner", "left")


@query("""SELECT pid, title FROM publications WHERE pid NOT IN (SELECT pid FROM repo_pubs)""")
def j05_publications_without_repository(t):
    return t["publications"].select("pid", "title").join(t["repo_pubs"], "pid", "left_anti")


@query("""SELECT pid, type FROM publications WHERE pid IN (SELECT pid FROM authorship JOIN persons USING (per) WHERE internal AND corresponding)""")
def j06_publications_with_internal_corresponding(t):
    inside = t["authorship"].where("corresponding").join(t["persons"].where("internal"), "per")
    return t["publications"].select("pid", "type").join(inside, "pid", "left_semi")


@query(f""", m AS (SELECT pid, per, internal, count(*) OVER (PARTITION BY pid) AS n FROM authorship JOIN persons USING (per))
SELECT a.per AS a, b.per AS b, count(*) AS w FROM m a JOIN m b ON a.pid = b.pid AND a.per < b.per
WHERE a.n <= {HYPER} OR a.internal OR b.internal GROUP BY 1, 2""")
def a01_coauthor_weight(t):
    return edges.coauthor_weights(t["authorship"], t["persons"].where("internal"), HYPER)


@query("""SELECT a.pid AS a, b.pid AS b, 1 AS w FROM publications a JOIN publications b ON a.venue = b.venue AND a.pid < b.pid
JOIN (SELECT venue FROM publications GROUP BY venue HAVING count(*) <= 60) v ON v.venue = a.venue""")
def a02_publication_pair_weight(t):
    return edges.pair_weights(t["publications"], "venue", "pid", 60).withColumn("w", F.col("w").cast("int"))


@query("""SELECT a.pid AS a, b.pid AS b, round(sum(1.0 / (k - 1)), 6) AS w FROM publications a JOIN publications b ON a.venue = b.venue AND a.pid < b.pid
JOIN (SELECT venue, count(*) AS k FROM publications GROUP BY venue HAVING count(*) <= 60) v ON v.venue = a.venue GROUP BY 1, 2""")
def a03_comembership(t):
    return edges.shared_weights(t["publications"], "venue", "pid").withColumn("w", F.round("w", 6))


_SIGNALS = """, s1 AS (SELECT a.rid AS a, b.rid AS b, count(*) AS w FROM repo_pubs a JOIN repo_pubs b ON a.pid = b.pid AND a.rid < b.rid GROUP BY 1, 2),
g AS (SELECT language, stars, rid, count(*) OVER (PARTITION BY language, stars) AS k FROM repositories),
s2 AS (SELECT a.rid AS a, b.rid AS b, 1.0 / (a.k - 1) AS w FROM g a JOIN g b ON a.language = b.language AND a.stars = b.stars AND a.rid < b.rid WHERE a.k <= 60),
signals AS (SELECT a, b, CAST(w AS DOUBLE) AS w, 0 AS k, 'publication' AS name FROM s1 UNION ALL SELECT a, b, CAST(w AS DOUBLE), 1, 'language' FROM s2)
"""


@query(_SIGNALS + "SELECT a, b, round(sum(w), 6) AS w, string_agg(DISTINCT name, ',' ORDER BY name DESC) AS via FROM signals GROUP BY 1, 2")
def a04_repository_signals(t):
    groups = t["repositories"].select(F.concat_ws("|", "language", "stars").alias("g"), "rid")
    found = edges.combine_signals({"publication": edges.pair_weights(t["repo_pubs"], "pid", "rid"), "language": edges.shared_weights(groups, "g", "rid")})
    return found.select("a", "b", F.round("w", 6).alias("w"), F.array_join("via", ",").alias("via"))


_VOTE = """, votes AS (SELECT pid, did, count(*) AS c FROM authorship JOIN persons USING (per) GROUP BY 1, 2),
voted AS (SELECT pid, did FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY c DESC, did) AS r FROM votes) WHERE r = 1)
"""


def _voted(t):
    return votes.majority(t["authorship"].join(t["persons"], "per"), "pid", "did")


@query(_VOTE + "SELECT pid, did FROM voted")
def a05_majority_department(t):
    return _voted(t)


@query(_VOTE + "SELECT pid, coalesce(v.did, d.did) AS did FROM publications LEFT JOIN voted v USING (pid) LEFT JOIN pub_depts d USING (pid)")
def a06_primary_department(t):
    return votes.first_known(t["publications"], "pid", "did", [_voted(t), t["pub_depts"]])


@query("""SELECT per, did FROM (SELECT per, d.did, row_number() OVER (PARTITION BY per ORDER BY date DESC, pid DESC) AS r
FROM authorship JOIN publications USING (pid) JOIN pub_depts d USING (pid)) WHERE r = 1""")
def a07_newest_department(t):
    rows = t["authorship"].join(t["publications"].select("pid", "date"), "pid").join(t["pub_depts"], "pid")
    return votes.newest(rows, "per", "did", ["date", "pid"])


@query(_VOTE + """, rv AS (SELECT rid, did, count(*) AS c FROM repo_pubs JOIN voted USING (pid) GROUP BY 1, 2),
r1 AS (SELECT rid, did FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY c DESC, did) AS r FROM rv) WHERE r = 1)
SELECT rid, coalesce(r1.did, rid % 25) AS did FROM repositories LEFT JOIN r1 USING (rid)""")
def a08_repository_department(t):
    own = votes.majority(t["repo_pubs"].join(_voted(t), "pid"), "rid", "did")
    given = t["repositories"].select("rid", F.pmod("rid", F.lit(25)).cast("int").alias("did"))
    return votes.first_known(t["repositories"], "rid", "did", [own, given])


_USAGE = """, used AS (SELECT did, count(*) AS c FROM (SELECT did FROM persons UNION ALL SELECT did FROM pub_depts) GROUP BY did),
usage AS (SELECT did, dname, coalesce(c, 0) AS n FROM departments LEFT JOIN used USING (did))
"""


@query(_USAGE + "SELECT did, dname, n, row_number() OVER (ORDER BY n DESC, dname) - 1 AS gid FROM usage")
def a09_department_usage(t):
    used = t["persons"].select("did").union(t["pub_depts"].select("did")).groupBy("did").agg(F.count("*").alias("c"))
    usage = t["departments"].join(used, "did", "left").select("did", "dname", F.coalesce("c", F.lit(0)).alias("n"))
    return votes.dense_ids(usage, [F.col("n").desc(), F.col("dname")], "gid")


@query("""SELECT coalesce(p.g, q.g) AS g, coalesce(p.n, 0) AS persons, coalesce(q.n, 0) AS pubs
FROM (SELECT CASE WHEN internal THEN did ELSE -1 END AS g, count(*) AS n FROM persons GROUP BY 1) p
FULL JOIN (SELECT did AS g, count(*) AS n FROM pub_depts GROUP BY 1) q ON p.g = q.g""")
def a10_department_counts(t):
    persons = t["persons"].groupBy(F.when(F.col("internal"), F.col("did")).otherwise(-1).alias("g")).agg(F.count("*").alias("persons"))
    pubs = t["pub_depts"].groupBy(F.col("did").alias("g")).agg(F.count("*").alias("pubs"))
    return persons.join(pubs, "g", "full").select("g", F.coalesce("persons", F.lit(0)).alias("persons"), F.coalesce("pubs", F.lit(0)).alias("pubs"))


@query("""SELECT rid, CASE WHEN n_owner >= 90 THEN 'owner:' || owner WHEN n_lang >= 2 THEN 'field:' || language ELSE 'none' END AS grp
FROM (SELECT rid, owner, language, count(*) OVER (PARTITION BY owner) AS n_owner, count(*) OVER (PARTITION BY language) AS n_lang FROM repositories)""")
def a11_repository_groups(t):
    r = t["repositories"]
    sized = r.join(r.groupBy("owner").agg(F.count("*").alias("n_owner")), "owner").join(r.groupBy("language").agg(F.count("*").alias("n_lang")), "language")
    grp = F.when(F.col("n_owner") >= 90, F.concat(F.lit("owner:"), "owner")).when(F.col("n_lang") >= 2, F.concat(F.lit("field:"), "language")).otherwise("none")
    return sized.select("rid", grp.alias("grp"))


@query("SELECT per, count(DISTINCT pid) AS n FROM authorship GROUP BY per")
def a12_publications_per_author(t):
    return t["authorship"].groupBy("per").agg(F.count_distinct("pid").alias("n"))


@query("SELECT pid, count(DISTINCT per) AS n FROM authorship GROUP BY pid")
def a13_authors_per_publication(t):
    return t["authorship"].groupBy("pid").agg(F.count_distinct("per").alias("n"))


@query("""SELECT per, string_agg(pid || ':' || position || ':' || CASE WHEN corresponding THEN 1 ELSE 0 END, ',' ORDER BY pid) AS roles FROM authorship GROUP BY per""")
def a14_role_map(t):
    role = F.concat_ws(":", F.col("pid"), F.col("position"), F.col("corresponding").cast("int"))
    return t["authorship"].groupBy("per").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pid", role.alias("r")))), lambda x: x["r"]), ",").alias("roles"))


@query(""", pd AS (SELECT DISTINCT pid, did FROM authorship JOIN persons USING (per))
SELECT a.did AS a, b.did AS b, count(*) AS w FROM pd a JOIN pd b ON a.pid = b.pid AND a.did < b.did GROUP BY 1, 2""")
def a15_department_pairs(t):
    return edges.pair_weights(t["authorship"].join(t["persons"], "per").select("pid", "did"), "pid", "did")


@query("""SELECT 'persons' AS kind, count(*) AS n FROM persons UNION ALL SELECT 'internal', count(*) FROM persons WHERE internal
UNION ALL SELECT 'publications', count(*) FROM publications UNION ALL SELECT 'repositories', count(*) FROM repositories UNION ALL SELECT 'departments', count(*) FROM departments""")
def a16_node_counts(t):
    def one(kind, df, n=None):
        return df.agg((F.count("*") if n is None else n).alias("n")).select(F.lit(kind).alias("kind"), "n")

    out = one("persons", t["persons"]).union(one("internal", t["persons"], F.count_if("internal")))
    for name in ("publications", "repositories", "departments"):
        out = out.union(one(name, t[name]))
    return out


@query("""SELECT 'AUTHORED' AS rel, count(*) AS n FROM authorship UNION ALL SELECT 'IMPLEMENTS', count(*) FROM repo_pubs UNION ALL SELECT 'PRODUCED_BY', count(*) FROM pub_depts""")
def a17_relationship_counts(t):
    parts = [t[n].select(F.lit(rel).alias("rel")) for n, rel in (("authorship", "AUTHORED"), ("repo_pubs", "IMPLEMENTS"), ("pub_depts", "PRODUCED_BY"))]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("rel").agg(F.count("*").alias("n"))


@query("SELECT year, count(*) AS n FROM publications WHERE year IS NOT NULL GROUP BY year ORDER BY year")
def a18_publications_per_year(t):
    return t["publications"].where("year IS NOT NULL").groupBy("year").agg(F.count("*").alias("n")).orderBy("year")


@query("SELECT dname, count(*) AS n FROM persons JOIN departments USING (did) GROUP BY dname ORDER BY n DESC, dname LIMIT 8")
def a19_top_departments(t):
    return t["persons"].join(t["departments"], "did").groupBy("dname").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dname").limit(8)


@query("SELECT coalesce(sum(c - 1), 0)::BIGINT AS extra FROM (SELECT count(*) AS c FROM publications GROUP BY venue, date HAVING count(*) > 1)")
def a20_excess_duplicates(t):
    return health.excess(t["publications"], F.col("venue"), F.col("date")).agg(F.coalesce(F.sum("excess"), F.lit(0)).alias("extra"))


@query(""", g AS (SELECT venue AS grant_id, title AS funder, count(*) AS c FROM publications GROUP BY 1, 2)
SELECT grant_id, sum(c)::BIGINT AS pubs, (SELECT funder FROM g h WHERE h.grant_id = g.grant_id ORDER BY c DESC, funder LIMIT 1) AS funder FROM g GROUP BY grant_id""")
def a27_grant_index(t):
    rows = t["publications"].select(F.col("venue").alias("grant_id"), F.col("title").alias("funder"), "pid")
    return rows.groupBy("grant_id").agg(F.count_distinct("pid").alias("pubs")).join(votes.majority(rows, "grant_id", "funder"), "grant_id")


@query("""SELECT count(*) AS pubs, round(avg(n), 6) AS authors, round(100.0 * count(*) FILTER (r.pid IS NOT NULL) / count(*), 6) AS with_code
FROM (SELECT pid, count(*) AS n FROM authorship GROUP BY pid) a LEFT JOIN (SELECT DISTINCT pid FROM repo_pubs) r USING (pid)""")
def a28_overview(t):
    a = t["authorship"].groupBy("pid").agg(F.count("*").alias("n"))
    r = t["repo_pubs"].select("pid").distinct().withColumn("code", F.lit(True))
    return a.join(r, "pid", "left").agg(F.count("*").alias("pubs"), F.round(F.avg("n"), 6).alias("authors"), F.round(100 * F.count_if("code") / F.count("*"), 6).alias("with_code"))


@query("""SELECT b.bucket, count(r.rid) AS n FROM (VALUES ('0'), ('1-9'), ('10-99'), ('100-999'), ('1000+')) b(bucket) LEFT JOIN
(SELECT rid, CASE WHEN stars < 1 THEN '0' WHEN stars < 10 THEN '1-9' WHEN stars < 100 THEN '10-99' WHEN stars < 1000 THEN '100-999' ELSE '1000+' END AS bucket FROM repositories) r ON r.bucket = b.bucket GROUP BY 1""")
def a30_star_histogram(t):
    s = F.col("stars")
    bucket = F.when(s < 1, "0").when(s < 10, "1-9").when(s < 100, "10-99").when(s < 1000, "100-999").otherwise("1000+")
    counted = t["repositories"].groupBy(bucket.alias("bucket")).agg(F.count("*").alias("c"))
    fixed = t["repositories"].sparkSession.range(1).select(F.explode(F.lit(["0", "1-9", "10-99", "100-999", "1000+"])).alias("bucket"))
    return fixed.join(counted, "bucket", "left").select("bucket", F.coalesce("c", F.lit(0)).alias("n"))


@query("""SELECT venue, min(pid) FILTER (r = 1) AS best, max(n) AS records FROM (SELECT venue, pid, count(*) OVER (PARTITION BY venue) AS n,
row_number() OVER (PARTITION BY venue ORDER BY CASE type WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, date DESC, pid) AS r FROM publications) GROUP BY venue""")
def a33_representative(t):
    kind = F.when(F.col("type") == "F", 0).when(F.col("type") == "O", 1).otherwise(2)
    best = F.min(F.struct(kind.alias("k"), (-F.unix_date("date")).alias("d"), "pid"))
    return t["publications"].groupBy("venue").agg(best.alias("b"), F.count("*").alias("records")).select("venue", F.col("b.pid").alias("best"), "records")


@query("""SELECT did, min(per) FILTER (r = 1) AS survivor FROM (SELECT did, per, row_number() OVER (PARTITION BY did ORDER BY coalesce(n, 0) DESC, internal DESC, per) AS r
FROM persons LEFT JOIN (SELECT per, count(*) AS n FROM authorship GROUP BY per) USING (per)) GROUP BY did""")
def a34_person_survivor(t):
    works = t["authorship"].groupBy("per").agg(F.count("*").alias("n"))
    rank = F.struct((-F.coalesce("n", F.lit(0))).alias("n"), (~F.col("internal")).alias("i"), "per")
    return t["persons"].join(works, "per", "left").groupBy("did").agg(F.min(rank).alias("b")).select("did", F.col("b.per").alias("survivor"))


@query(""", r AS (SELECT venue, pid, date, CASE WHEN title LIKE '1%' THEN NULL ELSE title END AS t, type, row_number() OVER (PARTITION BY venue ORDER BY date DESC, pid) AS k FROM publications)
SELECT venue, (SELECT t FROM r s WHERE s.venue = r.venue AND t IS NOT NULL ORDER BY k LIMIT 1) AS title,
(SELECT string_agg(type, ',' ORDER BY k0) FROM (SELECT type, min(k) AS k0 FROM r s WHERE s.venue = r.venue GROUP BY type)) AS types, bool_or(type = 'P') AS pending FROM r GROUP BY venue""")
def a36_publication_fold(t):
    rows = t["publications"].select("venue", F.when(~F.col("title").startswith("1"), F.col("title")).alias("title"), F.array("type").alias("types"), (F.col("type") == "P").alias("pending"), "date", "pid")
    out = folds.fold(rows, "venue", [-F.unix_date("date"), F.col("pid")], ["title"], ["types"], ["pending"])
    return out.withColumn("types", F.array_join("types", ","))


@query("SELECT pid, per % 7 AS per, max(position) AS position, bool_or(corresponding) AS corresponding FROM authorship GROUP BY 1, 2")
def k12_collapse_authored(t):
    a = t["authorship"].select("pid", F.pmod("per", F.lit(7)).alias("per"), "position", "corresponding")
    return edges.collapse(a, ["pid", "per"], F.col("position"), ["position"], ["corresponding"], [], [])


@query("SELECT pid, per, position FROM (SELECT *, row_number() OVER (PARTITION BY pid, internal ORDER BY position, per) AS r FROM authorship JOIN persons USING (per)) WHERE internal OR r <= 2")
def p03_capped_externals(t):
    rows = t["authorship"].join(t["persons"], "per")
    return votes.capped(rows, "pid", F.col("internal"), ["position", "per"], 2).select("pid", "per", "position")


@query("SELECT pid, title FROM (SELECT pid, title, md5('seed:' || pid) AS h FROM publications) ORDER BY h, pid LIMIT 100")
def p33_stable_sample(t):
    return votes.stable_sample(t["publications"].select("pid", "title"), "pid", "seed", 100)


@query(""", v AS (SELECT DISTINCT stars FROM repositories), r AS (SELECT stars, row_number() OVER (ORDER BY stars) AS k, count(*) OVER () AS n FROM v)
SELECT rid, round(k / n, 3) AS rank FROM repositories JOIN r USING (stars)""")
def w01_scaled_rank(t):
    return votes.scaled_rank(t["repositories"].select("rid", "stars"), "stars", "rank").select("rid", "rank")


@query(f""", m AS (SELECT pid, per, internal, count(*) OVER (PARTITION BY pid) AS n FROM authorship JOIN persons USING (per)),
e AS (SELECT a.per AS a, b.per AS b, count(*) AS w FROM m a JOIN m b ON a.pid = b.pid AND a.per < b.per WHERE a.n <= {HYPER} OR a.internal OR b.internal GROUP BY 1, 2),
s AS (SELECT a AS node, b AS other, w FROM e UNION ALL SELECT b, a, w FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, other) AS r FROM s)
SELECT DISTINCT least(node, other) AS a, greatest(node, other) AS b, w FROM k WHERE r <= 3""")
def w02_top_edges(t):
    return edges.top_edges(edges.coauthor_weights(t["authorship"], t["persons"].where("internal"), HYPER), 3)


@query("SELECT venue, pid, CAST(date AS VARCHAR) AS date FROM (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY date DESC, pid DESC) AS r FROM publications) WHERE r = 1")
def w03_latest_publication(t):
    return votes.latest_rows(t["publications"].select("venue", "pid", "date"), ["venue"], [F.col("date").desc(), F.col("pid").desc()]).withColumn("date", F.col("date").cast("string"))


@query(""", s AS (SELECT pid, did, count(*) AS c FROM authorship JOIN persons USING (per) GROUP BY 1, 2), m AS (SELECT pid, max(c) AS c FROM s GROUP BY pid)
SELECT pid, CASE WHEN count(*) = 1 THEN min(did) END AS did, count(*) > 1 AS ambiguous FROM s JOIN m USING (pid, c) GROUP BY pid""")
def w06_best_match(t):
    votes_ = t["authorship"].join(t["persons"], "per").groupBy("pid", "did").agg(F.count("*").alias("c"))
    return votes.best_match(votes_, "pid", "did", [F.col("c")])


@query("SELECT pid, CAST(date AS VARCHAR) AS date FROM publications ORDER BY coalesce(year(date), -1) DESC, pid LIMIT 50 OFFSET 50")
def o01_page(t):
    return votes.page(t["publications"].select("pid", "date"), [F.coalesce(F.year("date"), F.lit(-1)).desc(), F.col("pid")], 50, 1).withColumn("date", F.col("date").cast("string"))


@query("SELECT did, dname, c AS n FROM (SELECT did, count(*) AS c FROM pub_depts GROUP BY did) JOIN departments USING (did) ORDER BY c DESC, dname LIMIT 30")
def o11_largest_departments(t):
    return t["pub_depts"].groupBy("did").agg(F.count("*").alias("n")).join(t["departments"], "did").select("did", "dname", "n").orderBy(F.col("n").desc(), "dname").limit(30)


_ARRAYS = """, s AS (SELECT per, list_sort(list(DISTINCT did)) AS d FROM (SELECT per, p.did FROM authorship JOIN pub_depts p USING (pid)) GROUP BY per)
"""


@query(_ARRAYS + "SELECT a.per AS a, b.per AS b, round(len(list_intersect(a.d, b.d)) / len(list_distinct(a.d || b.d)), 6) AS likeness FROM s a JOIN persons x ON x.per = a.per JOIN persons y ON y.did = x.did AND y.per > x.per JOIN s b ON b.per = y.per")
def u06_jaccard(t):
    s, bits = votes.bit_sets(t["authorship"].join(t["pub_depts"], "pid").select("per", "did"), "per", "did")
    pairs = edges.member_pairs(t["persons"].join(s, "per"), "did", "per", None, bits)
    sides = ([F.col(f"{end}_{c}") for c in bits] for end in "ab")
    return pairs.select("a", "b", F.round(bits_jaccard(*sides), 6).alias("likeness"))


@query("""SELECT per AS a, pid AS b, CASE WHEN r.position IS NULL THEN 'delete' WHEN l.position IS NULL THEN 'create' ELSE 'update' END AS action FROM
(SELECT per, pid, position FROM authorship WHERE pid % 3 <> 0) l FULL JOIN (SELECT per, pid, CASE WHEN corresponding THEN 99 ELSE position END AS position FROM authorship WHERE pid % 3 <> 1) r USING (per, pid)
WHERE l.position IS DISTINCT FROM r.position""")
def u04_edge_diff(t):
    a = t["authorship"].select(F.col("per").alias("a"), F.col("pid").alias("b"), "position", "corresponding")
    live, desired = a.where("b % 3 <> 0"), a.where("b % 3 <> 1").withColumn("position", F.when(F.col("corresponding"), 99).otherwise(F.col("position")))
    return edges.sync_plan(live, desired, ["a", "b"], ["position"])


@query("""SELECT dname, count(*) FILTER (internal) AS inside, count(*) AS persons, CASE WHEN count(*) FILTER (internal) = 0 THEN 'none' WHEN 10 * count(*) FILTER (internal) < 9 * count(*) THEN 'some' ELSE 'most' END AS level
FROM persons JOIN departments USING (did) GROUP BY dname""")
def a21_ratio_status(t):
    x = t["persons"].join(F.broadcast(t["departments"]), "did").groupBy("dname").agg(F.count_if("internal").alias("inside"), F.count("*").alias("persons"))
    return x.withColumn("level", F.when(F.col("inside") == 0, "none").when(10 * F.col("inside") < 9 * F.col("persons"), "some").otherwise("most"))


@query("""SELECT per FROM (SELECT per, count(*) AS n FROM authorship GROUP BY per) WHERE n <= 600 AND per NOT IN (SELECT per FROM authorship JOIN repo_pubs USING (pid) WHERE rid % 1000 = 0)""")
def p27_isolated_authors(t):
    few = t["authorship"].groupBy("per").agg(F.count("*").alias("n")).where("n <= 600").select("per")
    return few.join(t["authorship"].join(t["repo_pubs"].where("rid % 1000 = 0"), "pid"), "per", "left_anti")


@query("SELECT rid FROM repositories WHERE rid IN (SELECT rid FROM repo_pubs) EXCEPT SELECT rid FROM repo_pubs JOIN publications USING (pid) WHERE type = 'O'")
def p25_third_party_repositories(t):
    mentioned = t["repositories"].select("rid").join(t["repo_pubs"], "rid", "left_semi")
    return mentioned.join(t["repo_pubs"].join(t["publications"].where("type = 'O'"), "pid"), "rid", "left_anti").distinct()


@query("SELECT p.per AS node, d.did AS other, true AS outgoing FROM persons p JOIN departments d USING (did) UNION ALL SELECT d.did, p.per, false FROM persons p JOIN departments d USING (did)")
def j32_neighbourhood(t):
    e = t["persons"].join(t["departments"], "did").select("per", "did")
    return e.select(F.col("per").alias("node"), F.col("did").cast("bigint").alias("other"), F.lit(True).alias("outgoing")).union(e.select(F.col("did").cast("bigint"), "per", F.lit(False)))


@query("SELECT d.did, dname, oname FROM departments d LEFT JOIN organizations USING (oid)")
def j31_parent_organization(t):
    return t["departments"].join(F.broadcast(t["organizations"]), "oid", "left").select("did", "dname", "oname")


@query("SELECT per, round(sum(w * x) / sum(w), 6) AS x FROM (SELECT per, count(*) AS w, p.did AS x FROM authorship JOIN pub_depts p USING (pid) GROUP BY per, p.did) GROUP BY per")
def a60_weighted_centroid(t):
    w = t["authorship"].join(t["pub_depts"], "pid").groupBy("per", "did").agg(F.count("*").alias("w"))
    return w.groupBy("per").agg(F.round(F.sum(F.col("w") * F.col("did")) / F.sum("w"), 6).alias("x"))


@query(""", f AS (SELECT per, title, count(*) AS c FROM authorship JOIN publications USING (pid) GROUP BY 1, 2)
SELECT per, string_agg(title, ',' ORDER BY c DESC, title) AS fields FROM (SELECT *, row_number() OVER (PARTITION BY per ORDER BY c DESC, title) AS r FROM f) WHERE r <= 3 GROUP BY per""")
def a54_researcher_context(t):
    f = t["authorship"].join(t["publications"], "pid").groupBy("per", "title").agg(F.count("*").alias("c"))
    top = f.withColumn("r", F.row_number().over(Window.partitionBy("per").orderBy(F.col("c").desc(), "title"))).where("r <= 3")
    return top.groupBy("per").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "title"))), lambda x: x["title"]), ",").alias("fields"))
