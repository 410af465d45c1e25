"""Whole stages, each a composition of operators: deduplication, versions, accounts, departments, membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import blocking, edges, folds, groups, history, review, votes
from quillgraph.plans.registry import graph_query, query


def publication_links(pubs: DataFrame) -> DataFrame:
    """Links (a, b) of publications (pid, doi, title): equal DOIs; equal titles where they have one DOI at most, else those without one."""
    by_doi = groups.key_links(pubs.where("doi <> ''"), "pid", "doi")
    known = pubs.where("title <> ''").withColumn("d", F.when(F.col("doi") != "", F.col("doi")))
    counted = known.groupBy("title").agg(F.count_distinct("d").alias("dois"))
    eligible = known.join(counted, "title").where((F.col("dois") <= 1) | F.col("d").isNull())
    return by_doi.union(groups.key_links(eligible, "pid", "title")).distinct()


def merge_publications(pubs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(folded publications, aliases (old, new)): components of the links, the best record of each survives."""
    found = groups.groups_of(publication_links(pubs))
    member = pubs.join(found, F.col("pid") == F.col("node"), "left").withColumn("group", F.coalesce("group", "pid"))
    rank = [F.when(F.col("type") == "F", 0).when(F.col("type") == "O", 1).otherwise(2), -F.unix_date("date"), F.col("pid")]
    best = member.groupBy("group").agg(F.min(F.struct(*[r.alias(f"r{k}") for k, r in enumerate(rank)])).alias("r")).select("group", F.col("r.r2").alias("survivor"))
    placed = member.join(best, "group")
    folded = folds.fold(placed, "survivor", rank, ["title", "doi", "type", "date"], ["sources"], [])
    return folded, placed.where("pid <> survivor").select(F.col("pid").alias("old"), F.col("survivor").alias("new"))


def _pubs(t):
    doi = F.when(F.col("pid") % 4 == 0, F.concat(F.lit("10."), F.col("venue"))).otherwise("")
    return t["publications"].select("pid", doi.alias("doi"), F.concat_ws("|", "venue", F.substring("title", 1, 1)).alias("title"), "type", "date", F.array("type").alias("sources"))


_PUBS = """, p AS (SELECT pid, CASE WHEN pid % 4 = 0 THEN '10.' || venue END AS doi, venue || '|' || substr(title, 1, 1) AS title, type, date FROM publications),
ok AS (SELECT p.* FROM p JOIN (SELECT title, count(DISTINCT doi) AS n FROM p GROUP BY title) USING (title) WHERE n <= 1 OR doi IS NULL),
k AS (SELECT pid, doi AS key FROM p WHERE doi IS NOT NULL UNION ALL SELECT pid, title FROM ok),
e AS (SELECT DISTINCT pid AS a, m AS b FROM (SELECT pid, min(pid) OVER (PARTITION BY key) AS m FROM k) WHERE pid <> m), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(node, r) AS (SELECT pid, pid FROM p UNION SELECT reach.node, both_.b FROM reach JOIN both_ ON reach.r = both_.a),
g AS (SELECT node AS pid, min(r) AS grp FROM reach GROUP BY node),
s AS (SELECT *, first_value(pid) OVER (PARTITION BY grp ORDER BY CASE type WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, date DESC, pid) AS survivor FROM g JOIN p USING (pid))
"""


@graph_query(_PUBS + "SELECT pid AS old, survivor AS new FROM s WHERE pid <> survivor")
def c08_publication_aliases(t):
    return merge_publications(_pubs(t))[1]


@graph_query(_PUBS + """SELECT DISTINCT per, coalesce(survivor, pid) AS pid, bool_or(corresponding) OVER (PARTITION BY per, coalesce(survivor, pid)) AS corresponding
FROM authorship LEFT JOIN s USING (pid)""")
def g06_fold_authorship(t):
    """Authorship moved to the surviving publications, edges of one pair as one."""
    moved = groups.repoint(t["authorship"].select("per", "pid", "corresponding", "position"), merge_publications(_pubs(t))[1], "pid")
    return edges.collapse(moved, ["per", "pid"], F.col("position"), [], ["corresponding"], [], [])


@query("""WITH m AS (SELECT c_custkey AS account, s_suppkey AS author, least(1.0, 0.5 + CASE WHEN c_nationkey = s_nationkey THEN 0.4 ELSE 0 END) AS score
FROM customer JOIN supplier ON regexp_extract(c_name, '([0-9]+)$', 1) = regexp_extract(s_name, '([0-9]+)$', 1)),
r AS (SELECT *, rank() OVER (PARTITION BY account ORDER BY score DESC) AS r FROM m)
SELECT account, CASE WHEN count(*) = 1 THEN min(author) END AS author, count(*) > 1 AS ambiguous FROM r WHERE r = 1 GROUP BY account""")
def c09_account_match(spark, sf_dir):
    """Accounts (customers) matched with authors (suppliers) by three signals; a shared best score is left for review."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    number = F.regexp_extract("name", r"(\d+)$", 1)
    accounts = c.select(F.col("c_custkey").alias("account"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).withColumn("n", number)
    authors = s.select(F.col("s_suppkey").alias("author"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("anation")).withColumn("an", number)
    same_number = accounts.join(authors.select("author", "anation", "an"), F.col("n") == F.col("an"))
    score = F.least(F.lit(1.0), 0.5 + F.when(F.col("nation") == F.col("anation"), 0.4).otherwise(0.0))
    return votes.best_match(same_number.withColumn("score", score).where("score >= 0.5"), "account", "author", [F.col("score")])


@graph_query("""SELECT per, string_agg(DISTINCT did::VARCHAR, ',' ORDER BY did::VARCHAR) AS dids FROM (SELECT per, did FROM persons UNION SELECT per, d.did FROM authorship JOIN pub_depts d USING (pid) WHERE position = 1) GROUP BY per""")
def c02_departments(t):
    found = t["authorship"].where("position = 1").join(t["pub_depts"], "pid").select("per", "did")
    return t["persons"].select("per", "did").union(found).groupBy("per").agg(F.array_join(F.array_sort(F.collect_set(F.col("did").cast("string"))), ",").alias("dids"))


@graph_query(""", x AS (SELECT a.pid AS a, b.pid AS b, a.type AS ta, b.type AS tb, abs(a.date - b.date) AS gap FROM publications a JOIN publications b ON a.venue = b.venue AND a.title = b.title AND a.pid < b.pid)
SELECT CASE WHEN ta = 'F' AND tb <> 'F' THEN b ELSE a END AS version, CASE WHEN ta = 'F' AND tb <> 'F' THEN a ELSE b END AS work,
CASE WHEN gap <= 30 THEN 'SAME' WHEN ta <> tb THEN 'CONFERENCE_JOURNAL' WHEN gap <= 365 THEN 'RELATED' ELSE 'DIFFERENT' END AS bucket FROM x""")
def c13_version_edges(t):
    p = t["publications"].withColumn("day", F.unix_date("date"))
    pairs = blocking.channel_pairs(p, "pid", {"title": (F.concat_ws("|", "venue", "title"), None)})
    x = blocking.with_sides(pairs, p, "pid", ["type", "day"])
    gap = F.abs(F.col("a_day") - F.col("b_day"))
    bucket = blocking.first_rule([("SAME", gap <= 30), ("CONFERENCE_JOURNAL", F.col("a_type") != F.col("b_type")), ("RELATED", gap <= 365)], "DIFFERENT")
    turned = (F.col("a_type") == "F") & (F.col("b_type") != "F")
    return x.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("version"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("work"), bucket.alias("bucket"))


@graph_query("""SELECT per, CASE WHEN count(*) FILTER (corresponding) > 0 THEN true WHEN count(*) = count(DISTINCT CASE WHEN year IS NOT NULL THEN a.pid END) AND count(*) < 600 THEN false ELSE internal END AS inside
FROM authorship a JOIN publications USING (pid) JOIN persons USING (per) GROUP BY per, internal""")
def c15_membership(t):
    seen = t["authorship"].join(t["publications"].select("pid", "year"), "pid").groupBy("per").agg(F.bool_or("corresponding").alias("e"), ((F.count("*") == F.count_distinct(F.when(F.col("year").isNotNull(), F.col("pid")))) & (F.count("*") < 600)).alias("c"))
    return t["persons"].join(seen, "per").select("per", folds.supported(F.col("e"), F.col("c"), F.col("internal")).alias("inside"))


@query("""WITH q AS (SELECT user_id AS question, min(ts) AS seen_at, arg_min(event_type, ts) AS kind FROM events GROUP BY user_id), a AS (SELECT DISTINCT user_id AS question FROM events WHERE event_type = 'purchase' AND value > 90)
SELECT question, kind FROM q WHERE question NOT IN (SELECT question FROM a) AND kind IN ('view', 'click', 'error') ORDER BY seen_at, question""")
def p21_review_queue(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    q = e.groupBy(F.col("user_id").alias("question")).agg(F.min("ts").alias("seen_at"), F.min_by("event_type", "ts").alias("kind"))
    answers = e.where("event_type = 'purchase' AND value > 90").select(F.col("user_id").alias("question"))
    return review.queue(q, answers, "question", True, ["view", "click", "error"]).select("question", "kind")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY user_id")
def i16_last_state(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return review.last_state(e.withColumn("state", F.col("event_type")), "user_id", ["ts", "event_id"], "state")


@query("SELECT user_id, arg_max(event_type = 'error', (ts, event_id)) AS gone FROM events GROUP BY user_id")
def a55_deleted(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("kind", F.when(F.col("event_type") == "error", "deleted").otherwise("updated"))
    return review.deleted(e, "user_id", ["ts", "event_id"])


@graph_query("""SELECT per AS a, pid AS b, sha256('{"w":' || position || '}') AS token FROM authorship WHERE per < pid AND corresponding AND position > 2 AND NOT (position = 3 AND pid % 2 = 0)""")
def i29_disputes(t):
    x = t["authorship"].where("per < pid").select(F.col("per").alias("a"), F.col("pid").alias("b"), F.struct(F.col("position").alias("w")).alias("evidence"), "corresponding", "position")
    answers = x.select("a", "b", F.when(F.col("corresponding"), "different").otherwise("same").alias("verdict"))
    seen = x.where("position = 3 AND b % 2 = 0").select("a", "b", F.sha2(F.to_json("evidence"), 256).alias("token"))
    return review.disputes(answers, x.where("position > 2").select("a", "b", "evidence"), ["a", "b"], seen)


@graph_query(""", c AS (SELECT DISTINCT owner FROM repositories WHERE stars > 45), o AS (SELECT pid, min(owner) AS low, max(owner) AS high, count(DISTINCT owner) AS n FROM repo_pubs JOIN repositories USING (rid) GROUP BY pid)
SELECT pid, n, CASE WHEN n = 1 THEN 'unique' WHEN low IN (SELECT owner FROM c) OR high IN (SELECT owner FROM c) THEN 'resolvable' ELSE 'blocking' END AS plan FROM o""")
def g26_migration_plan(t):
    """Who owns a component: one owner, several of which a rule settles, or several that block."""
    strong = t["repositories"].where("stars > 45").select("owner").distinct().withColumn("s", F.lit(True))
    o = t["repo_pubs"].join(t["repositories"], "rid").groupBy("pid").agg(F.min("owner").alias("low"), F.max("owner").alias("high"), F.count_distinct("owner").alias("n"))
    x = o.join(strong.select(F.col("owner").alias("low"), F.col("s").alias("s1")), "low", "left").join(strong.select(F.col("owner").alias("high"), F.col("s").alias("s2")), "high", "left")
    return x.select("pid", "n", blocking.first_rule([("unique", F.col("n") == 1), ("resolvable", F.col("s1") | F.col("s2"))], "blocking").alias("plan"))


@graph_query("SELECT venue, pid AS version, title FROM publications WHERE (venue, date, pid) NOT IN (SELECT (venue, date, pid) FROM (SELECT venue, date, pid, row_number() OVER (PARTITION BY venue ORDER BY date DESC, pid DESC) AS r FROM publications) WHERE r = 1)")
def s41_earlier_versions(t):
    p = t["publications"].select("venue", "pid", "title", "date")
    last = votes.latest_rows(p, ["venue"], [F.col("date").desc(), F.col("pid").desc()])
    return p.join(last.select("pid"), "pid", "left_anti").select("venue", F.col("pid").alias("version"), "title")


@graph_query("SELECT pid, title FROM publications WHERE pid % 5 <> 0 UNION ALL SELECT pid, 'gone' FROM publications WHERE pid % 5 = 0 AND pid % 2 = 0")
def i18_overlay(t):
    """A run's own values laid over independent ones, and taken back where it no longer finds them."""
    base = t["publications"].where("pid % 5 <> 0 OR pid % 2 = 0").withColumn("title", F.when(F.col("pid") % 5 != 0, F.col("title"))).select("pid", "title")
    laid = base.where("pid % 5 = 0").select("pid", F.lit("gone").alias("value"))
    return history.with_overrides(base, laid, "pid", "title").select("pid", "title")
