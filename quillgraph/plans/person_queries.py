"""Persons, accounts and identities: candidate channels, vetoes, scores, merge plans, claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import text
from quillgraph.operators import edges, groups, history
from quillgraph.plans.derived import derived_query

# Channels of candidates.


@derived_query(""", ks AS (SELECT per, unnest(['orcid:' || orcid, 'name:' || lower(latin) || ' ' || lower(given), 'key:' || key]) AS k FROM people)
SELECT a, b, string_agg(c, ',' ORDER BY c) AS channels FROM (SELECT DISTINCT f.per AS a, x.per AS b, split_part(k, ':', 1) AS c FROM ks x JOIN (SELECT k, min(per) AS per FROM ks WHERE k IS NOT NULL GROUP BY k) f USING (k) WHERE f.per < x.per) GROUP BY a, b""")
def j16_j08_identifier_channels(t):
    """Persons linked by an equal identifier, with the channels that link them; a chain for each identifier, never all pairs."""
    channels = {"orcid": F.col("orcid"), "name": F.lower("latin") + F.lit(""), "key": F.col("key")}
    channels["name"] = F.when(F.col("latin").isNotNull() & F.col("given").isNotNull(), F.concat_ws(" ", F.lower("latin"), F.lower("given")))
    out = None
    for name, c in channels.items():
        part = groups.key_links(t["people"].select("per", c.alias("k")), "per", "k").withColumn("c", F.lit(name))
        out = part if out is None else out.union(part)
    return out.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set("c")), ",").alias("channels"))


@derived_query(""", small AS (SELECT pid FROM wrote GROUP BY pid HAVING count(*) <= 4)
SELECT DISTINCT a.per AS a, b.per AS b FROM wrote x JOIN wrote y USING (pid) JOIN people a ON a.per = x.per JOIN people b ON b.per = y.per WHERE a.per < b.per AND pid IN (SELECT pid FROM small) AND substr(a.latin, 1, 1) = substr(b.latin, 1, 1)""")
def j17_context_rescue(t):
    """Persons with one initial who met on a work of a small team."""
    small = t["wrote"].groupBy("pid").agg(F.count("*").alias("n")).where("n <= 4").select("pid")
    w = t["wrote"].select("pid", "per").join(small, "pid").join(t["people"].select("per", F.substring("latin", 1, 1).alias("i")).where("i IS NOT NULL"), "per")
    a, b = w.select("pid", "i", F.col("per").alias("a")), w.select("pid", "i", F.col("per").alias("b"))
    return a.join(b, ["pid", "i"]).where("a < b").select("a", "b").distinct()


@derived_query(""", acc AS (SELECT DISTINCT lower(owner) AS login, rid FROM code WHERE owner IS NOT NULL), br AS (SELECT DISTINCT login, per FROM acc JOIN repo_pubs USING (rid) JOIN authorship USING (pid)),
em AS (SELECT a.login, per FROM (SELECT DISTINCT login FROM acc) a JOIN people ON 'brand#' || (per % 60)::VARCHAR = a.login)
SELECT login, per, string_agg(c, ',' ORDER BY c) AS channels FROM (SELECT login, per, 'bridge' AS c FROM br UNION SELECT login, per, 'confirmed' FROM em) GROUP BY login, per""")
def j18_account_candidates(t):
    """Accounts and authors met through a publication of an account's repository, or confirmed before."""
    accounts = t["code"].where("owner IS NOT NULL").select(F.lower("owner").alias("login"), "rid")
    bridge = accounts.join(t["repo_pubs"], "rid").join(t["authorship"].select("pid", "per"), "pid").select("login", "per").distinct()
    confirmed = t["people"].select(F.concat(F.lit("brand#"), (F.col("per") % 60).cast("string")).alias("login"), "per").join(accounts.select("login").distinct(), "login", "left_semi")
    both = bridge.withColumn("c", F.lit("bridge")).union(confirmed.select("login", "per", F.lit("confirmed")))
    return both.groupBy("login", "per").agg(F.array_join(F.array_sort(F.collect_set("c")), ",").alias("channels"))


@derived_query(""", o AS (SELECT DISTINCT e.email, p.latin FROM (SELECT DISTINCT email FROM people WHERE email IS NOT NULL) e JOIN (SELECT DISTINCT latin FROM people WHERE length(latin) >= 4) p ON contains(split_part(e.email, '@', 1), lower(p.latin)))
SELECT email, min(latin) AS surname FROM o GROUP BY email HAVING count(*) = 1""")
def j19_email_owner(t):
    """The one surname that an address carries; windows of its local part meet surnames by equality, not by a scan of all."""
    surnames = t["people"].where(F.length("latin") >= 4).select(F.lower("latin").alias("s"), F.col("latin").alias("surname")).distinct()
    mails = t["people"].where("email IS NOT NULL").select("email").distinct().withColumn("l", F.substring_index("email", "@", 1))
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), F.length("l")), lambda i: F.transform(F.sequence(F.lit(1), F.length("l") - i + 1), lambda n: F.substring(F.col("l"), i, n))))
    windows = mails.select("email", F.explode(F.array_distinct(F.filter(cuts, lambda w: F.length(w) >= 4))).alias("s"))
    return windows.join(surnames, "s").groupBy("email").agg(F.min("surname").alias("surname"), F.count_distinct("surname").alias("n")).where("n = 1").select("email", "surname")


@derived_query("SELECT did, count(*) AS n FROM people WHERE did IN (SELECT did FROM units WHERE variants IS NOT NULL) GROUP BY did")
def j02_j04_known_departments(t):
    """Memberships whose department exists, by a broadcast of the department list."""
    known = t["units"].where("variants IS NOT NULL").select("did")
    return t["people"].join(F.broadcast(known), "did", "left_semi").groupBy("did").agg(F.count("*").alias("n"))


@derived_query("SELECT pid, url FROM links WHERE relevant AND lower(url) NOT IN (SELECT lower(rtrim(url, '/')) FROM code)")
def j07_links_without_repository(t):
    known = t["code"].select(F.lower(F.regexp_replace("url", "/+$", "")).alias("u"))
    return t["links"].where("relevant").withColumn("u", F.lower("url")).join(known, "u", "left_anti").select("pid", "url")


@derived_query(""", big AS (SELECT pid, count(*) > 5 AS hyper FROM wrote GROUP BY pid)
SELECT x.per AS a, y.per AS b, count(*) AS n FROM wrote x JOIN wrote y USING (pid) JOIN big USING (pid) JOIN people p ON p.per = x.per JOIN people q ON q.per = y.per WHERE x.per < y.per AND (NOT hyper OR p.internal OR q.internal) GROUP BY 1, 2""")
def j10_j09_coauthor_pairs(t):
    """Coauthors; of a work with very many only pairs with a member of staff."""
    hyper = t["wrote"].groupBy("pid").agg((F.count("*") > 5).alias("hyper"))
    w = t["wrote"].select("pid", "per").join(t["people"].select("per", "internal"), "per").join(hyper, "pid")
    a, b = w.select("pid", "hyper", F.col("per").alias("a"), F.col("internal").alias("i")), w.select("pid", F.col("per").alias("b"), F.col("internal").alias("j"))
    return a.join(b, "pid").where("a < b AND (NOT hyper OR i OR j)").groupBy("a", "b").agg(F.count("*").alias("n"))


@derived_query("SELECT pid, per FROM wrote WHERE per % 9 = 0")
def j30_unmatched_ends(t):
    """Edges whose end is not materialised."""
    return edges.attach(t["wrote"].select("pid", "per"), t["works"].select("pid"), t["people"].where("per % 9 <> 0").select("per"), "pid", "per")[1].select("pid", "per")


@derived_query(""", al AS (SELECT per AS old, per - per % 5 AS new FROM people WHERE per % 5 <> 0 AND per > 5), lv AS (SELECT DISTINCT pid, per FROM wrote WHERE pid % 3 <> 0),
ds AS (SELECT DISTINCT pid, coalesce(new, per) AS per FROM wrote LEFT JOIN al ON old = per WHERE pid % 4 <> 0), lc AS (SELECT DISTINCT pid, coalesce(new, per) AS per FROM lv LEFT JOIN al ON old = per)
SELECT coalesce(ds.pid, lc.pid) AS pid, coalesce(ds.per, lc.per) AS per, CASE WHEN lc.pid IS NULL THEN 'create' ELSE 'delete' END AS action FROM ds FULL JOIN lc ON ds.pid = lc.pid AND ds.per = lc.per WHERE ds.pid IS NULL OR lc.pid IS NULL""")
def j29_live_against_desired(t):
    """Live and desired edges, both led through the fold's aliases before they are compared."""
    aliases = t["people"].where("per % 5 <> 0 AND per > 5").select(F.col("per").alias("old"), (F.col("per") - F.col("per") % 5).alias("new"))
    e = t["wrote"].select("pid", "per")
    live, wanted = (groups.repoint(x, aliases, "per").distinct().withColumn("p", F.lit(1)) for x in (e.where("pid % 3 <> 0"), e.where("pid % 4 <> 0")))
    return edges.sync_plan(live, wanted, ["pid", "per"], ["p"])


# Names and accounts.


@derived_query("SELECT per, CASE WHEN regexp_full_match(latin, '[A-Za-z]{4,}') THEN lower(latin) END AS surname FROM people")
def f41_author_surname(t):
    word = F.regexp_extract(F.col("latin"), r"([A-Za-z]{4,})[^A-Za-z]*$", 1)
    return t["people"].select("per", F.when(word != "", F.lower(word)).alias("surname"))


@derived_query("""SELECT a.per AS a, b.per AS b, coalesce(lower(substr(a.given, 1, 1)) <> lower(substr(b.given, 1, 1)), false) AS veto FROM people a JOIN people b ON b.per = a.per + 1 WHERE coalesce(a.given, 'x') <> '' AND coalesce(b.given, 'x') <> ''""")
def f19_initials_veto(t):
    """Whether two given names begin with different letters; an unknown one vetoes nothing."""
    p = t["people"].where("coalesce(given, 'x') <> ''")
    b = p.select((F.col("per") - 1).alias("per"), F.lower(F.substring("given", 1, 1)).alias("ib"), F.col("per").alias("b"))
    return p.select("per", F.lower(F.substring("given", 1, 1)).alias("ia")).join(b, "per").select(F.col("per").alias("a"), "b", F.coalesce(F.col("ia") != F.col("ib"), F.lit(False)).alias("veto"))


@derived_query(""", f AS (SELECT a.per AS a, b.per AS b, coalesce(a.email = b.email, false) AS mail, coalesce(lower(a.latin) = lower(b.latin), false) AS surname, coalesce(a.given = b.given, false) AS given, coalesce(a.did = b.did, false) AS unit FROM people a JOIN people b ON b.per = a.per + 7)
, s AS (SELECT a, b, least(1.0, CASE WHEN mail THEN 0.6 ELSE 0 END + CASE WHEN surname THEN 0.35 ELSE 0 END + CASE WHEN given THEN 0.2 ELSE 0 END + CASE WHEN unit THEN 0.1 ELSE 0 END) AS score, mail FROM f)
SELECT a, b, round(score, 6)::DOUBLE AS score, CASE WHEN score >= 0.9 AND mail THEN 'accept' WHEN score >= 0.5 THEN 'hold' ELSE 'reject' END AS decision, CASE WHEN score >= 0.5 AND NOT (score >= 0.9 AND mail) THEN CASE WHEN mail THEN 'weak_name' ELSE 'no_address' END END AS reason FROM s""")
def f44_f45_account_scores(t):
    """Weighted signals, capped at 1; what is neither certain nor unlikely is held, with a reason."""
    p = t["people"].select("per", "email", F.lower("latin").alias("latin"), "given", "did")
    b = p.select((F.col("per") - 7).alias("per"), *[F.col(c).alias(f"{c}_b") for c in p.columns])
    same = lambda c: F.coalesce(F.col(c) == F.col(f"{c}_b"), F.lit(False))
    weights = {"email": 0.6, "latin": 0.35, "given": 0.2, "did": 0.1}
    score = F.round(F.least(F.lit(1.0), sum((F.when(same(c), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))), 6)
    scored = p.join(b, "per").select(F.col("per").alias("a"), F.col("per_b").alias("b"), score.alias("score"), same("email").alias("mail"))
    sure = (F.col("score") >= 0.9) & F.col("mail")
    decision = F.when(sure, "accept").when(F.col("score") >= 0.5, "hold").otherwise("reject")
    reason = F.when(decision == "hold", F.when(F.col("mail"), "weak_name").otherwise("no_address"))
    return scored.select("a", "b", "score", decision.alias("decision"), reason.alias("reason"))


_FEATURES = """, co AS (SELECT DISTINCT x.per AS per, y.per AS other FROM wrote x JOIN wrote y USING (pid) WHERE x.per <> y.per), wk AS (SELECT per, count(*) AS n FROM wrote GROUP BY per),
pr AS (SELECT a.per AS a, b.per AS b, a.orcid AS oa, b.orcid AS ob, a.latin AS la, b.latin AS lb, a.given AS ga, b.given AS gb, a.did AS da, b.did AS db FROM people a JOIN people b ON b.per = a.per + 7),
ft AS (SELECT a, b, CASE WHEN oa = ob THEN 'same' WHEN oa <> ob THEN 'conflict' WHEN oa IS NULL AND ob IS NULL THEN 'both_missing' ELSE 'one_missing' END AS orcid, coalesce(la = lb, false) AS same_surname,
coalesce(substr(ga, 1, 1) = substr(gb, 1, 1), false) AS same_initial, coalesce(da = db, false) AS same_unit, (SELECT count(*) FROM co x JOIN co y USING (other) WHERE x.per = a AND y.per = b) AS shared_coauthors,
(SELECT count(*) FROM wrote x JOIN wrote y USING (pid) WHERE x.per = a AND y.per = b) AS joint_works, coalesce(least(wa.n, wb.n), 0) AS works_min, round(coalesce(least(wa.n, wb.n) / greatest(wa.n, wb.n), 0), 6)::DOUBLE AS works_ratio
FROM pr LEFT JOIN wk wa ON wa.per = a LEFT JOIN wk wb ON wb.per = b)
"""


def _features(t):
    """Evidence about candidate pairs, each counted by a join on the shared key."""
    p = t["people"].select("per", "orcid", "latin", "given", "did")
    pairs = p.select(F.col("per").alias("a"), *[F.col(c).alias(f"{c}_a") for c in p.columns[1:]], (F.col("per") + 7).alias("b")).join(p.select(F.col("per").alias("b"), *[F.col(c).alias(f"{c}_b") for c in p.columns[1:]]), "b")
    w = t["wrote"].select("pid", "per")
    co = w.join(w.select("pid", F.col("per").alias("other")), "pid").where("per <> other").select("per", "other").distinct()
    ab = pairs.select("a", "b")
    shared = ab.join(co.select(F.col("per").alias("a"), "other"), "a").join(co.select(F.col("per").alias("b"), "other"), ["b", "other"]).groupBy("a", "b").agg(F.count("*").alias("shared_coauthors"))
    joint = ab.join(w.select("pid", F.col("per").alias("a")), "a").join(w.select("pid", F.col("per").alias("b")), ["b", "pid"]).groupBy("a", "b").agg(F.count("*").alias("joint_works"))
    n = w.groupBy("per").agg(F.count("*").alias("n"))
    out = pairs.join(shared, ["a", "b"], "left").join(joint, ["a", "b"], "left").join(n.select(F.col("per").alias("a"), F.col("n").alias("na")), "a", "left").join(n.select(F.col("per").alias("b"), F.col("n").alias("nb")), "b", "left")
    same = lambda x, y: F.coalesce(x == y, F.lit(False))
    c = F.col
    orcid = F.when(c("orcid_a") == c("orcid_b"), "same").when(c("orcid_a") != c("orcid_b"), "conflict").when(c("orcid_a").isNull() & c("orcid_b").isNull(), "both_missing").otherwise("one_missing")
    both = c("na").isNotNull() & c("nb").isNotNull()
    return out.select(
        "a", "b", orcid.alias("orcid"), same(c("latin_a"), c("latin_b")).alias("same_surname"), same(F.substring("given_a", 1, 1), F.substring("given_b", 1, 1)).alias("same_initial"),
        same(c("did_a"), c("did_b")).alias("same_unit"), F.coalesce("shared_coauthors", F.lit(0)).alias("shared_coauthors"), F.coalesce("joint_works", F.lit(0)).alias("joint_works"),
        F.when(both, F.least("na", "nb")).otherwise(F.coalesce("na", "nb", F.lit(0))).alias("works_min"), F.round(F.when(both, F.least("na", "nb") / F.greatest("na", "nb")).otherwise(F.when(F.coalesce("na", "nb").isNull(), 0.0).otherwise(1.0)), 6).alias("works_ratio"),
    )


@derived_query(_FEATURES + "SELECT * FROM ft")
def f46_pair_features(t):
    return _features(t)


_ZONES = _FEATURES + """, zn AS (SELECT a, b, CASE WHEN orcid = 'conflict' THEN 'veto_orcid' WHEN NOT same_initial THEN 'veto_initials' WHEN joint_works > 2 THEN 'veto_joint_works' END AS veto,
1 / (1 + exp(-(-2.0 + CASE WHEN same_surname THEN 3.0 ELSE 0 END + CASE WHEN orcid = 'same' THEN 4.0 ELSE 0 END + CASE WHEN same_unit THEN 0.5 ELSE 0 END + 0.1 * least(shared_coauthors, 10)))) AS p FROM ft),
z2 AS (SELECT a, b, veto, p, CASE WHEN veto IS NOT NULL THEN 'separate' WHEN p >= 0.94 THEN 'merge' WHEN p <= 0.13 THEN 'separate' ELSE 'review' END AS zone FROM zn)
"""


def _zones(t):
    c = F.col
    yes = lambda x, w: F.when(x, w).otherwise(0.0)
    z = F.lit(-2.0) + yes(c("same_surname"), 3.0) + yes(c("orcid") == "same", 4.0) + yes(c("same_unit"), 0.5) + 0.1 * F.least("shared_coauthors", F.lit(10))
    veto = F.when(c("orcid") == "conflict", "veto_orcid").when(~c("same_initial"), "veto_initials").when(c("joint_works") > 2, "veto_joint_works")
    scored = _features(t).select("a", "b", veto.alias("veto"), (1 / (1 + F.exp(-z))).alias("p"))
    return scored.withColumn("zone", F.when(c("veto").isNotNull(), "separate").otherwise(text.zone(c("p"), 0.13, 0.94)))


@derived_query(_ZONES + "SELECT a, b, veto, round(p, 6) AS p, zone FROM z2")
def f50_vetoes_and_zones(t):
    """Vetoes come first; then a probability falls into one of three zones."""
    return _zones(t).withColumn("p", F.round("p", 6))


@derived_query(_ZONES + """SELECT a, b, CASE WHEN zone = 'review' THEN CASE a % 3 WHEN 0 THEN 'merge' WHEN 1 THEN 'separate' ELSE 'hold' END ELSE zone END AS decision, CASE WHEN zone <> 'review' THEN 'model' WHEN a % 3 = 2 THEN 'none' ELSE 'judge' END AS route FROM z2""")
def i20_i19_merge_plan(t):
    """Pairs the model decides, pairs a verdict table decides, and pairs that are held because it has no verdict."""
    verdicts = t["people"].where("per % 3 < 2").select(F.col("per").alias("a"), F.when(F.col("per") % 3 == 0, "merge").otherwise("separate").alias("verdict"))
    planned = _zones(t).join(verdicts, "a", "left")
    review = F.col("zone") == "review"
    return planned.select("a", "b", F.when(review, F.coalesce("verdict", F.lit("hold"))).otherwise(F.col("zone")).alias("decision"), F.when(~review, "model").when(F.col("verdict").isNull(), "none").otherwise("judge").alias("route"))


# Identities and claims.


@derived_query("SELECT pid, CASE WHEN pid % 3 = 0 THEN 1 WHEN pid % 2 = 0 THEN 5 ELSE 2 END AS owner FROM works")
def i02_conditional_reassign(t):
    """A key goes to its new owner only if its present one is the expected."""
    owner = F.when(F.col("pid") % 2 == 0, 1).otherwise(2)
    expected = F.when(F.col("pid") % 3 != 0, 1).otherwise(9)
    claimed = t["works"].select("pid", F.when(F.col("pid") % 3 == 0, 1).otherwise(owner).alias("owner"), expected.alias("expected"))
    return claimed.select("pid", F.when(F.col("owner") == F.col("expected"), 5).otherwise(F.col("owner")).alias("owner"))


@derived_query(""", so AS (SELECT pid, pid % 5 AS owner FROM works WHERE pid % 2 = 0), dk AS (SELECT doi, min(pid) % 5 AS owner FROM works WHERE doi IS NOT NULL AND pid % 8 <> 4 GROUP BY doi)
SELECT pid, CASE WHEN so.owner IS NOT NULL AND dk.owner IS NOT NULL AND so.owner <> dk.owner THEN NULL ELSE coalesce(so.owner, dk.owner) END AS owner,
CASE WHEN so.owner <> dk.owner THEN 'conflict' WHEN coalesce(so.owner, dk.owner) IS NULL THEN 'new' ELSE 'known' END AS state FROM works LEFT JOIN so USING (pid) LEFT JOIN dk USING (doi)""")
def i03_i06_publication_identity(t):
    """The owner by the source's key and by the DOI; where they differ the row is quarantined."""
    w = t["works"].select("pid", "doi")
    source = w.where("pid % 2 = 0").select("pid", (F.col("pid") % 5).alias("s"))
    dois = w.where("doi IS NOT NULL AND pid % 8 <> 4").groupBy("doi").agg((F.min("pid") % 5).alias("d"))
    both = w.join(source, "pid", "left").join(dois, "doi", "left")
    differ = F.coalesce(F.col("s") != F.col("d"), F.lit(False))
    state = F.when(differ, "conflict").when(F.coalesce("s", "d").isNull(), "new").otherwise("known")
    return both.select("pid", F.when(~differ, F.coalesce("s", "d")).alias("owner"), state.alias("state"))


@derived_query("SELECT doi, arg_min(pid, (type <> 'F', -cents, pid)) AS owner FROM works WHERE doi IS NOT NULL GROUP BY doi")
def i04_doi_ranking(t):
    rank = F.struct(F.col("type") != "F", -F.col("cents"), F.col("pid"))
    return t["works"].where("doi IS NOT NULL").groupBy("doi").agg(F.min_by("pid", rank).alias("owner"))


@derived_query("SELECT pid FROM works WHERE pid % 3 = 0 OR pid % 2 = 0")
def i08_newer_snapshots(t):
    """Incoming snapshots that are not older than what is stored."""
    w = t["works"].select("pid", F.col("year").alias("at"))
    stored = w.where("pid % 3 <> 0").withColumn("at", F.expr("if(pid % 2 = 0, at - 1, at)"))
    return history.fresher(stored, w, "pid", "at").select("pid")


@derived_query(""", ok AS (SELECT pid FROM works WHERE pid % 3 <> 0) SELECT pid, per, CASE WHEN per % 4 = 0 AND pid IN (SELECT pid FROM ok) THEN 'retired' ELSE 'live' END AS state FROM wrote""")
def i09_i10_reconcile_slots(t):
    """Claims that a later response lacks are retired, but only where the response was complete."""
    new = t["wrote"].where("per % 4 <> 0").select("pid", "per", F.lit(True).alias("again"))
    complete = t["works"].where("pid % 3 <> 0").select("pid", F.lit(True).alias("complete"))
    joined = t["wrote"].join(new, ["pid", "per"], "left").join(complete, "pid", "left")
    return joined.select("pid", "per", F.when(F.col("again").isNull() & F.col("complete"), "retired").otherwise("live").alias("state"))


@derived_query("SELECT DISTINCT least(x.pid, y.pid) AS a, greatest(x.pid, y.pid) AS b FROM works x JOIN works y ON x.title = y.title AND x.venue = y.venue AND x.pid < y.pid WHERE x.doi IS NULL AND y.doi IS NULL AND EXISTS (SELECT 1 FROM wrote u JOIN wrote v USING (per) WHERE u.pid = x.pid AND v.pid = y.pid)")
def i11_title_review_pairs(t):
    """Works without a DOI that share a title, a venue and an author: the author is part of the join key, so a common title alone pairs nothing."""
    w = t["works"].where("doi IS NULL").select("pid", "title", "venue").join(t["wrote"].select("pid", "per"), "pid")
    a, b = w.withColumnRenamed("pid", "a"), w.withColumnRenamed("pid", "b")
    return a.join(b, ["title", "venue", "per"]).where("a < b").select("a", "b").distinct()


@derived_query("""SELECT 'doi' AS kind, doi AS key, pid AS owner FROM works WHERE doi IS NOT NULL UNION ALL SELECT 'source', 'w' || pid, pid FROM works UNION ALL SELECT 'title', lower(title) || '|' || year, pid FROM works WHERE doi IS NULL""")
def i12_legacy_keys(t):
    kinds = F.array(F.struct(F.lit("doi").alias("kind"), F.col("doi").alias("key")), F.struct(F.lit("source").alias("kind"), F.concat(F.lit("w"), F.col("pid").cast("string")).alias("key")), F.struct(F.lit("title").alias("kind"), F.when(F.col("doi").isNull(), F.concat_ws("|", F.lower("title"), F.col("year").cast("string"))).alias("key")))
    return t["works"].select(F.explode(kinds).alias("k"), F.col("pid").alias("owner")).select("k.kind", "k.key", "owner").where("key IS NOT NULL")


@derived_query("""SELECT per AS a, CASE WHEN per % 5 = 0 THEN 'disputed' WHEN per % 4 = 0 THEN 'separate' ELSE 'held' END AS state FROM people WHERE per % 2 = 0""")
def i14_review_states(t):
    """Open questions: disputed if answers differ, separate if all answers say so, else held."""
    answers = t["people"].where("per % 5 = 0").select("per", F.explode(F.array(F.lit("same"), F.lit("separate"))).alias("v")).union(t["people"].where("per % 4 = 0").select("per", F.lit("separate")))
    said = answers.groupBy("per").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    state = F.when(F.col("low") != F.col("high"), "disputed").when(F.col("high") == "separate", "separate").otherwise("held")
    return t["people"].where("per % 2 = 0").join(said, "per", "left").select(F.col("per").alias("a"), state.alias("state"))


@derived_query(""", tb AS (SELECT title, venue, count(DISTINCT doi) AS k FROM works GROUP BY 1, 2)
SELECT 'doi:' || doi AS bucket, pid FROM works WHERE doi IS NOT NULL UNION ALL SELECT 'title:' || title || '|' || venue, pid FROM works JOIN tb USING (title, venue) WHERE k <= 1 OR doi IS NULL""")
def i22_dedup_buckets(t):
    """A DOI's bucket; a title's only takes rows with a DOI if all of them have the same."""
    w = t["works"].select("pid", "doi", "title", "venue")
    k = w.groupBy("title", "venue").agg(F.count_distinct("doi").alias("k"))
    titled = w.join(k, ["title", "venue"]).where("k <= 1 OR doi IS NULL")
    name = F.concat(F.lit("title:"), F.col("title"), F.lit("|"), F.col("venue").cast("string"))
    return w.where("doi IS NOT NULL").select(F.concat(F.lit("doi:"), "doi").alias("bucket"), "pid").union(titled.select(name, "pid"))


@derived_query(""", k AS (SELECT rid, 'u' || lower(rtrim(url, '/')) AS k FROM code UNION ALL SELECT rid, 'g' || (rid // 3) FROM code WHERE rid % 3 <> 1)
SELECT f AS a, rid AS b FROM (SELECT rid, min(rid) OVER (PARTITION BY k) AS f FROM k) WHERE f < rid GROUP BY 1, 2""")
def i23_repository_keys(t):
    """Repositories linked by their address or by their host's id."""
    address = t["code"].select("rid", F.concat(F.lit("u"), F.lower(F.regexp_replace("url", "/+$", ""))).alias("k"))
    host = t["code"].where("rid % 3 <> 1").select("rid", F.concat(F.lit("g"), F.expr("rid div 3").cast("string")))
    return groups.key_links(address.union(host), "rid", "k")


@derived_query("SELECT rid, CASE WHEN url NOT LIKE 'https://%' THEN 'bad_url' WHEN owner IS NULL THEN 'no_owner' WHEN rid IN (SELECT rid FROM repo_pubs) THEN 'known' ELSE 'new' END AS reason FROM code")
def i26_i27_import_reasons(t):
    """Every curated row lands in exactly one class, by the first reason that holds."""
    known = t["repo_pubs"].select("rid").distinct().withColumn("k", F.lit(True))
    reason = F.when(~F.col("url").startswith("https://"), "bad_url").when(F.col("owner").isNull(), "no_owner").when(F.col("k"), "known").otherwise("new")
    return t["code"].join(known, "rid", "left").select("rid", reason.alias("reason"))


# Sets, groups and texts.


@derived_query("SELECT per, pid FROM wrote WHERE per % 2 = 0 AND per NOT IN (SELECT per FROM people WHERE per % 3 = 0) UNION SELECT per, pid FROM wrote WHERE per % 5 = 0 AND per NOT IN (SELECT per FROM people WHERE per % 3 = 0)")
def u09_seeds_minus_walked(t):
    w = t["wrote"].select("per", "pid")
    return w.where("per % 2 = 0").union(w.where("per % 5 = 0")).distinct().join(t["people"].where("per % 3 = 0").select("per"), "per", "left_anti")


@derived_query("SELECT a.per AS a, b.per AS b, (a.did = b.did)::INTEGER + coalesce((a.latin = b.latin)::INTEGER, 0) AS shared FROM people a JOIN people b ON b.per = a.per + 7 WHERE a.did IS NOT NULL AND b.did IS NOT NULL")
def u05_shared_facts(t):
    p = t["people"].where("did IS NOT NULL").select("per", F.array_compact(F.array(F.concat(F.lit("d"), F.col("did").cast("string")), F.concat(F.lit("l"), "latin"))).alias("f"))
    b = p.select((F.col("per") - 7).alias("per"), F.col("per").alias("b"), F.col("f").alias("g"))
    return p.join(b, "per").select(F.col("per").alias("a"), "b", F.size(F.array_intersect("f", "g")).alias("shared"))


@derived_query("SELECT pid, string_agg(per::VARCHAR, ',' ORDER BY per) AS people FROM wrote GROUP BY pid")
def g16_inverted_groups(t):
    """Persons with their works, turned into works with their persons."""
    of = t["wrote"].groupBy("per").agg(F.collect_set("pid").alias("works"))
    back = of.select("per", F.explode("works").alias("pid")).groupBy("pid").agg(F.array_sort(F.collect_set("per")).alias("p"))
    return back.select("pid", F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("people"))


@derived_query("SELECT orcid, min(per) AS survivor, string_agg(DISTINCT latin, ',' ORDER BY latin) AS names, count(*) AS members FROM people WHERE orcid IS NOT NULL AND per NOT IN (SELECT max(per) FROM people WHERE orcid IS NOT NULL GROUP BY orcid HAVING count(*) > 1) GROUP BY orcid")
def g21_unmerge(t):
    """Folded persons without their last member, from the source rows: nothing that only it contributed stays."""
    p = t["people"].where("orcid IS NOT NULL")
    out = p.groupBy("orcid").agg(F.max("per").alias("per"), F.count("*").alias("n")).where("n > 1").select("per")
    return p.join(out, "per", "left_anti").groupBy("orcid").agg(F.min("per").alias("survivor"), F.array_join(F.array_sort(F.collect_set("latin")), ",").alias("names"), F.count("*").alias("members")).withColumn("names", F.when(F.col("names") != "", F.col("names")))


@derived_query("SELECT rid, lower(coalesce(owner, CASE WHEN regexp_matches(url, '(?i)^https://github\\.com/[^/]+/') THEN split_part(url, '/', 4) END)) AS owner, split_part(rtrim(url, '/'), '/', -1) AS name FROM code")
def f58_f07_repository_owner(t):
    from quillgraph.functions.keys import last_segment

    host = F.when(F.col("url").rlike(r"(?i)^https://github\.com/[^/]+/"), F.split("url", "/")[3])
    return t["code"].select("rid", F.lower(F.coalesce("owner", host)).alias("owner"), last_segment(F.col("url")).alias("name"))


@derived_query("SELECT rid, CASE WHEN regexp_full_match(lower(url), 'https://github\\.com/[^/]+/[^/]+/?') THEN 'github_o_' || split_part(lower(rtrim(url, '/')), '/', 5) END AS id FROM code")
def f05_canonical_repository(t):
    from quillgraph.functions.keys import repository_id

    return t["code"].select("rid", repository_id(F.col("url")).alias("id"))


@derived_query("SELECT per, string_agg(DISTINCT v, ',' ORDER BY v) AS others FROM (SELECT per, trim(unnest([latin, given, surname])) AS v, coalesce(latin, '') AS shown FROM people) WHERE v <> '' AND lower(v) <> lower(shown) GROUP BY per")
def f54_f64_other_names(t):
    """Name variants that are not shown already, trimmed, distinct, sorted."""
    each = F.transform(F.array_compact(F.array("latin", "given", "surname")), lambda v: F.trim(v))
    kept = F.filter(each, lambda v: (v != "") & (F.lower(v) != F.lower(F.coalesce("latin", F.lit("")))))
    return t["people"].select("per", F.array_join(F.array_sort(F.array_distinct(kept)), ",").alias("others")).where("others <> ''")


@derived_query("SELECT per FROM people WHERE contains(lower(concat_ws(' ', latin, given, orcid)), 'petrova p') LIMIT 0 + 100000")
def f77_search_index(t):
    """Contains over label and terms, whatever the case; an empty query finds nothing."""
    def search(rows, terms, query):
        return rows.where(F.contains(F.lower(F.concat_ws(" ", *terms)), F.lit(query.lower()))) if query.strip() else rows.limit(0)

    p = t["people"]
    return search(p, ["latin", "given", "orcid"], "Petrova P").union(search(p, ["latin"], " ")).select("per")


@derived_query("""SELECT per, CASE per % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS equal FROM people""")
def f78_equal_values(t):
    """Whether two edited values are the same once JSON is parsed and text is trimmed."""
    k = F.col("per") % 4
    a = F.when(k == 0, '{"a": 1, "b": [2]}').when(k == 1, '{"a": 1}').when(k == 2, " x ").otherwise("x")
    b = F.when(k == 0, '{"b":[2],"a":1}').when(k == 1, '{"a": 2}').when(k == 2, "x").otherwise("y")
    plain = lambda c: F.coalesce(F.to_json(F.try_parse_json(c)), F.trim(c))
    return t["people"].select("per", (plain(a) == plain(b)).alias("equal"))


@derived_query("SELECT rid, pid IS NOT NULL AS has_code, min(url) AS url FROM code LEFT JOIN (SELECT rid, pid, url AS u2 FROM links WHERE relevant AND pid % 5 <> 0) USING (rid) GROUP BY rid, pid IS NOT NULL")
def f66_code_flag(t):
    """Whether a repository has a relevant link that is not ambiguous."""
    sure = t["links"].where("relevant AND pid % 5 <> 0").select("rid").distinct().withColumn("s", F.lit(True))
    return t["code"].join(sure, "rid", "left").select("rid", F.coalesce("s", F.lit(False)).alias("has_code"), "url")


@derived_query("SELECT pid, array_to_string(list_distinct([title, type, title]), ',') AS fields FROM works WHERE FALSE UNION ALL SELECT pid, title || ',' || type FROM works")
def f11_u01_topic_fields(t):
    """Distinct fields in the order of their first mention."""
    return t["works"].select("pid", F.array_join(F.array_distinct(F.array("title", "type", "title")), ",").alias("fields"))


@derived_query("SELECT per, surname IS NOT NULL AND regexp_full_match(surname, '[\\p{Cyrillic}\\x{0301} -]+') AS native_ok, coalesce(regexp_full_match(latin, '[A-Za-z .-]+'), false) AS latin_ok FROM people")
def f72_name_contract(t):
    """Native names in the one alphabet, Latin ones in the other."""
    native = F.coalesce(F.col("surname").rlike(r"^[\p{IsCyrillic}́ -]+$"), F.lit(False))
    return t["people"].select("per", native.alias("native_ok"), F.coalesce(F.col("latin").rlike("^[A-Za-z .-]+$"), F.lit(False)).alias("latin_ok"))
