"""Reading, publishing and listing records of the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import keys
from quillgraph.operators import edges, folds, groups, history, votes
from quillgraph.plans.derived import derived_query
from quillgraph.sources import sinks, stores

# Stores: every work is an envelope of a provider and group; some are older than the provider column.
_RAW = """, raw AS (SELECT pid % 900 AS id, CASE WHEN pid % 5 <> 0 THEN 'p' || (pid % 3)::VARCHAR END AS provider, CASE WHEN pid % 2 = 0 THEN 's0' ELSE 's1' END AS source,
pid AS fetched_at, title AS payload, 'g' || (pid % 4)::VARCHAR AS grp FROM works)
"""


def _raw(t):
    w = t["works"]
    provider = F.when(F.col("pid") % 5 != 0, F.concat(F.lit("p"), (F.col("pid") % 3).cast("string")))
    source = F.when(F.col("pid") % 2 == 0, "s0").otherwise("s1")
    group = F.concat(F.lit("g"), (F.col("pid") % 4).cast("string"))
    return w.select((F.col("pid") % 900).alias("id"), provider.alias("provider"), source.alias("source"), F.col("pid").alias("fetched_at"), F.col("title").alias("payload"), group.alias("grp"))


@derived_query(_RAW + "SELECT id, fetched_at FROM raw WHERE provider = 'p1' OR (provider IS NULL AND source IN ('s1'))")
def s09_s08_by_provider(t):
    return stores.by_provider(_raw(t), "p1", ["s1"]).select("id", "fetched_at")


@derived_query(_RAW + "SELECT id AS key, arg_max(payload, (fetched_at, payload)) AS payload FROM raw GROUP BY id")
def s25_latest_payloads(t):
    return stores.latest_payloads(_raw(t), F.col("id"))


@derived_query(_RAW + "SELECT id, count(*) AS n FROM raw WHERE grp IN ('g1', 'g2') AND grp = 'g1' GROUP BY id")
def s10_of_group(t):
    claimed = _raw(t).withColumn("groups", F.array("grp", F.when(F.col("grp") == "g2", "g9").otherwise("g8")))
    return stores.of_group(claimed, "g1").groupBy("id").agg(F.count("*").alias("n"))


@derived_query("SELECT pid FROM works WHERE pid % 50 = 3 OR pid % 50 = 4")
def s11_by_ids(t):
    """Each work was merged from the one before it; ids ask for works by either."""
    rows = t["works"].select(F.col("pid").cast("string").alias("pid"), F.array((F.col("pid") - 1).cast("string")).alias("merged_ids"))
    asked = t["works"].where("pid % 50 = 3").select(F.col("pid").cast("string").alias("id")).union(t["works"].where("pid % 50 = 4").select((F.col("pid") - 1).cast("string")))
    return stores.by_ids(rows, asked, "pid").select(F.col("pid").cast("bigint").alias("pid")).where("pid % 50 IN (3, 4)")


@derived_query(_RAW + "SELECT DISTINCT grp AS \"group\" FROM raw UNION SELECT 'z' || (rid % 3)::VARCHAR FROM code")
def s12_known_groups(t):
    code = t["code"].select(F.array(F.concat(F.lit("z"), (F.col("rid") % 3).cast("string"))).alias("groups"))
    return stores.known_groups([_raw(t).select(F.array("grp").alias("groups")), code])


_CATALOG = """, cat AS (SELECT 'o' || oid::VARCHAR AS uid, oname AS name, 'organization' AS kind, NULL::VARCHAR AS parent FROM organizations
UNION ALL SELECT 'd' || did::VARCHAR, dname, 'department', CASE WHEN did % 5 = 0 THEN 'o' || oid::VARCHAR WHEN did % 5 = 1 THEN NULL ELSE 'd' || (did - did % 5)::VARCHAR END FROM departments)
"""


def _catalog(t):
    d, text = t["departments"], lambda p, c: F.concat(F.lit(p), c.cast("string"))
    parent = F.when(F.col("did") % 5 == 0, text("o", F.col("oid"))).when(F.col("did") % 5 != 1, text("d", F.col("did") - F.col("did") % 5))
    orgs = t["organizations"].select(text("o", F.col("oid")).alias("uid"), F.col("oname").alias("name"), F.lit("organization").alias("kind"), F.lit(None).cast("string").alias("parent"))
    return orgs.union(d.select(text("d", F.col("did")), "dname", F.lit("department"), parent))


@derived_query(_CATALOG + "SELECT c.uid AS id, c.name, CASE WHEN p.kind <> 'organization' THEN c.parent END AS parent_id, CASE WHEN p.kind = 'organization' THEN c.parent END AS organization_id FROM cat c LEFT JOIN cat p ON p.uid = c.parent WHERE c.kind <> 'organization'")
def s13_department_catalog(t):
    return stores.departments(_catalog(t))


@derived_query(_CATALOG + "SELECT uid AS id, name FROM cat WHERE kind = 'organization'")
def s14_organizations(t):
    return _catalog(t).where("kind = 'organization'").select(F.col("uid").alias("id"), "name")


@derived_query("SELECT DISTINCT lower(owner) AS login FROM code WHERE coalesce(trim(owner), '') <> ''")
def s15_organization_logins(t):
    return t["code"].where(F.trim("owner") != "").select(F.lower("owner").alias("login")).distinct()


@derived_query("SELECT pid FROM publications WHERE date BETWEEN DATE '1995-03-01' AND DATE '1996-02-29'")
def s21_period(t):
    return stores.period(t["publications"], "date", "1995-03-01", "1996-02-29").select("pid")


@derived_query("SELECT 'snapshot-' || strftime(max(date), '%d-%m-%Y') || '.parquet' AS name, max(date)::VARCHAR AS day FROM publications")
def s22_newest_snapshot(t):
    names = t["publications"].select(F.concat(F.lit("snapshot-"), F.date_format("date", "dd-MM-yyyy"), F.lit(".parquet")).alias("name"))
    return stores.newest_snapshot(names).withColumn("day", F.col("day").cast("string"))


@derived_query(""", said AS (SELECT per, pid, CASE WHEN pid % 3 = 0 THEN 'bad' ELSE '0000-0001-0000-' || lpad((per % 10000)::VARCHAR, 4, '0') END AS orcid FROM wrote)
SELECT per, max(orcid) AS orcid FROM (SELECT per, arg_max(orcid, pid) AS orcid FROM said GROUP BY per) WHERE regexp_full_match(orcid, '\\d{4}-\\d{4}-\\d{4}-\\d{3}[\\dX]') GROUP BY per""")
def s26_latest_orcid(t):
    """The ORCID of an author's latest response; if that is none, the author has none."""
    value = F.when(F.col("pid") % 3 == 0, "bad").otherwise(F.concat(F.lit("0000-0001-0000-"), F.lpad((F.col("per") % 10000).cast("string"), 4, "0")))
    last = t["wrote"].select("per", "pid", value.alias("orcid")).groupBy("per").agg(F.max_by("orcid", "pid").alias("orcid"))
    return last.select("per", keys.orcid(F.col("orcid")).alias("orcid")).where("orcid IS NOT NULL")


@derived_query("SELECT pid, count(per) AS author_count, string_agg(position || ':' || per, ',' ORDER BY position, per) AS authors FROM works LEFT JOIN wrote USING (pid) GROUP BY pid")
def s30_publications_with_authors(t):
    listed = F.array_sort(F.collect_list(F.when(F.col("per").isNotNull(), F.struct("position", "per"))))
    out = t["works"].select("pid").join(t["wrote"], "pid", "left").groupBy("pid").agg(F.count("per").alias("author_count"), listed.alias("a"))
    text = F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["position"].cast("string"), x["per"].cast("string"))), ",")
    return out.select("pid", "author_count", F.when(F.col("author_count") > 0, text).alias("authors"))


@derived_query("SELECT rid, count(pid) AS n FROM code LEFT JOIN repo_pubs USING (rid) GROUP BY rid")
def s31_repositories_with_counts(t):
    return t["code"].select("rid").join(t["repo_pubs"], "rid", "left").groupBy("rid").agg(F.count("pid").alias("n"))


@derived_query("SELECT pid, title || ',' || type AS fields FROM works WHERE pid % 3 = 0 OR pid % 3 = 1 AND FALSE")
def s32_fields(t):
    listed = F.when(F.col("pid") % 3 == 0, F.array("title", "type")).when(F.col("pid") % 3 == 1, F.array().cast("array<string>"))
    return t["works"].select("pid", listed.alias("f")).where(F.size(F.coalesce("f", F.array().cast("array<string>"))) > 0).select("pid", F.array_join("f", ",").alias("fields"))


@derived_query("SELECT per AS src, pid AS tgt FROM wrote WHERE per IN (SELECT per FROM people WHERE did IS NOT NULL) AND pid IN (SELECT pid FROM works)")
def s33_edge_pairs(t):
    ends = t["people"].where("did IS NOT NULL").select("per")
    return t["wrote"].join(ends, "per", "left_semi").join(t["works"].select("pid"), "pid", "left_semi").select(F.col("per").alias("src"), F.col("pid").alias("tgt"))


_CHAIN = """, RECURSIVE_SEED AS (SELECT per AS old, per - 1 AS new FROM people WHERE per % 7 IN (2, 3, 4))
SELECT old, old - (old % 7 - 1) AS new FROM RECURSIVE_SEED"""


@derived_query(_CHAIN)
def s34_g25_canonical_ids(t):
    """Aliases in chains of three, each led to its survivor; cycles are refused."""
    aliases = t["people"].where("per % 7 IN (2, 3, 4)").select(F.col("per").alias("old"), (F.col("per") - 1).alias("new"))
    return groups.alias_closure(aliases)


@derived_query("SELECT per, string_agg(pid::VARCHAR, ',' ORDER BY pid) AS works FROM people LEFT JOIN wrote USING (per) WHERE per NOT IN (SELECT per FROM people WHERE per % 4 <> 0) GROUP BY per")
def s35_graph_only(t):
    known = t["people"].where("per % 4 <> 0").select("per")
    left = t["people"].select("per").join(known, "per", "left_anti").join(t["wrote"].select("per", "pid"), "per", "left")
    listed = left.groupBy("per").agg(F.array_sort(F.collect_list("pid")).alias("w"))
    return listed.select("per", F.when(F.size("w") > 0, F.array_join(F.transform("w", lambda x: x.cast("string")), ",")).alias("works"))


@derived_query("SELECT per, any_value(dname) AS department, count(DISTINCT pid) AS works FROM people LEFT JOIN departments USING (did) LEFT JOIN wrote USING (per) GROUP BY per")
def s37_person_facts(t):
    worked = t["wrote"].groupBy("per").agg(F.count_distinct("pid").alias("works"))
    return t["people"].select("per", "did").join(F.broadcast(t["departments"]), "did", "left").join(worked, "per", "left").select("per", F.col("dname").alias("department"), F.coalesce("works", F.lit(0)).alias("works"))


@derived_query("SELECT pid + 1 AS missing, pid AS canonical FROM works WHERE pid % 32 = 1")
def s38_canonical_of_missing(t):
    merged = t["works"].where("pid % 32 = 1").select(F.col("pid").alias("canonical"), F.explode(F.array(F.col("pid") + 1)).alias("missing"))
    return merged.groupBy("missing").agg(F.min("canonical").alias("canonical"))


@derived_query("SELECT pid FROM works ORDER BY pid DESC LIMIT 200")
def s40_newest_operations(t):
    return t["works"].select("pid").orderBy(F.desc("pid")).limit(200)


# Publishing.


@derived_query("SELECT pid, CASE WHEN pid % 3 = 0 THEN 'new' ELSE title END AS title FROM works WHERE pid % 2 = 0 OR pid % 3 = 0")
def k04_upsert_without_retraction(t):
    current = t["works"].where("pid % 2 = 0").select("pid", "title").withColumn("_version", F.lit(1))
    return history.upsert(current, t["works"].where("pid % 3 = 0").select("pid", F.lit("new").alias("title")), "pid")[0].select("pid", "title")


@derived_query("SELECT 'Person' AS label, per AS id, latin, '{\"surname\":\"' || surname || '\"}' AS name FROM people WHERE surname IS NOT NULL")
def k07_x08_nodes(t):
    rows = t["people"].where("surname IS NOT NULL").select("per", "latin", F.struct("surname").alias("name"))
    return sinks.Node("Person", "per", ["latin", "name"]).rows(rows)


@derived_query("SELECT 'AUTHORED' AS rel, pid AS src, per AS tgt, position FROM wrote WHERE position <= 2")
def k08_edges_of_lists(t):
    listed = t["wrote"].groupBy("pid").agg(F.collect_list(F.struct("per", "position")).alias("authors"))
    return sinks.Edge("AUTHORED", "pid", "authors", "per", ["position"], F.expr("x.position <= 2")).rows(listed)


@derived_query("""SELECT per, coalesce(latin, 'kept') AS latin, string_agg(DISTINCT v, ',' ORDER BY v) AS variants FROM (SELECT per, latin, unnest([coalesce(given, 'a'), 'old']) AS v FROM people) GROUP BY ALL""")
def k10_person_upsert(t):
    """Folded lists of a stored person are kept; an unknown field does not overwrite a known one."""
    stored = t["people"].select("per", F.lit("kept").alias("l0"), F.array(F.lit("old")).alias("v0"))
    new = t["people"].select("per", F.col("latin").alias("l1"), F.array(F.coalesce("given", F.lit("a"))).alias("v1"))
    both = stored.join(new, "per", "full")
    return both.select("per", F.coalesce("l1", "l0").alias("latin"), F.array_join(F.array_sort(F.array_union("v0", "v1")), ",").alias("variants"))


@derived_query("SELECT pid, per, CASE WHEN per % 2 = 0 THEN 99 ELSE position END AS position FROM wrote")
def k13_set_on_existing(t):
    """Properties for edges that exist; those for others create nothing."""
    given = t["wrote"].where("per % 2 = 0").select("pid", "per", F.lit(99).alias("p")).union(t["wrote"].select(-F.col("pid") - 1, "per", F.lit(98)))
    return t["wrote"].join(given, ["pid", "per"], "left").select("pid", "per", F.coalesce("p", "position").alias("position"))


@derived_query("""SELECT pid, rid, CASE WHEN pid % 3 = 0 THEN 'delete' WHEN pid % 3 = 1 THEN 'create' ELSE 'update' END AS action FROM links WHERE pid % 3 <> 2 OR rid % 2 = 0""")
def k15_k16_sync_links(t):
    """The actions that make live link edges the desired ones."""
    rows = t["links"].select("pid", "rid", F.lit("a").alias("url"))
    desired = rows.where("pid % 3 <> 0").withColumn("url", F.when((F.col("pid") % 3 == 2) & (F.col("rid") % 2 == 0), F.lit("b")).otherwise(F.col("url")))
    return edges.sync_plan(rows.where("pid % 3 <> 1"), desired, ["pid", "rid"], ["url"])


@derived_query(""", k AS (SELECT lower(rtrim(url, '/')) AS u, min(rid) AS rid FROM code GROUP BY 1)
SELECT pid, CASE WHEN k.rid IS NULL THEN 'LinkCandidate' ELSE 'Repository' END AS kind, coalesce(k.rid::VARCHAR, url) AS target, CASE WHEN pid % 5 <> 0 THEN relevant END AS relevant FROM links LEFT JOIN k ON lower(url) = u""")
def k17_k21_link_targets(t):
    """A link leads to the repository of its address, else to a candidate; an ambiguous one has no verdict."""
    known = t["code"].groupBy(F.lower(F.regexp_replace("url", "/+$", "")).alias("u")).agg(F.min("rid").alias("known"))
    joined = t["links"].withColumn("u", F.lower("url")).join(known, "u", "left")
    kind = F.when(F.col("known").isNull(), "LinkCandidate").otherwise("Repository")
    return joined.select("pid", kind.alias("kind"), F.coalesce(F.col("known").cast("string"), "url").alias("target"), F.when(F.col("pid") % 5 != 0, F.col("relevant")).alias("relevant"))


@derived_query("SELECT url FROM (SELECT DISTINCT lower(url) AS url FROM links) WHERE url NOT IN (SELECT lower(rtrim(url, '/')) FROM code) ")
def k17_remaining_candidates(t):
    known = t["code"].select(F.lower(F.regexp_replace("url", "/+$", "")).alias("url"))
    return t["links"].select(F.lower("url").alias("url")).distinct().join(known, "url", "left_anti")


@derived_query("SELECT pid FROM works WHERE pid % 11 <> 0 AND pid % 7 <> 0")
def k19_k20_rows_to_load(t):
    """Rows that have no tombstone and whose enrichment did not fail."""
    dead = t["works"].where("pid % 11 = 0").select("pid")
    state = F.create_map(F.lit("enrich"), F.when(F.col("pid") % 7 == 0, "failed").otherwise("done"))
    return t["works"].withColumn("processing", state).join(dead, "pid", "left_anti").where("processing['enrich'] <> 'failed'").select("pid")


@derived_query("SELECT per, CASE WHEN per % 6 = 0 THEN '1,2,' || per ELSE '1' END AS merged FROM people")
def k22_keep_merged_ids(t):
    graph = t["people"].where("per % 6 = 0").select("per", F.array(F.lit("1"), F.lit("2"), F.col("per").cast("string")).alias("old"))
    joined = t["people"].select("per", F.array(F.lit("1")).alias("new")).join(graph, "per", "left")
    return joined.select("per", F.array_join(F.array_union("new", F.coalesce("old", F.array().cast("array<string>"))), ",").alias("merged"))


@derived_query("SELECT pid, title, year, string_agg(name, '; ' ORDER BY position, name) AS authors FROM publications LEFT JOIN (SELECT pid, position, name FROM authorship JOIN persons USING (per)) USING (pid) GROUP BY 1, 2, 3")
def k27_grant_report(t):
    named = t["authorship"].join(t["persons"], "per").select("pid", "position", "name")
    return sinks.grant_report(t["publications"].select("pid", "title", "year"), named)


@derived_query("SELECT sha256('{\"pid\":' || pid || ',\"type\":\"' || type || '\"}') AS hash FROM works")
def k34_archive(t):
    rows = t["works"].select("pid", "type")
    empty = sinks.archive(rows.limit(0), rows.select(F.lit("").alias("hash"), F.struct("pid", "type").alias("snapshot")).limit(0))
    some = sinks.archive(rows.where("pid % 2 = 0"), empty)
    return sinks.archive(rows, some).select("hash")


# Filters.


@derived_query("SELECT per FROM people WHERE coalesce(email, '') <> '' AND NOT contains(email, 'noreply')")
def p19_reply_addresses(t):
    return t["people"].where("email <> '' AND NOT contains(email, 'noreply')").select("per")


@derived_query("SELECT pid FROM works WHERE pid NOT IN (SELECT pid FROM works WHERE pid % 3 = 0)")
def p05_unknown_ids(t):
    return t["works"].select("pid").join(t["works"].where("pid % 3 = 0").select("pid"), "pid", "left_anti")


@derived_query("SELECT pid FROM works WHERE CASE WHEN pid % 5 <> 0 THEN pid % 4 END IS DISTINCT FROM CASE WHEN pid % 3 <> 0 THEN pid % 2 END")
def p08_changed_requests(t):
    """Rows to ask for again: their request's key is not the stored one; NULL equals NULL."""
    asked, stored = F.when(F.col("pid") % 5 != 0, F.col("pid") % 4), F.when(F.col("pid") % 3 != 0, F.col("pid") % 2)
    return t["works"].where(~asked.eqNullSafe(stored)).select("pid")


@derived_query("SELECT a.per AS a, b.per AS b FROM people a JOIN people b ON b.per = a.per + 1 WHERE (a.email IS NOT NULL AND b.email IS NOT NULL AND a.email <> b.email) OR (a.login IS NOT NULL AND b.login IS NOT NULL AND a.login <> b.login)")
def p12_profile_conflicts(t):
    p = t["people"].select("per", "email", "login")
    pairs = p.select(F.col("per").alias("a"), F.col("email").alias("ea"), F.col("login").alias("la"), (F.col("per") + 1).alias("b")).join(p.select(F.col("per").alias("b"), F.col("email").alias("eb"), F.col("login").alias("lb")), "b")
    return pairs.where("coalesce(ea <> eb, false) OR coalesce(la <> lb, false)").select("a", "b")


@derived_query("SELECT a.pid AS shorter, b.pid AS longer FROM (SELECT pid, '10.1/' || (pid % 100) AS doi FROM works WHERE pid % 2 = 0) a JOIN (SELECT pid, '10.1/' || (pid % 100 - 1) || '.v' || (pid % 3) AS doi FROM works WHERE pid % 2 = 1) b ON b.doi LIKE a.doi || '.v%' AND regexp_full_match(substr(b.doi, length(a.doi) + 1), '\\.v\\d+')")
def p15_version_siblings(t):
    """A DOI and the same with ``.v`` and a number: every two such records, by what precedes the suffix; records of one DOI meet all those of the other in blocks."""
    text = lambda c: c.cast("string")
    a = t["works"].where("pid % 2 = 0").select(F.concat(F.lit("10.1/"), text(F.col("pid") % 100)).alias("doi"), F.col("pid").alias("shorter"))
    b = t["works"].where("pid % 2 = 1").select(F.concat(F.lit("10.1/"), text(F.col("pid") % 100 - 1), F.lit(".v"), text(F.col("pid") % 3)).alias("d"), F.col("pid").alias("longer"))
    b = b.select(F.nullif(F.regexp_extract("d", r"^(.*)\.v\d+$", 1), F.lit("")).alias("doi"), "longer")
    return edges.all_meetings(a, b, "doi").select("shorter", "longer")


@derived_query("SELECT pid FROM works WHERE title NOT IN ('5-LOW', '4-NOT SPECIFIED') AND type NOT IN ('P')")
def p16_p17_papers(t):
    return t["works"].where(~F.col("title").isin("5-LOW", "4-NOT SPECIFIED") & ~F.col("type").isin("P")).select("pid")


@derived_query("SELECT DISTINCT pid FROM wrote JOIN people USING (per) WHERE internal")
def p23_with_internal_author(t):
    inner = t["wrote"].join(t["people"].where("internal"), "per", "left_semi").select("pid")
    return t["works"].select("pid").join(inner, "pid", "left_semi")


@derived_query("SELECT per FROM people WHERE internal OR per IN (SELECT per FROM wrote WHERE pid IN (SELECT pid FROM wrote JOIN people USING (per) WHERE internal))")
def p24_p26_kept_persons(t):
    """Staff, and externals who wrote a publication together with staff."""
    kept = t["wrote"].join(t["people"].where("internal"), "per", "left_semi").select("pid").distinct()
    coauthors = t["wrote"].join(kept, "pid", "left_semi").select("per").distinct().withColumn("c", F.lit(True))
    return t["people"].join(coauthors, "per", "left").where("internal OR c").select("per")


@derived_query("SELECT rid, CASE WHEN bool_and(relevant IS NOT NULL) AND NOT bool_or(coalesce(relevant, false)) THEN 'rejected' WHEN bool_or(coalesce(relevant, false)) THEN 'relevant' ELSE 'undecided' END AS state FROM links GROUP BY rid")
def p32_evidence_state(t):
    yes = F.bool_or(F.coalesce("relevant", F.lit(False)))
    state = F.when(yes, "relevant").when(F.bool_and(F.col("relevant").isNotNull()), "rejected").otherwise("undecided")
    return t["links"].groupBy("rid").agg(state.alias("state"))


@derived_query("SELECT rid, CASE WHEN rid % 7 = 0 THEN 'not_found' WHEN rid % 7 = 1 THEN 'blocked' WHEN rid % 7 < 4 THEN 'available' ELSE 'error' END AS status FROM code")
def p34_availability(t):
    code = F.element_at(F.array(*map(F.lit, [404, 451, 200, 200, 500, 503, 429])), (F.col("rid") % 7 + 1).cast("int"))
    status = F.when(code == 404, "not_found").when(code == 451, "blocked").when(code.between(200, 299), "available").otherwise("error")
    return t["code"].select("rid", status.alias("status"))


@derived_query("SELECT rid FROM code WHERE regexp_full_match(lower(url), 'https://github\\.com/[^/]+/[^/]+/?') AND lower(rtrim(url, '/')) NOT IN (SELECT lower(url) FROM links)")
def p36_orphan_repositories(t):
    named = t["links"].select(keys.repository_id(F.col("url")).alias("id"))
    return t["code"].withColumn("id", keys.repository_id(F.col("url"))).where("id IS NOT NULL").join(named, "id", "left_anti").select("rid")


@derived_query("""SELECT per, CASE WHEN email IS NOT NULL THEN 'matched' WHEN per % 5 = 0 THEN 'owner' WHEN per IN (SELECT a.per FROM authorship a JOIN repo_pubs USING (pid)) THEN 'claimed' ELSE 'stranger' END AS reason FROM people WHERE login IS NOT NULL""")
def p37_strangers(t):
    claimed = t["authorship"].join(t["repo_pubs"].select("pid").distinct(), "pid", "left_semi").select("per").distinct().withColumn("c", F.lit(True))
    reason = F.when(F.col("email").isNotNull(), "matched").when(F.col("per") % 5 == 0, "owner").when(F.col("c"), "claimed").otherwise("stranger")
    return t["people"].where("login IS NOT NULL").join(claimed, "per", "left").select("per", reason.alias("reason"))


# Lists and orders.


@derived_query("SELECT per FROM people WHERE per = 7 OR contains(lower(coalesce(latin, '')), 'pet') ORDER BY per <> 7, per LIMIT 20")
def o02_search_listing(t):
    found = t["people"].where(F.contains(F.lower(F.coalesce("latin", F.lit(""))), F.lit("pet")) | (F.col("per") == 7))
    return found.orderBy((F.col("per") == 7).desc(), "per").limit(20).select("per")


@derived_query("SELECT pid FROM publications ORDER BY date DESC, pid DESC LIMIT 10 OFFSET 20")
def o03_o12_feed_page(t):
    return votes.page(t["publications"], [F.desc("date"), F.desc("pid")], 10, 2).select("pid")


@derived_query("SELECT pid FROM publications ORDER BY date, pid LIMIT 10 OFFSET 10")
def o04_o05_longest_waiting(t):
    return votes.page(t["publications"], [F.col("date"), F.col("pid")], 10, 1).select("pid")


@derived_query("SELECT pid FROM (SELECT pid, row_number() OVER (ORDER BY CASE WHEN pid % 9 <> 0 THEN year END DESC NULLS LAST, pid) AS r FROM works) WHERE r > (SELECT (count(*) - 1) // 10 * 10 FROM works)")
def o07_o09_last_page(t):
    """Newest first, unknown years last; a page beyond the end is the last one."""
    rows = t["works"].withColumn("y", F.when(F.col("pid") % 9 != 0, F.col("year")))
    last = max(0, rows.count() - 1) // 10
    return votes.page(rows, [F.col("y").desc_nulls_last(), F.col("pid")], 10, min(10**9, last)).select("pid")


@derived_query("SELECT per, count(*) AS n FROM wrote GROUP BY per ORDER BY n DESC, per LIMIT 50")
def o06_a29_authors_by_works(t):
    return t["wrote"].groupBy("per").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "per").limit(50)


@derived_query("SELECT rid, stars FROM code ORDER BY stars DESC, rid LIMIT 50")
def o08_o10_repositories_by_stars(t):
    return t["code"].select("rid", "stars").orderBy(F.desc("stars"), "rid").limit(50)


@derived_query("SELECT did, count(*) AS n FROM people GROUP BY did ORDER BY n DESC, did LIMIT 12")
def o13_o14_largest_groups(t):
    return t["people"].groupBy("did").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col("did").asc_nulls_last()).limit(12)


# Aggregates.


@derived_query("SELECT lower(owner) AS login, string_agg(DISTINCT url, ',' ORDER BY url) AS urls, bool_or(stars > 40) AS popular, count(*) AS n FROM code WHERE owner IS NOT NULL GROUP BY 1")
def a46_a47_accounts(t):
    out = t["code"].where("owner IS NOT NULL").groupBy(F.lower("owner").alias("login")).agg(F.array_join(F.array_sort(F.collect_set("url")), ",").alias("urls"), F.bool_or(F.col("stars") > 40).alias("popular"), F.count("*").alias("n"))
    return out


@derived_query("SELECT token, count(DISTINCT per) AS people, count(*) AS n FROM (SELECT per, unnest([lower(latin), lower(given)]) AS token FROM people) WHERE token IS NOT NULL GROUP BY token")
def a53_token_counts(t):
    tokens = t["people"].select("per", F.explode(F.array(F.lower("latin"), F.lower("given"))).alias("token")).where("token IS NOT NULL")
    return tokens.groupBy("token").agg(F.count_distinct("per").alias("people"), F.count("*").alias("n"))


@derived_query("SELECT DISTINCT type AS value, 'type' AS kind FROM works UNION SELECT DISTINCT title, 'title' FROM works")
def a56_distinct_lists(t):
    each = F.explode(F.array(F.struct(F.col("type").alias("value"), F.lit("type").alias("kind")), F.struct(F.col("title").alias("value"), F.lit("title").alias("kind"))))
    return t["works"].select(each.alias("x")).select("x.*").distinct().orderBy("kind", "value")


@derived_query("SELECT per, string_agg(DISTINCT title, ',' ORDER BY title) AS fields FROM wrote JOIN works USING (pid) GROUP BY per")
def a57_fields_of_persons(t):
    joined = t["wrote"].select("per", "pid").join(t["works"].select("pid", "title"), "pid")
    return joined.groupBy("per").agg(F.array_join(F.array_sort(F.collect_set("title")), ",").alias("fields"))


@derived_query("SELECT type AS kind, arg_max(pid, (cents, pid)) AS last, count(*) FILTER (pid % 2 = 0) AS queued, count(*) FILTER (pid % 2 = 1) AS finished FROM works GROUP BY type")
def a59_p22_queue_counts(t):
    return t["works"].groupBy(F.col("type").alias("kind")).agg(F.max_by("pid", F.struct("cents", "pid")).alias("last"), F.count_if(F.col("pid") % 2 == 0).alias("queued"), F.count_if(F.col("pid") % 2 == 1).alias("finished"))


@derived_query("SELECT did, round(avg(per % 101), 6) AS x, round(avg(per % 37), 6) AS y FROM people WHERE did IS NOT NULL GROUP BY did")
def a61_centroids(t):
    return t["people"].where("did IS NOT NULL").groupBy("did").agg(F.round(F.avg(F.col("per") % 101), 6).alias("x"), F.round(F.avg(F.col("per") % 37), 6).alias("y"))


@derived_query("SELECT rid, pid, string_agg(DISTINCT url, ',' ORDER BY url) AS evidence FROM links GROUP BY rid, pid")
def a62_evidence_lists(t):
    return t["links"].groupBy("rid", "pid").agg(F.array_join(F.array_sort(F.collect_set("url")), ",").alias("evidence"))


@derived_query(""", e AS (SELECT venue, unnest(['a', 'b', 'c']) AS s FROM (SELECT DISTINCT venue FROM works)), o AS (SELECT DISTINCT venue, CASE pid % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'x' END AS s FROM works)
SELECT venue, string_agg(s, ',' ORDER BY s) AS missing FROM (SELECT * FROM e EXCEPT SELECT * FROM o) GROUP BY venue""")
def a42_coverage(t):
    """The expected sources that a key was not observed in."""
    source = F.when(F.col("pid") % 4 == 0, "a").when(F.col("pid") % 4 == 1, "b").when(F.col("pid") % 4 == 2, "c").otherwise("x")
    seen = t["works"].groupBy("venue").agg(F.collect_set(source).alias("s"))
    lost = F.array_except(F.array(F.lit("a"), F.lit("b"), F.lit("c")), "s")
    return seen.select("venue", F.array_join(lost, ",").alias("missing")).where("missing <> ''")


@derived_query("SELECT least(pid, rid) AS a, greatest(pid, rid) AS b, count(*) AS n, bool_or(coalesce(relevant, false)) AS relevant, CASE WHEN count(DISTINCT url) = 1 THEN min(url) END AS url FROM links GROUP BY 1, 2")
def a48_a49_u08_merged_edges(t):
    """Edges as unordered pairs; flags by OR, a value only where all agree."""
    e = t["links"].select(F.least("pid", "rid").alias("a"), F.greatest("pid", "rid").alias("b"), "relevant", "url", F.lit(1).alias("at"))
    merged = edges.collapse(e, ["a", "b"], F.col("at"), [], ["relevant"], [], ["url"])
    return merged.join(e.groupBy("a", "b").agg(F.count("*").alias("n")), ["a", "b"])


@derived_query("SELECT did, CASE WHEN bool_or(per % 17 = 0) THEN NULL ELSE string_agg(DISTINCT (per % 5)::VARCHAR, ',' ORDER BY (per % 5)::VARCHAR) END AS ids, max(per) AS at FROM people GROUP BY did")
def a43_inventory(t):
    """An owner's sources: the union, unknown as soon as one of them is."""
    rows = t["people"].select("did", F.when(F.col("per") % 17 != 0, F.array((F.col("per") % 5).cast("string"))).alias("ids"), F.col("per").alias("at"))
    return folds.inventory(rows, "did", "ids", "at").select("did", F.array_join("ids", ",").alias("ids"), "at")


@derived_query("SELECT owner, arg_min(rid, (stars IS NULL, -stars, rid)) AS survivor, string_agg(DISTINCT url, ',' ORDER BY url) AS urls FROM code WHERE owner IS NOT NULL GROUP BY owner")
def a35_a37_repository_fold(t):
    """The survivor is the repository with most stars, then the smallest id; it takes all addresses."""
    rank = F.struct(F.col("stars").isNull(), -F.col("stars"), F.col("rid"))
    return t["code"].where("owner IS NOT NULL").groupBy("owner").agg(F.min_by("rid", rank).alias("survivor"), F.array_join(F.array_sort(F.collect_set("url")), ",").alias("urls"))


@derived_query("SELECT orcid, arg_min(surname, per) FILTER (coalesce(surname, '') <> '') AS surname, arg_min(latin, per) FILTER (coalesce(latin, '') <> '') AS latin, bool_or(internal) AS internal FROM people WHERE orcid IS NOT NULL GROUP BY orcid")
def a31_a38_person_fold(t):
    return folds.fold(t["people"].where("orcid IS NOT NULL"), "orcid", [F.col("per")], ["surname", "latin"], [], ["internal"])


@derived_query("SELECT pid, (CASE WHEN type = 'F' THEN 1 ELSE 0 END)::INTEGER AS kind, CASE WHEN pid % 4 = 0 THEN year::VARCHAR || '-12-31' ELSE date::VARCHAR END AS day, (CASE WHEN abstract IS NULL OR abstract = '' THEN 0 ELSE 1 END + CASE WHEN doi IS NULL THEN 0 ELSE 1 END)::INTEGER AS complete FROM works JOIN (SELECT pid, date FROM publications) USING (pid)")
def a32_record_rank(t):
    joined = t["works"].join(t["publications"].select("pid", "date"), "pid")
    day = folds.record_day(F.when(F.col("pid") % 4 != 0, F.col("date")), F.col("year"))
    return joined.select("pid", (F.col("type") == "F").cast("int").alias("kind"), day.cast("string").alias("day"), folds.completeness(joined, ["abstract", "doi"]).cast("int").alias("complete"))
