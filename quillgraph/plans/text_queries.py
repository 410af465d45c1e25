"""Queries of keys, texts, names and candidate pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import keys, text
from quillgraph.functions.names import fold_name, name_alignment, name_similarity
from quillgraph.operators import blocking
from quillgraph.plans.registry import query


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT page_id, '10.' || page_id || '/ab.c' AS doi FROM pages")
def f01_doi(spark, sf_dir):
    raw = F.concat(F.when(F.col("page_id") % 3 == 0, "https://doi.org/10.").when(F.col("page_id") % 3 == 1, "DOI: 10.").otherwise("http://dx.doi.org/10."), F.col("page_id"), F.lit("/Ab.C/"))
    return _t(spark, sf_dir, "pages").select("page_id", keys.doi(raw).alias("doi"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '0000-0001-' || lpad((page_id % 10000)::VARCHAR, 4, '0') || '-123X' END AS orcid FROM pages")
def f02_orcid(spark, sf_dir):
    number = F.concat(F.lit("0000-0001-"), F.lpad((F.col("page_id") % 10000).cast("string"), 4, "0"), F.lit("-123x"))
    raw = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://orcid.org/"), number)).otherwise(F.concat(F.lit("https://example.org/"), number))
    return _t(spark, sf_dir, "pages").select("page_id", keys.orcid(raw).alias("orcid"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '/+$', ''), '\.git$', ''), '^(?:https?://)?(?:www\.)?', 'https://') AS url FROM pages")
def f04_repository_url(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", keys.repository_url(F.col("url")).alias("url"))


@query("SELECT page_id, CASE WHEN page_id % 3 <> 2 THEN 'github_owner' || page_id || '_name' END AS repo FROM pages")
def f06_repository_id(spark, sf_dir):
    raw = F.concat(F.lit("http://www.GitHub.com/Owner"), "page_id", F.when(F.col("page_id") % 3 == 0, "/Name.git").when(F.col("page_id") % 3 == 1, "/name/").otherwise("/name/tree/main"))
    return _t(spark, sf_dir, "pages").select("page_id", keys.repository_id(raw).alias("repo"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'orcid_' || c_custkey ELSE 'name_' || substr(sha1(lower(c_name)), 1, 12) END AS person FROM customer")
def f08_fallback_person(spark, sf_dir):
    orcid = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string"))
    return _t(spark, sf_dir, "customer").select("c_custkey", keys.fallback_person(orcid, F.col("c_name")).alias("person"))


@query(r"SELECT conv_id, turn, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text FROM conversations")
def f12_collapse(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", text.collapse(F.col("text")).alias("text"))


@query("""SELECT n_nationkey, array_to_string(list_sort(list_distinct(CASE WHEN length(w) < 5 THEN [w] ELSE [w] || list_transform(range(1, length(w) + 1), lambda i: substr(w, 1, i - 1) || substr(w, i + 1)) END)), ',') AS keys
FROM (SELECT n_nationkey, list_reduce(string_split(lower(n_name), ''), lambda a, c: CASE WHEN right(a, 1) = c THEN a ELSE a || c END) AS w FROM nation)""")
def f20_deletion_keys(spark, sf_dir):
    return _t(spark, sf_dir, "nation").select("n_nationkey", F.array_join(F.array_sort(text.deletion_keys(F.col("n_name"))), ",").alias("keys"))


@query("""SELECT doc_id, len(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: length(w) > 2 AND w NOT IN ('a','an','and','at','by','for','from','in','of','on','or','the','to','with')))) AS tokens FROM documents""")
def f24_title_tokens(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(text.title_tokens(F.col("text"))).cast("bigint").alias("tokens"))


@query(r"""SELECT conv_id, turn, len(list_distinct(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(0, greatest(len(w) - 3, 0) + 1), lambda k: array_to_string(w[k + 1:k + 3], ' ')) END)) AS n
FROM (SELECT conv_id, turn, list_filter(string_split(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), ' '), lambda x: x <> '') AS w FROM conversations)""")
def f24_shingles(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(text.shingles(F.col("text"))).cast("bigint").alias("n"))


_EMAILS = r"list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), lambda e: lower(e)))"


@query(f"SELECT doc_id, array_to_string(list_sort(x), ',') AS emails FROM (SELECT doc_id, {_EMAILS} AS x FROM documents) WHERE len(x) > 0")
def f38_emails(spark, sf_dir):
    found = _t(spark, sf_dir, "documents").select("doc_id", text.emails(F.col("text")).alias("x")).where(F.size("x") > 0)
    return found.select("doc_id", F.array_join(F.array_sort("x"), ",").alias("emails"))


@query(f"""SELECT doc_id, CASE WHEN len(own) > 0 THEN own[1] ELSE (SELECT e FROM (SELECT unnest(x) AS e) ORDER BY length(e), e LIMIT 1) END AS email
FROM (SELECT doc_id, x, list_sort(list_filter(x, lambda e: ends_with(e, '.org'))) AS own FROM (SELECT doc_id, {_EMAILS} AS x FROM documents) WHERE len(x) > 0)""")
def f40_best_email(spark, sf_dir):
    found = _t(spark, sf_dir, "documents").select("doc_id", text.emails(F.col("text")).alias("x")).where(F.size("x") > 0)
    return found.select("doc_id", text.best_email(F.col("x"), ".org").alias("email"))


@query("SELECT page_id, url AS links FROM pages")
def f32_links(spark, sf_dir):
    said = F.concat(F.lit("see ("), "url", F.lit("), or "), "url", F.lit("."))
    return _t(spark, sf_dir, "pages").select("page_id", F.array_join(text.links(said), " ").alias("links"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 199) || '…' ELSE text END AS title FROM documents")
def f56_truncated(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.truncated(F.col("text")).alias("title"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'), 'https?://\S+', '[link]', 'g') AS text FROM documents")
def f60_redacted(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.without_addresses(F.col("text")).alias("text"))


@query("SELECT l_orderkey, l_linenumber, round(p, 6) AS p, CASE WHEN p >= 0.94 THEN 'merge' WHEN p <= 0.13 THEN 'separate' ELSE 'review' END AS zone FROM (SELECT l_orderkey, l_linenumber, 1 / (1 + exp(-(0.5 + (l_quantity - 25) / 14 * 2 + (l_discount - 0.05) / 0.03 * -1.5))) AS p FROM lineitem)")
def f49_logistic(spark, sf_dir):
    p = text.logistic([F.col("l_quantity"), F.col("l_discount")], [25.0, 0.05], [14.0, 0.03], [2.0, -1.5], 0.5)
    x = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", p.alias("q"))
    return x.select("l_orderkey", "l_linenumber", F.round("q", 6).alias("p"), text.zone(F.col("q"), 0.13, 0.94).alias("zone"))


@query("SELECT event_id, least(user_id, event_id)::VARCHAR AS a, CASE WHEN user_id::VARCHAR < event_id::VARCHAR THEN user_id || ':' || event_id ELSE event_id || ':' || user_id END AS question FROM events")
def f67_question_id(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.least("user_id", "event_id").cast("string").alias("a"), keys.pair_id(F.col("user_id"), F.col("event_id")).alias("question"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k, json_valid(props) AS valid FROM events")
def f55_json(spark, sf_dir):
    v = F.try_parse_json("props")
    return _t(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "int").alias("k"), v.isNotNull().alias("valid"))


@query("""SELECT p_partkey, array_to_string([1] || range(3, p_size + 1), ',') AS numbers FROM part WHERE p_size >= 3""")
def f37_citation_numbers(spark, sf_dir):
    label = F.concat(F.lit("1, 3-"), F.col("p_size"))
    return _t(spark, sf_dir, "part").where("p_size >= 3").select("p_partkey", F.array_join(F.transform(text.citation_numbers(label), lambda x: x.cast("string")), ",").alias("numbers"))


@query("SELECT p_partkey, 'AB-' || p_partkey AS g FROM part")
def f51_grant_id(spark, sf_dir):
    raw = F.concat(F.lit(" ab–"), F.col("p_partkey"), F.lit(" "))
    return _t(spark, sf_dir, "part").select("p_partkey", text.grant_id(raw).alias("g"))


@query("SELECT 1 AS one")
def f10_abstract(spark, sf_dir):
    """An abstract rebuilt from its inverted index is the text's words again; one row says so."""
    words = F.split(text.collapse(F.col("text")), " ")
    d = _t(spark, sf_dir, "conversations").withColumn("id", F.monotonically_increasing_id()).select("id", F.posexplode(words).alias("p", "w"))
    inverted = d.groupBy("id", "w").agg(F.array_sort(F.collect_list("p")).alias("ps")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("m"))
    back = inverted.select("id", text.abstract(F.col("m")).alias("t"))
    raw = _t(spark, sf_dir, "conversations").select(F.monotonically_increasing_id().alias("id"), F.array_join(words, " ").alias("s"))
    return raw.join(back, "id").agg(F.min((F.col("t") == F.col("s")).cast("int")).alias("one"))


@query("SELECT n_nationkey, replace(lower(strip_accents(n_name)), '_', ' ') AS name FROM nation")
def f14_fold_name(spark, sf_dir):
    return _t(spark, sf_dir, "nation").select("n_nationkey", fold_name("n_name").alias("name"))


@query("""WITH k AS (SELECT DISTINCT c_custkey AS e, 'seg' || c_mktsegment || c_nationkey AS key, 40 AS cap, 'segment' AS channel FROM customer UNION ALL SELECT c_custkey, 'bal' || floor(c_acctbal / 10), 90, 'balance' FROM customer),
s AS (SELECT *, count(*) OVER (PARTITION BY channel, key) AS n FROM k)
SELECT a.e AS a, b.e AS b, string_agg(DISTINCT a.channel, ',' ORDER BY a.channel) AS channels FROM s a JOIN s b ON a.channel = b.channel AND a.key = b.key AND a.e < b.e WHERE a.n <= a.cap GROUP BY 1, 2""")
def j12_blocking(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    found = blocking.channel_pairs(c, "c_custkey", {"segment": (F.concat("c_mktsegment", "c_nationkey"), 40), "balance": (F.floor(F.col("c_acctbal") / 10), 90)})
    return found.select("a", "b", F.array_join("channels", ",").alias("channels"))


def j12_version_candidates(spark, sf_dir):
    """Pairs of parts whose names are near, by shared type and brand, with a decision for each."""
    p = _t(spark, sf_dir, "part").withColumn("folded", fold_name("p_name"))
    pairs = blocking.channel_pairs(p, "p_partkey", {"kind": (F.concat_ws("|", "p_type", "p_size"), 45), "brand": (F.concat_ws("|", "p_brand", "p_size"), 45)})
    sides = blocking.with_sides(pairs, p, "p_partkey", ["folded", "p_type"])
    scored = sides.withColumn("ratio", F.round(name_similarity("a_folded", "b_folded"), 6)).withColumn("aligned", F.round(name_alignment("a_folded", "b_folded"), 6))
    rules = [("EXACT", F.col("a_folded") == F.col("b_folded")), ("STRONG", (F.col("ratio") >= 0.95) & (F.col("a_p_type") == F.col("b_p_type"))), ("FUZZY", F.col("ratio") >= 0.8)]
    return scored.select("a", "b", "ratio", "aligned", blocking.first_rule(rules, "NONE").alias("bucket"))


query()(j12_version_candidates)


@query("""WITH k AS (SELECT DISTINCT 'gr' || (p_partkey % 50) || CASE WHEN p_partkey > 100 THEN 'x' || p_partkey ELSE '' END AS k FROM part),
leaves AS (SELECT p.k AS p, q.k AS leaf FROM k p JOIN k q ON starts_with(q.k, p.k) AND q.k <> p.k AND length(p.k) >= 4 WHERE NOT EXISTS (SELECT 1 FROM k r WHERE starts_with(r.k, q.k) AND r.k <> q.k))
SELECT k.k AS code, CASE WHEN count(leaf) = 1 THEN min(leaf) END AS leaf FROM k LEFT JOIN leaves ON k.k = leaves.p GROUP BY k.k""")
def w07_longest_prefix(spark, sf_dir):
    code = F.concat(F.lit("gr"), F.col("p_partkey") % 50, F.when(F.col("p_partkey") > 100, F.concat(F.lit("x"), F.col("p_partkey"))).otherwise(""))
    return blocking.longest_prefix_leaf(_t(spark, sf_dir, "part").select(code.alias("code")), "code")
