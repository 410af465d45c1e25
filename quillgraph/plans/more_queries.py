"""Texts of persons, projections, and files written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillgraph.functions import keys, people, text
from quillgraph.operators import groups
from quillgraph.operators.components import shared_folder
from quillgraph.plans.derived import derived_query, pick
from quillgraph.sources import sinks, stores

_NAME = pick("per", ["Anna Ivanova and Petr Li", "A. Ivanov", "ATLAS Collaboration", "Li; Wu", "Anna Li & Petr Wu", "I. P. Sidorov", "Graph Theory Group", "Sandra Band"])


@derived_query(f""", n AS (SELECT per, {_NAME} AS name FROM persons)
SELECT per, per % 8 IN (2, 6) AS not_a_person, per % 8 IN (0, 4) AS several, per % 8 IN (1, 5) AS initials FROM n""")
def p02_p10_p11_names_of_slots(t):
    """Slots that hold no person, several people, or initials only."""
    n = t["persons"].select("per", F.expr(_NAME).alias("name"))
    return n.select("per", people.not_a_person(F.col("name")).alias("not_a_person"), people.several_people(F.col("name")).alias("several"), text.initials_only(F.col("name")).alias("initials"))


@derived_query("SELECT per, replace(surname, 'Cм', 'См') AS surname FROM people")
def f13_unmixed_names(t):
    return t["people"].select("per", people.unmixed("surname").alias("surname"))


_URL = pick("per", ["https://scholar.google.com/x", "https://GitHub.com/u", "https://www.scopus.com/a", "https://me.example.org", None])


@derived_query("SELECT per, CASE per % 5 WHEN 0 THEN 'scholar' WHEN 1 THEN 'github' WHEN 2 THEN 'scopus' WHEN 3 THEN 'homepage' END AS kind FROM people")
def f62_profile_kinds(t):
    return t["people"].select("per", people.profile_kind(F.expr(_URL)).alias("kind"))


@derived_query("""SELECT per, CASE WHEN internal THEN concat_ws(' ', latin, CASE WHEN given <> '' THEN upper(substr(given, 1, 1)) || '.' END)
ELSE concat_ws(' ', substr(latin, 1, 1) || '.', CASE WHEN given <> '' THEN upper(substr(given, 1, 1)) || '.' END) END AS label FROM people""")
def f53_labels(t):
    return t["people"].select("per", people.label(F.col("latin"), F.col("given"), F.col("internal")).alias("label"))


_ABSTRACT = pick("pid", ["Graphs of x. Write to a.b@example.org", "Cookies are used here", None, "Plain"])


@derived_query("SELECT pid, CASE pid % 4 WHEN 0 THEN 'Graphs of x. Write to' WHEN 3 THEN 'Plain' END AS abstract FROM works")
def f59_public_abstracts(t):
    return t["works"].select("pid", people.public_abstract(F.expr(_ABSTRACT)).alias("abstract"))


@derived_query("SELECT did, trim(regexp_replace(lower(dname), '[^a-z0-9]+', '-', 'g'), '-') AS name FROM departments")
def f70_group_names(t):
    return t["departments"].select("did", people.group_name(F.col("dname")).alias("name"))


_ROR = pick("pid", ["https://ror.org/04TXGXN49", "04txgxn49/", "ror.org/x", None])
_ARXIV = pick("pid", ["https://arxiv.org/abs/2101.00001v2", "arXiv:1905.12345", "10.48550/arXiv.2202.00002", "none", None])


@derived_query("SELECT pid, CASE WHEN pid % 4 < 2 THEN '04txgxn49' END AS ror, CASE pid % 5 WHEN 0 THEN '2101.00001' WHEN 1 THEN '1905.12345' WHEN 2 THEN '2202.00002' END AS arxiv FROM works")
def f03_f25_identifiers(t):
    return t["works"].select("pid", keys.ror(F.expr(_ROR)).alias("ror"), keys.arxiv(F.expr(_ARXIV)).alias("arxiv"))


@derived_query("SELECT per, count(DISTINCT pid % 211) > 30 * greatest(count(DISTINCT pid) // 20, 1) AS pooled FROM wrote GROUP BY per")
def p09_pooled_records(t):
    """Records with far more affiliations than their works explain: several people under one id."""
    works = F.greatest(F.floor(F.count_distinct("pid") / 20), F.lit(1))
    return t["wrote"].groupBy("per").agg((F.count_distinct(F.col("pid") % 211) > 30 * works).alias("pooled"))


@derived_query("SELECT pid, per, row_number() OVER (PARTITION BY pid ORDER BY position, per)::INTEGER AS place, pid % 2 = 0 AS institution FROM wrote")
def p01_work_projection(t):
    """Authorships of a nested work with their places from 1, in the list's order."""
    nested = t["wrote"].groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("position", "per"))).alias("authorships"))
    out = nested.select("pid", F.posexplode("authorships").alias("k", "a"))
    return out.select("pid", "a.per", (F.col("k") + 1).alias("place"), (F.col("pid") % 2 == 0).alias("institution"))


@derived_query("SELECT pid FROM works WHERE pid IN (SELECT pid FROM works WHERE pid % 6 = 0) AND year >= 1995")
def p06_selected(t):
    chosen = t["works"].where("pid % 6 = 0").select("pid")
    return t["works"].where("year >= 1995").join(chosen, "pid", "left_semi").select("pid")


@derived_query(""", al AS (SELECT per AS old, per - per % 4 AS new FROM people WHERE per % 4 <> 0 AND per > 4)
SELECT pid, coalesce(new, per) AS per, min(position) AS position, count(*) AS slots FROM wrote LEFT JOIN al ON old = per GROUP BY 1, 2""")
def a40_display_slots(t):
    """One slot for each person of a work once folded persons are one: the first."""
    aliases = t["people"].where("per % 4 <> 0 AND per > 4").select(F.col("per").alias("old"), (F.col("per") - F.col("per") % 4).alias("new"))
    return groups.repoint(t["wrote"], aliases, "per").groupBy("pid", "per").agg(F.min("position").alias("position"), F.count("*").alias("slots"))


@derived_query(""", r AS (SELECT orcid AS k, per, 'orcid' AS rule FROM people WHERE orcid IS NOT NULL UNION ALL SELECT key, per, 'key' FROM people UNION ALL SELECT latin || '|' || given, per, 'name' FROM people WHERE latin IS NOT NULL AND given IS NOT NULL)
SELECT per, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules, CASE WHEN bool_or(rule = 'orcid') THEN 'identifier' WHEN bool_or(rule = 'key') THEN 'key' ELSE 'name' END AS route
FROM (SELECT *, min(per) OVER (PARTITION BY rule, k) AS first FROM r) WHERE first < per GROUP BY per""")
def a58_merge_report(t):
    """For each duplicate the rules that touched it, and the strongest as its route."""
    p, rules = t["people"], {"orcid": F.col("orcid"), "key": F.col("key"), "name": F.concat(F.col("latin"), F.lit("|"), F.col("given"))}
    out = None
    for rule, k in rules.items():
        part = groups.key_links(p.select("per", k.alias("k")), "per", "k").select(F.col("b").alias("per"), F.lit(rule).alias("rule"))
        out = part if out is None else out.union(part)
    route = F.when(F.bool_or(F.col("rule") == "orcid"), "identifier").when(F.bool_or(F.col("rule") == "key"), "key").otherwise("name")
    return out.groupBy("per").agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"), route.alias("route"))


# Files: written to the shared folder and read from there.


def _folder(df) -> str:
    return f"{shared_folder(df.sparkSession)}/files-{uuid.uuid4().hex}"


@derived_query("SELECT pid, CASE WHEN pid % 2 = 0 THEN 'second' ELSE title END AS title FROM works")
def k24_s23_s24_snapshot(t):
    """A snapshot of two tables, of which a later export rewrites one."""
    w, folder = t["works"].select("pid", "title"), _folder(t["works"])
    sinks.write_snapshot({"odd": w.where("pid % 2 = 1"), "even": w.where("pid % 2 = 0")}, folder)
    sinks.write_snapshot({"odd": w.limit(0), "even": w.where("pid % 2 = 0").withColumn("title", F.lit("second"))}, folder, {"even"})
    return w.sparkSession.read.parquet(f"{folder}/odd", f"{folder}/even")


@derived_query("SELECT did, dname FROM departments")
def k25_c14_site_files(t):
    """Public site files have only the columns that may leave, and tables without any are not written."""
    folder = _folder(t["departments"])
    sinks.write_site({"departments": t["departments"], "people": t["people"]}, folder, {"departments": ["did", "dname"]})
    return t["departments"].sparkSession.read.schema("did long, dname string").json(f"{folder}/departments").select(F.col("did").cast(t["departments"].schema["did"].dataType).alias("did"), "dname")


@derived_query("""SELECT rid, 'a "b", ' || url AS note FROM code""")
def k26_report_file(t):
    """A report's rows as CSV: quotes are doubled, so commas and quotes survive."""
    rows = t["code"].select("rid", F.concat(F.lit('a "b", '), "url").alias("note"))
    folder = _folder(rows)
    sinks.write_report(rows, folder)
    return rows.sparkSession.read.option("header", True).option("escape", '"').option("lineSep", "\r\n").schema("rid long, note string").csv(folder).select(F.col("rid").cast(rows.schema["rid"].dataType).alias("rid"), "note")


@derived_query("SELECT per AS id, 'Person' AS labels, latin FROM people")
def s17_s19_node_files(t):
    """Node files with properties as JSON text, read as variants."""
    rows = t["people"].select("per", F.lit("Person").alias("labels"), F.to_json(F.struct("latin")).alias("properties"))
    folder = _folder(rows)
    rows.select(F.col("per").alias("id"), "labels", "properties").write.option("header", True).option("escape", '"').csv(folder)
    read = stores.node_files(rows.sparkSession, folder)
    return read.select(F.col("id").cast(rows.schema["per"].dataType).alias("id"), "labels", F.try_variant_get("properties", "$.latin", "string").alias("latin"))


@derived_query("SELECT per AS start_id, pid AS end_id, position FROM wrote")
def s18_edge_files(t):
    rows = t["wrote"].select(F.col("per").alias("start_id"), F.col("pid").alias("end_id"), F.lit("Person").alias("src_label"), F.lit("Work").alias("tgt_label"), F.lit("AUTHORED").alias("type"), F.to_json(F.struct("position")).alias("properties"))
    folder, kinds = _folder(rows), t["wrote"].schema
    rows.write.option("header", True).option("escape", '"').csv(folder)
    read = stores.edge_files(rows.sparkSession, folder)
    return read.select(F.col("start_id").cast(kinds["per"].dataType).alias("start_id"), F.col("end_id").cast(kinds["pid"].dataType).alias("end_id"), F.try_variant_get("properties", "$.position", "int").cast(kinds["position"].dataType).alias("position"))


@derived_query("SELECT DISTINCT (pid % 500)::VARCHAR AS id FROM works")
def s20_id_list_file(t):
    """An id for each line, blank ones dropped."""
    folder = _folder(t["works"])
    t["works"].select(F.when(F.col("pid") % 2 == 0, F.concat(F.lit(" "), (F.col("pid") % 500).cast("string"))).otherwise((F.col("pid") % 500).cast("string")).alias("v")).union(t["works"].select(F.lit(" "))).write.text(folder)
    return stores.id_list(t["works"].sparkSession, folder)


@derived_query("SELECT pid AS id, title AS payload FROM works WHERE pid % 2 = 0 AND pid % 3 = 1")
def k01_s08_raw_log(t):
    """Envelopes appended to the log by source, and one group of one source read back."""
    even = F.when(F.col("pid") % 2 == 0, "s0").otherwise("s1")
    rows = t["works"].select(even.alias("source"), F.concat(F.lit("g"), (F.col("pid") % 3).cast("string")).alias("group"), F.timestamp_seconds("pid").alias("fetched_at"), F.col("pid").cast("string").alias("request"), F.col("title").alias("payload"), F.lit("p").alias("provider"), F.lit("work").alias("record_type"), F.col("pid").cast("string").alias("record_key"), F.lit(2).alias("schema_version"))
    folder = _folder(rows)
    sinks.append_raw(rows.where("record_key < '5'"), folder)
    sinks.append_raw(rows.where("record_key >= '5'"), folder)
    return stores.raw(rows.sparkSession, folder, "s0", "g1").select(F.col("record_key").cast(t["works"].schema["pid"].dataType).alias("id"), "payload")
