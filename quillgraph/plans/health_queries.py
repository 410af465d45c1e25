"""Health checks. Those that look at one row each share a scan of their table; the others are joins and groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import health
from quillgraph.plans.derived import derived_query


def _blank(c: str):
    return F.coalesce(F.trim(c), F.lit("")) == ""


@derived_query("""SELECT unnest(['h01', 'h05', 'h06', 'h12', 'h13', 'h14', 'h15']) AS check_name, unnest([
count(*) FILTER (internal AND did IS NULL), count(*) FILTER (internal AND coalesce(trim(surname), '') = ''), count(*) FILTER (internal AND coalesce(trim(second), '') = ''),
count(*) FILTER (regexp_matches(surname, '[\\x{0300}-\\x{036F}]')), count(*) FILTER (length(trim(replace(latin, '.', ''))) = 1),
count(*) FILTER (regexp_full_match(surname, '[A-Za-z][A-Za-z .-]*')), count(*) FILTER (trim(given) <> '' AND length(trim(given)) <= 2)]) AS n, count(*) AS total FROM people""")
def h01_h05_h06_h12_h13_h14_h15_person_checks(t):
    """Staff without a department, without a native name, without a patronymic; marks, one letter, Latin only, initials in names."""
    return health.count_checks(t["people"], {
        "h01": F.col("internal") & F.col("did").isNull(),
        "h05": F.col("internal") & _blank("surname"),
        "h06": F.col("internal") & _blank("second"),
        "h12": F.col("surname").rlike("[̀-ͯ]"),
        "h13": F.length(F.trim(F.replace("latin", F.lit("."), F.lit("")))) == 1,
        "h14": F.col("surname").rlike("^[A-Za-z][A-Za-z .-]*$"),
        "h15": (F.trim("given") != "") & (F.length(F.trim("given")) <= 2),
    })


@derived_query("""SELECT 'h11' AS check_name, count(*) FILTER (regexp_matches(surname, '\\p{Cyrillic}') AND regexp_matches(surname, '\\p{Latin}')) AS n, count(*) AS total FROM people""")
def h11_mixed_script(t):
    from quillgraph.functions.text import mixed_script

    return health.count_checks(t["people"], {"h11": mixed_script(F.col("surname"))})


@derived_query("""SELECT 'h04' AS check_name, count(*) FILTER (coalesce(abstract, '') = '') AS n, count(*) AS total FROM works""")
def h04_no_abstract(t):
    return health.count_checks(t["works"], {"h04": F.coalesce("abstract", F.lit("")) == ""})


@derived_query("""SELECT unnest(['h07', 'h10']) AS check_name, unnest([count(*) FILTER (coalesce(trim(native), '') = ''), count(*) FILTER (variants IS NULL)]) AS n, count(*) AS total FROM units""")
def h07_h10_department_checks(t):
    variants = F.when(F.col("variants").isNotNull(), F.array("variants"))
    return health.count_checks(t["units"], {"h07": _blank("native"), "h10": F.size(F.coalesce(variants, F.array().cast("array<string>"))) == 0})


@derived_query("""SELECT unnest(['h09', 'h33']) AS check_name, unnest([count(*) FILTER (coalesce(affiliation, '') = ''), count(*) FILTER (pid = per)]) AS n, count(*) AS total FROM wrote""")
def h09_h33_edge_checks(t):
    return health.count_checks(t["wrote"], {"h09": F.coalesce("affiliation", F.lit("")) == "", "h33": F.col("pid") == F.col("per")})


@derived_query("""SELECT 'h16' AS check_name, (SELECT coalesce(sum(k - 1), 0)::BIGINT FROM (SELECT count(*) AS k FROM people WHERE orcid IS NOT NULL GROUP BY orcid)) AS n
UNION ALL SELECT 'h18', (SELECT coalesce(sum(k - 1), 0)::BIGINT FROM (SELECT count(*) AS k FROM people WHERE latin IS NOT NULL AND given IS NOT NULL GROUP BY lower(latin), lower(substr(given, 1, 1)) HAVING count(DISTINCT did) > 1))
UNION ALL SELECT 'h19', (SELECT coalesce(sum(k - 1), 0)::BIGINT FROM (SELECT count(DISTINCT regexp_replace(key, '^(orcid|name)_', '')) AS k FROM people WHERE coalesce(surname, '') <> '' GROUP BY lower(trim(surname))))""")
def h16_h18_h19_repeated_people(t):
    """Persons that share an ORCID; a short signature over several departments; a name whose raw ids differ once their prefixes are gone."""
    p = t["people"]
    excess = lambda rows: rows.agg(F.coalesce(F.sum("excess"), F.lit(0)).alias("n"))
    signed = p.where("latin IS NOT NULL AND given IS NOT NULL").groupBy(F.lower("latin"), F.lower(F.substring("given", 1, 1)))
    short = signed.agg((F.count("*") - 1).alias("excess"), F.count_distinct("did").alias("d")).where("d > 1")
    raw = p.where("surname <> ''").groupBy(F.lower(F.trim("surname"))).agg((F.count_distinct(F.regexp_replace("key", "^(orcid|name)_", "")) - 1).alias("excess"))
    parts = {"h16": health.excess(p, F.col("orcid")), "h18": short, "h19": raw}
    found = [excess(x).select(F.lit(k).alias("check_name"), "n") for k, x in parts.items()]
    return found[0].union(found[1]).union(found[2])


@derived_query("""SELECT 'h20' AS check_name, (SELECT sum(k - 1)::BIGINT FROM (SELECT count(*) AS k FROM works GROUP BY lower(trim(title)))) AS n
UNION ALL SELECT 'h21', (SELECT sum(k - 1)::BIGINT FROM (SELECT count(*) AS k FROM works WHERE doi IS NOT NULL GROUP BY lower(trim(doi))))
UNION ALL SELECT 'h22', (SELECT sum(k - 1)::BIGINT FROM (SELECT count(*) AS k FROM code GROUP BY lower(rtrim(url, '/'))))""")
def h20_h21_h22_repeated_records(t):
    """Titles, DOIs and repository addresses (in any case) that repeat."""
    parts = {"h20": health.excess(t["works"], F.lower(F.trim("title"))), "h21": health.excess(t["works"], F.lower(F.trim("doi"))), "h22": health.excess(t["code"], F.lower(F.regexp_replace("url", "/+$", "")))}
    found = [x.agg(F.coalesce(F.sum("excess"), F.lit(0)).alias("n")).select(F.lit(k).alias("check_name"), "n") for k, x in parts.items()]
    return found[0].union(found[1]).union(found[2])


@derived_query("""SELECT 'h25' AS check_name, (SELECT count(DISTINCT pid) FROM repo_pubs JOIN works USING (pid) WHERE NOT has_code) AS n
UNION ALL SELECT 'h26', (SELECT count(*) FROM works WHERE has_code AND pid NOT IN (SELECT pid FROM repo_pubs))
UNION ALL SELECT 'h27', (SELECT count(*) FROM code WHERE NOT regexp_full_match(url, 'https://github\\.com/[^/]+/[^/]+/?'))
UNION ALL SELECT 'h28', (SELECT count(*) FROM links WHERE relevant AND lower(url) NOT IN (SELECT lower(rtrim(url, '/')) FROM code))
UNION ALL SELECT 'h29', (SELECT count(*) FROM links WHERE relevant IS NULL)
UNION ALL SELECT 'h30', (SELECT count(*) FROM code WHERE owner IS NULL)
UNION ALL SELECT 'h31', (SELECT count(*) FROM people WHERE login IS NOT NULL AND per NOT IN (SELECT a.per FROM authorship a JOIN repo_pubs USING (pid)))""")
def h25_h26_h27_h28_h29_h30_h31_code_checks(t):
    """Code without its flag and the reverse, odd addresses, links without a repository or a verdict, repositories without an owner, profiles without one."""
    implemented = t["repo_pubs"].select("pid").distinct()
    address = lambda c: F.lower(F.regexp_replace(c, "/+$", ""))
    active = t["authorship"].join(implemented, "pid", "left_semi").select("per")
    known = t["code"].select(address("url").alias("u")).distinct()
    parts = {
        "h25": t["works"].where("NOT has_code").join(implemented, "pid", "left_semi"),
        "h26": t["works"].where("has_code").join(implemented, "pid", "left_anti"),
        "h27": t["code"].where(~F.col("url").rlike(r"^https://github\.com/[^/]+/[^/]+/?$")),
        "h28": t["links"].where("relevant").withColumn("u", F.lower("url")).join(known, "u", "left_anti"),
        "h29": t["links"].where("relevant IS NULL"),
        "h30": t["code"].where("owner IS NULL"),
        "h31": t["people"].where("login IS NOT NULL").join(active, "per", "left_anti"),
    }
    out = None
    for k, rows in parts.items():
        n = rows.agg(F.count("*").alias("n")).select(F.lit(k).alias("check_name"), "n")
        out = n if out is None else out.union(n)
    return out


@derived_query("""SELECT 'fine' AS check_name, 0::BIGINT AS n, count(*) AS total, 0.0::DOUBLE AS share, 'ok' AS status FROM works UNION ALL SELECT 'broken', NULL, NULL, NULL, 'failed'""")
def h36_isolated_failure(t):
    checks = [health.Check("fine", lambda x: x["works"].where("pid < 0"), "works"), health.Check("broken", lambda x: x["works"].where("no_such_column = 1"), "works")]
    return health.worst_first(health.run_isolated(checks, t))


@derived_query(""", keys AS (SELECT doi AS k, min(pid) AS owner FROM works WHERE doi IS NOT NULL AND pid % 5 <> 0 GROUP BY doi)
SELECT 'key_owner' AS check_name, (SELECT count(*) FROM works w JOIN keys ON w.doi = k WHERE owner <> pid) AS n
UNION ALL SELECT 'duplicate_doi', (SELECT count(*) FROM (SELECT doi FROM works WHERE doi IS NOT NULL GROUP BY doi HAVING count(*) > 1))
UNION ALL SELECT 'dangling_reference', (SELECT count(*) FROM wrote WHERE per NOT IN (SELECT per FROM people WHERE per % 9 <> 0))
UNION ALL SELECT 'orphan_record', (SELECT count(*) FROM people WHERE per NOT IN (SELECT per FROM wrote WHERE position = 1))
UNION ALL SELECT 'dangling_source_author', (SELECT count(DISTINCT per) FROM wrote WHERE per % 9 = 0)""")
def h37_a24_identity_checks(t):
    """Keys whose owner is another record, repeated DOIs, references to no record, records without a reference; each both ways."""
    w, p, a = t["works"], t["people"], t["wrote"]
    keys = w.where("doi IS NOT NULL AND pid % 5 <> 0").groupBy(F.col("doi").alias("k")).agg(F.min("pid").alias("owner"))
    known = p.where("per % 9 <> 0").select("per")
    parts = {
        "key_owner": w.join(keys, w["doi"] == keys["k"]).where("owner <> pid"),
        "duplicate_doi": w.where("doi IS NOT NULL").groupBy("doi").count().where("count > 1"),
        "dangling_reference": a.join(known, "per", "left_anti"),
        "orphan_record": p.join(a.where("position = 1").select("per"), "per", "left_anti"),
        "dangling_source_author": a.select("per").distinct().join(known, "per", "left_anti"),
    }
    out = None
    for k, rows in parts.items():
        n = rows.agg(F.count("*").alias("n")).select(F.lit(k).alias("check_name"), "n")
        out = n if out is None else out.union(n)
    return out


@derived_query("SELECT count(DISTINCT (pid, doi)) AS n FROM works WHERE doi IN (SELECT doi FROM works WHERE doi IS NOT NULL GROUP BY doi HAVING count(DISTINCT pid) > 1)")
def a22_publications_of_shared_dois(t):
    """Publications whose normalised DOI another has too, each once."""
    from quillgraph.functions.keys import doi

    w = t["works"].where("doi IS NOT NULL").select("pid", doi(F.col("doi")).alias("doi")).distinct()
    shared = w.groupBy("doi").agg(F.count("*").alias("k")).where("k > 1")
    return shared.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"))
