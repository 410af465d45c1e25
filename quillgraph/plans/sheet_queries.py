"""Markup, addresses in pages, given names and sheets for labelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions.given import given_channels, given_fit
from quillgraph.functions.markup import emails_in_html, without_markup
from quillgraph.functions.wraps import unwrapped
from quillgraph.operators.readings import confirmed_readings
from quillgraph.plans.derived import derived_query

_GIVEN = "regexp_replace(lower(given), '[^a-z]', '', 'g')"


@derived_query("SELECT pid, title || CASE pid % 4 WHEN 0 THEN ' of CaF2 films' WHEN 1 THEN ' of Ag2B5 (WSe2) & Y' WHEN 2 THEN ' in CaCO3, x' ELSE '' END AS clean FROM works")
def f09_markup(t):
    """Titles without markup."""
    raw = (
        F.when(F.col("pid") % 4 == 0, " of CaF <sub>2</sub>  films")
        .when(F.col("pid") % 4 == 1, " of Ag <sub>2</sub> B <sub>5</sub> ( <mml:math> <mml:mi>WSe</mml:mi> <mml:mn>2</mml:mn> </mml:math> ) &amp; <i>Y</i>")
        .when(F.col("pid") % 4 == 2, " in CaCO-=SUB=-3-=/SUB=- , x")
        .otherwise("")
    )
    return t["works"].select("pid", without_markup(F.concat("title", raw)).alias("clean"))


@derived_query("SELECT per, coalesce(lower(email), '') AS emails FROM people")
def f39_emails_in_html(t):
    """Addresses of a page, in each way that pages write them."""
    way, email = F.col("per") % 4, F.col("email")
    page = (
        F.when(way == 0, F.concat(F.lit('<a href="mailto:'), email, F.lit('">write</a>')))
        .when(way == 1, F.concat(F.lit("<p>"), F.replace(F.replace(email, F.lit("@"), F.lit(" [at] ")), F.lit("."), F.lit(" (dot) ")), F.lit(" </p>")))
        .when(way == 2, F.concat(F.lit("<p>"), F.replace(email, F.lit("@"), F.lit("&#64;")), F.lit("</p>")))
        .otherwise(F.concat(F.lit("<p>"), F.replace(F.upper(email), F.lit("@"), F.lit(" @ ")), F.lit("</p>")))
    )
    return t["people"].select("per", F.array_join(emails_in_html(page), ",").alias("emails"))


@derived_query(f""", g AS (SELECT per, {_GIVEN} AS n FROM people)
SELECT per, CASE WHEN coalesce(n, '') = '' THEN '' ELSE array_to_string(list_sort(list_distinct(list_concat(['initial:' || substr(n, 1, 1)], CASE WHEN length(n) >= 3 THEN list_transform(range(1, length(n)), lambda i: 'gram:' || substr(n, i, 2)) ELSE [] END))), ',') END AS channels FROM g""")
def f18_given_channels(t):
    """The channels of each person's given name."""
    name = F.regexp_replace(F.lower("given"), "[^a-z]", "")
    return t["people"].select("per", F.array_join(given_channels(name), ",").alias("channels"))


@derived_query(f""", g AS (SELECT DISTINCT pid, coalesce({_GIVEN}, '') AS n FROM wrote JOIN people USING (per)), p AS (SELECT x.n AS a, y.n AS b, count(*) AS works FROM g x JOIN g y USING (pid) WHERE x.n < y.n GROUP BY ALL)
SELECT a, b, works, a = '' OR substr(a, 1, 1) = substr(b, 1, 1) AS fits FROM p""")
def f18_given_fit(t):
    """Which of the given names that meet on works can be one person's. The names here are alike in their initials only; a test has others."""
    named = t["people"].select("per", F.coalesce(F.regexp_replace(F.lower("given"), "[^a-z]", ""), F.lit("")).alias("n"))
    met = t["wrote"].join(named, "per").select("pid", "n").distinct()
    pairs = met.select("pid", F.col("n").alias("a")).join(met.select("pid", F.col("n").alias("b")), "pid").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("works")).withColumn("fits", given_fit(F.col("a"), F.col("b")))


@derived_query("""SELECT l.pid, coalesce(title, '') AS title, coalesce(doi, '') AS doi, l.url, coalesce(relevant::VARCHAR, '') AS verdict,
CASE WHEN lower(l.url) IN (SELECT lower(rtrim(url, '/')) FROM code WHERE url IS NOT NULL) THEN 'yes' ELSE 'not_checked' END AS resolved FROM links l LEFT JOIN works USING (pid)""")
def i28_link_sheet(t):
    """A row for each link of a work, with what a reader needs to label it."""
    known = t["code"].select(F.lower(F.regexp_replace("url", "/+$", "")).alias("u")).where("u IS NOT NULL").distinct().withColumn("found", F.lit("yes"))
    rows = t["links"].join(t["works"].select("pid", "title", "doi"), "pid", "left").withColumn("u", F.lower("url")).join(known, "u", "left")
    blank = F.lit("")
    return rows.select("pid", F.coalesce("title", blank).alias("title"), F.coalesce("doi", blank).alias("doi"), "url", F.coalesce(F.col("relevant").cast("string"), blank).alias("verdict"), F.coalesce("found", F.lit("not_checked")).alias("resolved"))


@derived_query("""SELECT pid, coalesce(title, '') AS title, coalesce(doi, '') AS doi, CASE WHEN coalesce(abstract, '') <> '' THEN 'yes' ELSE 'no' END AS has_abstract, coalesce(urls, '') AS urls
FROM works LEFT JOIN (SELECT pid, string_agg(DISTINCT url, ' ' ORDER BY url) AS urls FROM links GROUP BY pid) USING (pid) WHERE has_code""")
def i28_paper_sheet(t):
    """A row for each work that can be read, with the links taken from it."""
    urls = t["links"].groupBy("pid").agg(F.array_join(F.array_sort(F.collect_set("url")), " ").alias("urls"))
    blank = F.lit("")
    has = F.when(F.coalesce("abstract", blank) != "", "yes").otherwise("no")
    return t["works"].where("has_code").join(urls, "pid", "left").select("pid", F.coalesce("title", blank).alias("title"), F.coalesce("doi", blank).alias("doi"), has.alias("has_abstract"), F.coalesce("urls", blank).alias("urls"))


@derived_query("""SELECT rid, array_to_string(CASE rid % 4 WHEN 0 THEN ['https://github.com/owner/r' || rid, 'https://github.com/own-er/r' || rid] WHEN 1 THEN ['https://github.com/own/r_', 'https://github.com/own/r_' || rid]
WHEN 2 THEN ['https://github.com/own/r' || rid] ELSE [] END, ' ') AS candidates FROM code""")
def f33_wrapped_addresses(t):
    """What each address that a line end cuts can have been."""
    end = F.col("rid").cast("string")
    raw = (
        F.when(F.col("rid") % 4 == 0, F.concat(F.lit("https://github.com/own-\n  er/r"), end))
        .when(F.col("rid") % 4 == 1, F.concat(F.lit("https://github.com/own/r_\n"), end, F.lit(".")))
        .when(F.col("rid") % 4 == 2, F.concat(F.lit("https://github.com/own/r"), end, F.lit("-).")))
        .otherwise(F.concat(F.lit("https://example.org/own-\n/r"), end))
    )
    return t["code"].select("rid", F.array_join(unwrapped(raw), " ").alias("candidates"))


@derived_query(""", m AS (SELECT rid, rid // 40 AS doc, (rid // 4) % 10 AS k FROM code WHERE rid % 4 = 0 OR (rid % 4 = 1 AND (rid // 4) % 2 = 0))
, w AS (SELECT *, rid % 4 = 1 OR (k % 2 = 0 AND rid + 1 IN (SELECT rid FROM m)) AS settled FROM m)
SELECT doc, rid AS mention, 'https://github.com/owner/r' || k AS url, settled FROM w UNION ALL SELECT doc, rid, 'https://github.com/own-er/r' || k, false FROM w WHERE NOT settled""")
def f34_confirmed_addresses(t):
    """Readings of cut addresses, less those that the same document rules out by writing another in full."""
    k = F.expr("rid div 4 % 10")
    cut = F.concat(F.lit("https://github.com/own-\ner/r"), k)
    whole = F.concat(F.lit("https://github.com/owner/r"), k)
    some = t["code"].where("rid % 4 = 0 OR (rid % 4 = 1 AND rid div 4 % 2 = 0)")
    return confirmed_readings(some.select(F.expr("rid div 40").alias("doc"), F.col("rid").alias("mention"), F.when(F.col("rid") % 4 == 0, cut).otherwise(whole).alias("raw")))
