"""Versions of a publication: what titles say, pairs of one stem, decisions over them, planned edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import titles
from quillgraph.operators.checkpoints import checkpoint
from quillgraph.plans.derived import derived_query, pick

_STEM = "'study ' || CAST(pid - pid % 10 AS VARCHAR(12)) || ' of graphs'"
_TITLE = f"""CASE pid % 10 WHEN 0 THEN {_STEM} WHEN 1 THEN {_STEM} || '. Part II' WHEN 2 THEN 'Erratum: ' || {_STEM} WHEN 3 THEN 'Front Cover: ' || {_STEM}
WHEN 4 THEN {_STEM} || ': Volume 2' WHEN 5 THEN 'Correction of aberration' WHEN 6 THEN 'Графы ' || CAST(pid AS VARCHAR(12)) WHEN 7 THEN {_STEM} WHEN 8 THEN 'Editorial' ELSE 'Correction to: ' || {_STEM} END"""
_VENUE = pick("pid", ["arXiv", "Journal of Graphs", "Proceedings of X", None, "Lecture Notes", "", "Zenodo"])
_DOI = pick("pid", ["10.48550/arxiv.1", "10.1101/5", "10.11016/7", None, "10.1016/j"])
_T = f", tt AS (SELECT pid, year, type, {_TITLE} AS title, {_VENUE} AS venue, {_DOI} AS doi FROM publications)\n"


def _titled(t):
    return t["publications"].select("pid", "year", "type", "date", F.expr(_TITLE).alias("title"), F.expr(_VENUE).alias("venue"), F.expr(_DOI).alias("doi"))


@derived_query(_T + """SELECT pid, CASE WHEN regexp_matches(title, '(?i)^(erratum|correction to)[: ]') THEN 'study ' || (pid - pid % 10) || ' of graphs' END AS subject FROM tt""")
def f27_notice_subject(t):
    return _titled(t).select("pid", titles.notice_subject(F.col("title")).alias("subject"))


@derived_query(_T + "SELECT n.pid AS notice, o.pid AS original FROM tt n JOIN tt o ON o.title = 'study ' || (n.pid - n.pid % 10) || ' of graphs' WHERE n.pid % 10 IN (2, 9)")
def f27_erratum_of(t):
    """Each notice with the records that have the title it is about."""
    d = _titled(t)
    notices = d.select(F.col("pid").alias("notice"), titles.notice_subject(F.col("title")).alias("s")).where("s IS NOT NULL")
    return notices.join(d.select(F.col("pid").alias("original"), F.col("title").alias("s")), "s").select("notice", "original")


@derived_query(_T + "SELECT n.pid AS cover, o.pid AS article FROM tt n JOIN tt o ON o.title = 'study ' || (n.pid - 3) || ' of graphs' WHERE n.pid % 10 = 3")
def f28_cover_of(t):
    d = _titled(t)
    covers = d.select(F.col("pid").alias("cover"), titles.cover_subject(F.col("title")).alias("s")).where("s IS NOT NULL")
    return covers.join(d.select(F.col("pid").alias("article"), F.col("title").alias("s")), "s").select("cover", "article")


@derived_query(_T + "SELECT pid, CASE pid % 10 WHEN 1 THEN 'part ii' WHEN 4 THEN 'volume 2' END AS marker FROM tt")
def f26_series_marker(t):
    return _titled(t).select("pid", titles.series_marker(F.col("title")).alias("marker"))


@derived_query(_T + "SELECT pid, coalesce(regexp_matches(doi, '^10\\.(48550|1101)/'), false) OR coalesce(venue IN ('arXiv', 'Zenodo'), false) AS preprint, title LIKE 'Граф%' AS cyrillic FROM tt")
def p13_p14_preprints(t):
    return _titled(t).select("pid", titles.is_preprint(F.col("doi"), F.col("venue"), F.col("type")).alias("preprint"), titles.has_cyrillic(F.col("title")).alias("cyrillic"))


@derived_query(_T + """, p AS (SELECT pid, CASE WHEN pid % 3 <> 0 THEN date END AS date FROM publications)
SELECT a.pid, CASE a.pid % 7 WHEN 0 THEN 'repository' WHEN 1 THEN 'journal' WHEN 2 THEN 'conference' WHEN 3 THEN 'unknown' WHEN 4 THEN 'conference' WHEN 5 THEN 'unknown' ELSE 'repository' END AS kind,
coalesce(abs(pa.date - pb.date), abs(a.year - b.year) * 365)::INTEGER AS gap FROM tt a JOIN tt b ON b.pid = a.pid + 1 JOIN p pa ON pa.pid = a.pid JOIN p pb ON pb.pid = b.pid""")
def f29_venue_and_gap(t):
    d = _titled(t).withColumn("date", F.when(F.col("pid") % 3 != 0, F.col("date")))
    b = d.select((F.col("pid") - 1).alias("pid"), F.col("date").alias("date_b"), F.col("year").alias("year_b"))
    gap = titles.day_gap(F.col("date"), F.col("date_b"), F.col("year"), F.col("year_b"))
    return d.join(b, "pid").select("pid", titles.venue_kind(F.col("venue")).alias("kind"), gap.alias("gap"))


_PAIRS = _T + """, pr AS (SELECT a.pid AS a, b.pid AS b, a.title AS ta, b.title AS tb, a.year AS ya, b.year AS yb, a.pid % 7 AS va, b.pid % 7 AS vb,
coalesce(regexp_matches(a.doi, '^10\\.(48550|1101)/'), false) OR coalesce(a.venue IN ('arXiv', 'Zenodo'), false) AS pa, coalesce(regexp_matches(b.doi, '^10\\.(48550|1101)/'), false) OR coalesce(b.venue IN ('arXiv', 'Zenodo'), false) AS pb
FROM tt a JOIN tt b ON a.pid // 10 = b.pid // 10 AND a.pid < b.pid),
bk AS (SELECT a, b, pa, pb, va, vb, CASE WHEN 'Editorial' IN (ta, tb) THEN NULL WHEN a % 10 IN (2, 9) OR b % 10 IN (2, 9) THEN CASE WHEN a % 10 IN (0, 7) OR b % 10 IN (0, 7) THEN 'ERRATUM' END
WHEN a % 10 = 3 OR b % 10 = 3 THEN CASE WHEN a % 10 IN (0, 7) OR b % 10 IN (0, 7) THEN 'COVER' END
WHEN a % 10 IN (0, 1, 4, 7) AND b % 10 IN (0, 1, 4, 7) AND NOT (a % 10 = 0 AND b % 10 = 7) THEN 'SERIES' WHEN ta = tb AND pa <> pb THEN 'PREPRINT' WHEN ta = tb AND abs(ya - yb) <= 3 THEN 'SAME_TITLE' WHEN ta = tb THEN 'FAR' END AS bucket FROM pr)
"""


def _pairs(t):
    """Records of one stem, each two once: the stem is the join key."""
    d = _titled(t).withColumn("stem", F.expr("pid div 10"))
    d = d.withColumns({"notice": titles.notice_subject(F.col("title")), "cover": titles.cover_subject(F.col("title")), "marker": titles.series_marker(F.col("title")), "bare": titles.without_series(F.col("title")), "preprint": titles.is_preprint(F.col("doi"), F.col("venue"), F.col("type")), "kind": titles.venue_kind(F.col("venue"))})
    a, b = (d.select("stem", *[F.col(c).alias(f"{c}_{s}") for c in d.columns if c != "stem"]) for s in "ab")
    return a.join(b, "stem").where("pid_a < pid_b")


def _bucket():
    """The first rule that holds names a pair's bucket; NULL: no candidate."""
    c = F.col
    either = lambda x: c(f"{x}_a").isNotNull() | c(f"{x}_b").isNotNull()
    about = lambda x: F.coalesce(c(f"{x}_a") == c("title_b"), F.lit(False)) | F.coalesce(c(f"{x}_b") == c("title_a"), F.lit(False))
    same = c("title_a") == c("title_b")
    return (
        F.when((c("title_a") == "Editorial") | (c("title_b") == "Editorial"), None)
        .when(about("notice"), "ERRATUM").when(either("notice"), None)
        .when(about("cover"), "COVER").when(either("cover"), None)
        .when((c("bare_a") == c("bare_b")) & ~c("marker_a").eqNullSafe(c("marker_b")), "SERIES")
        .when(same & (c("preprint_a") != c("preprint_b")), "PREPRINT")
        .when(same & (F.abs(c("year_a") - c("year_b")) <= 3), "SAME_TITLE").when(same, "FAR")
    )


@derived_query(_PAIRS + "SELECT a, b, bucket FROM bk WHERE bucket IS NOT NULL")
def f30_pair_buckets(t):
    return _pairs(t).select(F.col("pid_a").alias("a"), F.col("pid_b").alias("b"), _bucket().alias("bucket")).where("bucket IS NOT NULL")


@derived_query(_PAIRS + """SELECT a, b, CASE WHEN pa <> pb THEN 'STRONG' WHEN a % 3 = 0 THEN 'SAME' WHEN (va IN (2, 4) AND vb = 1) OR (vb IN (2, 4) AND va = 1) THEN 'CONFERENCE_JOURNAL' WHEN a % 3 = 1 THEN 'RELATED' ELSE 'UNROUTED' END AS route
FROM bk WHERE bucket IN ('PREPRINT', 'SAME_TITLE', 'FAR')""")
def f31_routes(t):
    """Where a fuzzy pair goes: by its evidence, then by a verdict table (same, other or none), then by its venues."""
    verdict = F.when(F.col("pid_a") % 3 == 0, "same").when(F.col("pid_a") % 3 == 1, "other")
    kinds = F.array_sort(F.array("kind_a", "kind_b"))
    extended = kinds == F.array(F.lit("conference"), F.lit("journal"))
    route = F.when(F.col("preprint_a") != F.col("preprint_b"), "STRONG").when(verdict == "same", "SAME").when(extended, "CONFERENCE_JOURNAL").when(verdict == "other", "RELATED").otherwise("UNROUTED")
    return _pairs(t).withColumn("bucket", _bucket()).where("bucket IN ('PREPRINT', 'SAME_TITLE', 'FAR')").select(F.col("pid_a").alias("a"), F.col("pid_b").alias("b"), route.alias("route"))


_DIRECTED = _PAIRS + """, dr AS (SELECT bucket, CASE WHEN bucket = 'ERRATUM' THEN CASE WHEN a % 10 IN (2, 9) THEN a ELSE b END WHEN bucket = 'COVER' THEN CASE WHEN a % 10 = 3 THEN a ELSE b END
WHEN pa AND NOT pb THEN a WHEN pb AND NOT pa THEN b ELSE b END AS version, a, b FROM bk WHERE bucket IS NOT NULL AND bucket <> 'SERIES')
, pl AS (SELECT version, CASE WHEN version = a THEN b ELSE a END AS pid, bucket FROM dr)
"""


def _directed(t):
    """From the version to the record that stands: notices and covers from themselves, preprints before others, else the later id."""
    p = _pairs(t).withColumn("bucket", _bucket()).where("bucket IS NOT NULL AND bucket <> 'SERIES'")
    first = F.when(F.col("bucket") == "ERRATUM", F.col("notice_a").isNotNull()).when(F.col("bucket") == "COVER", F.col("cover_a").isNotNull()).otherwise(F.col("preprint_a") & ~F.col("preprint_b"))
    return p.select(F.when(first, F.col("pid_a")).otherwise(F.col("pid_b")).alias("version"), F.when(first, F.col("pid_b")).otherwise(F.col("pid_a")).alias("pid"), "bucket")


@derived_query(_DIRECTED + "SELECT version, pid, bucket FROM pl")
def g19_version_direction(t):
    return _directed(t)


@derived_query(_DIRECTED + """SELECT version, pid, CASE WHEN version % 13 = 0 OR pid % 13 = 0 THEN 'withdraw' WHEN version % 4 = 0 THEN 'reject' WHEN version % 4 = 1 THEN 'confirm' WHEN pid % 5 = 0 THEN 'keep' ELSE 'ask' END AS action FROM pl""")
def g20_planned_edges(t):
    """What becomes of a candidate: gone with a deleted record, as answered, kept where it is live, else a question."""
    d = checkpoint(_directed(t))  # read three times
    works = t["publications"].select("pid")
    answers = d.where("version % 4 IN (0, 1)").select("version", "pid", F.when(F.col("version") % 4 == 0, "reject").otherwise("confirm").alias("answer")).distinct()
    live = d.where("pid % 5 = 0").select("version", "pid", F.lit(True).alias("live")).distinct()
    gone = works.where("pid % 13 = 0")
    plan = d.join(answers, ["version", "pid"], "left").join(live, ["version", "pid"], "left")
    plan = plan.join(gone.select(F.col("pid").alias("version"), F.lit(True).alias("g1")), "version", "left").join(gone.select("pid", F.lit(True).alias("g2")), "pid", "left")
    action = F.when(F.coalesce("g1", "g2"), "withdraw").when(F.col("answer").isNotNull(), F.col("answer")).when(F.col("live"), "keep").otherwise("ask")
    return plan.select("version", "pid", action.alias("action"))


@derived_query(_DIRECTED + "SELECT version, pid, bucket FROM pl WHERE bucket = 'ERRATUM' OR (version % 50 < 10 AND pid % 50 < 10)")
def s36_version_edges(t):
    """All edges of a bucket, and those between two sets of members."""
    return _directed(t).where("bucket = 'ERRATUM' OR (version % 50 < 10 AND pid % 50 < 10)")
