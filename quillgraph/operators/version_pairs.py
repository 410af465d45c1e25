"""Pairs of records that may be versions of one work: one bucket each, by the first rule that holds, and where a doubtful one goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.names import name_similarity, name_similarity_from
from quillgraph.functions.titles import day_gap, has_cyrillic
from quillgraph.functions.version_titles import facts, shingles
from quillgraph.operators.blocking import with_sides

# Registrants and names of preprint servers; names of conferences' venues.
PREPRINT_DOI = r"(?i)^10\.(?:48550/arxiv\.|(?:1101|21203|31219|26434|20944|31234|2139|35542|13140|55458|32942|33774)/)"
PREPRINT_VENUE = r"(?i)arxiv|biorxiv|medrxiv|chemrxiv|techrxiv|research\s*square|ssrn|preprints\.org|\bosf\b|\brepec\b|authorea|figshare|zenodo|\bhal\b|working paper|preprint|cold spring harbor"
CONFERENCE = r"(?i)conference|proceedings|symposium|workshop|congress|colloquium|\bconf\b|\bproc\.|papersonline|lecture notes in|procedia|advances in intelligent systems|communications in computer and information science|studies in health technology|web of conferences|\bceur\b|\bspie\b|^\d{4}\s"
#: How alike a notice's, a cover's, a series' and a title's wording must be at least; less tells nothing.
NOTICE, COVER, SERIES, TITLE = 0.75, 0.9, 0.9, 0.75
#: Fewer words than this tell no work.
LEAST = 4
YEAR = 365
RECORD = ["title", "type", "doi", "venue", "venue_type", "date", "year", "authors", "shingles", "t", "preprint", "cyrillic", "kind"]


def read_records(records: DataFrame) -> DataFrame:
    """records (id, title, type, doi, venue, venue_type, date, year, abstract, authors) with what each says by itself, so that pairs only compare."""
    c, no = F.col, F.lit(False)
    venue, of = F.coalesce(c("venue"), F.lit("")), F.lower(F.coalesce(c("venue_type"), F.lit("")))
    kind = F.when((of == "repository") | venue.rlike(PREPRINT_VENUE), None).when((of == "conference") | venue.rlike(CONFERENCE), "conference").when((of == "journal") | ((of == "") & (venue != "")), "journal")
    doi = F.nullif(F.regexp_replace(F.lower(F.trim("doi")), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", ""), F.lit(""))
    return records.withColumn("doi", doi).withColumns({
        "t": facts("title", "type"), "shingles": shingles("abstract"), "kind": kind, "authors": F.array_distinct(F.array_compact(F.coalesce("authors", F.array().cast(records.schema["authors"].dataType)))),
        "preprint": F.coalesce(c("doi").rlike(PREPRINT_DOI), no) | venue.rlike(PREPRINT_VENUE) | F.coalesce(F.lower("type") == "preprint", no), "cyrillic": has_cyrillic(c("title")) | has_cyrillic(c("venue")),
    })


def _jaccard(x: Column, y: Column) -> Column:
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))


def _alike(ratio: Column, words_x: Column, words_y: Column) -> Column:
    """The better of shared words (an order that differs) and matching blocks (spelling that differs); 0 for NULLs."""
    return F.greatest(F.coalesce(_jaccard(words_x, words_y), F.lit(0.0)), F.coalesce(ratio, F.lit(0.0)))


def _about(this: str, that: str) -> Column:
    """A notice of this record is about that one: its title, words of it in a row that are enough, or a close wording."""
    subject, base = F.col(f"{this}_t.notice"), F.col(f"{that}_t.folded")
    space = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    enough = lambda x: F.size(F.split(x, " ")) >= LEAST
    within = (F.contains(space(base), space(subject)) & enough(subject)) | (F.contains(space(subject), space(base)) & enough(base))
    near = F.col(f"{this}_alike_notice") >= NOTICE
    return F.coalesce((subject != "") & (base != "") & ((subject == base) | within | near), F.lit(False))


def _covers(this: str, that: str) -> Column:
    base = F.col(f"{that}_t.folded")
    marked = (F.col(f"{this}_t.cover") != "") & (base != "") & ((F.col(f"{this}_t.cover") == base) | (F.col(f"{this}_alike_cover") >= COVER))
    same_venue = F.lower(F.nullif("a_venue", F.lit(""))) == F.lower(F.nullif("b_venue", F.lit("")))
    return F.coalesce(marked, F.lit(False)) | F.coalesce(same_venue & (F.col(f"{this}_t.ruled") == base), F.lit(False))


def _series() -> Column:
    """Parts of one series: a stem with other markers, bare numbers at the end, numbers after one name, or other Roman numerals."""
    c = lambda x: (F.col(f"a_t.{x}"), F.col(f"b_t.{x}"))
    (fa, fb), (sa, sb), (na, nb), (ba, bb), (pa, pb), (ka, kb) = c("folded"), c("stem"), c("number"), c("bare"), c("before"), c("skeleton")
    no = F.lit(False)
    named = (na != nb) & (F.col("alike_series") >= SERIES)
    return (fa != fb) & (((sa == sb) & (sa != "")) | F.coalesce((ba != bb) & (pa == pb), no) | (ka == kb)) | F.coalesce(named, no)


def classified(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """``(a, b, bucket, first, title_sim, abstract_sim, gap, split, kinds)`` of pairs that are candidates; ``records`` as read_records gives them.

    first: for ERRATUM and COVER the notice or cover, else NULL. Pairs that no rule holds for are left out. NULL titles, and titles of front
    matter, make no pair; NULL dates say nothing. Matching blocks are looked for only where a bound lets them be enough, and then for the pairs that are found.
    """
    c, no = F.col, F.lit(False)
    p = with_sides(pairs, records, "id", RECORD)
    sides = [("a", "b"), ("b", "a")]
    for this, that in sides:
        for what, least in (("notice", NOTICE), ("cover", COVER)):
            ratio = name_similarity_from(f"{this}_t.{what}", f"{that}_t.folded", F.lit(least))
            p = p.withColumn(f"{this}_alike_{what}", F.when(c(f"{this}_t.{what}").isNotNull(), _alike(ratio, c(f"{this}_t.{what}_tokens"), c(f"{that}_t.tokens"))))
    p = p.withColumn("ratio", name_similarity_from("a_t.folded", "b_t.folded", F.lit(TITLE)))
    shared = F.size(F.array_intersect("a_authors", "b_authors"))
    p = p.withColumns({
        "alike_series": name_similarity_from("a_t.series", "b_t.series", F.lit(SERIES)), "jaccard": _jaccard(c("a_t.tokens"), c("b_t.tokens")), "sim": _alike(c("ratio"), c("a_t.tokens"), c("b_t.tokens")),
        "shared": shared, "author_jaccard": _jaccard(c("a_authors"), c("b_authors")), "abstract_sim": F.when(c("a_shingles").isNotNull() & c("b_shingles").isNotNull(), _jaccard(c("a_shingles"), c("b_shingles"))),
        "gap": day_gap(c("a_date"), c("b_date"), c("a_year"), c("b_year")), "split": c("a_preprint") != c("b_preprint"), "words": F.least("a_t.words", "b_t.words"),
    })
    within = lambda days: F.coalesce(c("gap") <= days, F.lit(True))
    abstracts = lambda least: F.coalesce(c("abstract_sim") >= least, no)
    rest = lambda x, y: F.when(F.startswith(y, x), F.substring(y, F.length(x) + 1, F.length(y)))
    tag = F.coalesce(rest(c("a_doi"), c("b_doi")), rest(c("b_doi"), c("a_doi")))
    sibling = F.coalesce((c("a_doi") != c("b_doi")) & tag.rlike(r"(?i)^\.v?\d{1,3}$"), no)
    paper, enough, deposit = c("a_t.paper") & c("b_t.paper"), c("words") >= LEAST, c("a_t.deposit") | c("b_t.deposit")
    about, covers = [_about(*s) for s in sides], [_covers(*s) for s in sides]
    notices = c("a_t.notice").isNotNull() | c("b_t.notice").isNotNull()
    bucket = (
        F.when(c("a_t.generic") | c("b_t.generic"), None)
        .when(about[0] | about[1], "ERRATUM").when(notices, None)
        .when(covers[0] | covers[1], "COVER").when(_series(), "SERIES_NOT_VERSION")
        .when(deposit, F.when(c("jaccard") >= 0.5, "SUPPLEMENT_OR_REVIEW"))
        .when((c("a_t.folded") == c("b_t.folded")) & ~c("a_doi").eqNullSafe(c("b_doi")) & enough & paper, "MISSED_BY_NORM")
        .when(sibling, F.when((c("sim") >= TITLE) & enough & paper, "DOI_SIBLING").otherwise("SUPPLEMENT_OR_REVIEW"))
        .when(~enough | ~paper | (c("sim") < TITLE), None)
        .when(c("split") & (c("sim") >= 0.8) & (c("shared") > 0) & within(3 * YEAR), "PREPRINT_PUBLISHED")
        .when((c("a_cyrillic") != c("b_cyrillic")) & ((c("shared") > 0) | abstracts(0.4)), "RU_EN_TRANSLATION")
        .when((c("sim") >= 0.9) & ((c("author_jaccard") >= 0.3) | (c("shared") >= 2)) & within(1100), "STRONG_FUZZY")
        .when((c("sim") >= 0.78) & ((c("author_jaccard") >= 0.5) | abstracts(0.45)) & within(4 * YEAR), "MEDIUM_FUZZY")
    )
    first = F.when(c("bucket") == "ERRATUM", F.when(about[0], c("a")).otherwise(c("b"))).when(c("bucket") == "COVER", F.when(covers[0], c("a")).otherwise(c("b")))
    found = p.withColumn("bucket", bucket).where("bucket IS NOT NULL")
    # a ratio too small for any rule was not counted, but is told
    small = name_similarity(F.when(c("ratio").isNull(), c("a_t.folded")), c("b_t.folded"))
    sim = F.greatest("sim", F.coalesce(small, F.lit(0.0)))
    return found.select("a", "b", "bucket", first.alias("first"), F.round(sim, 3).alias("title_sim"), F.round("abstract_sim", 3).alias("abstract_sim"), "gap", "split", F.array_sort(F.array("a_kind", "b_kind")).alias("kinds"))


def routed(found: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of ``classified`` with ``route``: MEDIUM_FUZZY by its evidence, then by verdicts (a, b, same_work), then by its venues; other buckets keep their name.

    A pair with no verdict, or a NULL one, stays MEDIUM_FUZZY. Verdicts are one for a pair.
    """
    c, no = F.col, F.lit(False)
    strong = c("split") | F.coalesce(c("abstract_sim") >= 0.45, no)
    extended = F.coalesce(c("kinds") == F.array(F.lit("conference"), F.lit("journal")), no)
    medium = F.when(strong, "MEDIUM_FUZZY_STRONG").when(c("same_work").isNull(), "MEDIUM_FUZZY").when(c("same_work"), "MEDIUM_FUZZY_LLM_SAME").when(extended, "MEDIUM_FUZZY_CONF_JOURNAL").otherwise("MEDIUM_FUZZY_RELATED")
    return found.join(verdicts.select("a", "b", "same_work"), ["a", "b"], "left").withColumn("route", F.when(c("bucket") == "MEDIUM_FUZZY", medium).otherwise(c("bucket"))).drop("same_work")
