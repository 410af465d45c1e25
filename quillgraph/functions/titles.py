"""What a title and a venue say about a record: notices, covers, series, preprints, kinds of venue."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NOTICE = r"(?i)^(erratum|corrigendum|correction|retraction|addendum|expression of concern)(\s+to\s*:?|\s*:|\s*[—–])\s*"
COVER = r"(?i)^((front|back|inside) cover|cover (feature|picture|image)|frontispiece)\s*[:—–-]\s*"
SERIES = r"(?i)[.,:;—–-]?\s*\b(part\s+([ivx]+|\d+)|vol(ume)?\.?\s*\d+|no\.?\s*\d+)\s*$"
PREPRINT_DOI = r"(?i)^10\.(48550|1101|2139|31219|26434)/"
PREPRINT_VENUE = r"(?i)arxiv|rxiv|ssrn|preprint|zenodo|figshare"
CONFERENCE = r"(?i)conference|proceedings|symposium|workshop|lecture notes"


def notice_subject(title: Column) -> Column:
    """The title that a notice is about, else NULL."""
    return F.when(title.rlike(NOTICE), F.trim(F.regexp_replace(title, NOTICE, "")))


def cover_subject(title: Column) -> Column:
    return F.when(title.rlike(COVER), F.trim(F.regexp_replace(title, COVER, "")))


def series_marker(title: Column) -> Column:
    """The marker of a part or volume at a title's end, lower case, else NULL."""
    found = F.lower(F.trim(F.regexp_extract(title, SERIES, 1)))
    return F.when(found != "", found)


def without_series(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, SERIES, ""))


def is_preprint(doi: Column, venue: Column, kind: Column) -> Column:
    """By the DOI's registrant, the venue's name or the record's type; NULLs say nothing."""
    no = F.lit(False)
    return F.coalesce(doi.rlike(PREPRINT_DOI), no) | F.coalesce(venue.rlike(PREPRINT_VENUE), no) | F.coalesce(F.lower(kind) == "preprint", no)


def venue_kind(venue: Column) -> Column:
    return F.when(venue.isNull() | (F.trim(venue) == ""), "unknown").when(venue.rlike(PREPRINT_VENUE), "repository").when(venue.rlike(CONFERENCE), "conference").otherwise("journal")


def day_gap(date_a: Column, date_b: Column, year_a: Column, year_b: Column) -> Column:
    """Days between two dates; by years, 365 days each, where a date is unknown; NULL where a year is."""
    return F.coalesce(F.abs(F.datediff(date_a, date_b)), F.abs(year_a - year_b) * 365)


def has_cyrillic(c: Column) -> Column:
    return F.coalesce(c.rlike("[Ѐ-ӿ]"), F.lit(False))
