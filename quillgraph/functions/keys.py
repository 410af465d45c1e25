"""Keys and identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doi(c: Column) -> Column:
    """A DOI without resolver or scheme, lower case, no slash at its end."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", ""), r"/+$", "")


def last_segment(c: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(F.trim(c), r"/+$", ""), "/"), -1)


def openalex(c: Column) -> Column:
    return F.upper(last_segment(c))


def orcid(c: Column) -> Column:
    """The ORCID of a bare id or of a reference to its host, else NULL."""
    found = F.regexp_extract(F.trim(c), r"^(?:https?://orcid\.org/)?(\d{4}-\d{4}-\d{4}-\d{3}[\dXx])/?$", 1)
    return F.when(found != "", F.upper(found))


def ror(c: Column) -> Column:
    found = F.regexp_extract(F.lower(F.trim(c)), r"^(?:https?://ror\.org/)?(0[a-z0-9]{8})/?$", 1)
    return F.when(found != "", found)


def repository_url(c: Column) -> Column:
    """One spelling of a repository's address: https, no www, no ``.git``, no slash at its end, lower case."""
    c = F.regexp_replace(F.lower(F.trim(c)), r"/+$", "")
    c = F.regexp_replace(c, r"\.git$", "")
    return F.regexp_replace(c, r"^(?:https?://)?(?:www\.)?", "https://")


def repository_id(c: Column) -> Column:
    """``github_owner_name`` of an address with exactly those two segments, else NULL."""
    parts = F.regexp_extract(repository_url(c), r"^https://github\.com/([^/?#]+)/([^/?#]+)$", 0)
    return F.when(parts != "", F.concat(F.lit("github_"), F.split(parts, "/")[3], F.lit("_"), F.split(parts, "/")[4]))


def fallback_person(orcid_: Column, name: Column) -> Column:
    """An id from the ORCID, else from the name's hash."""
    return F.coalesce(F.concat(F.lit("orcid_"), orcid_), F.concat(F.lit("name_"), F.substring(F.sha1(F.lower(name)), 1, 12)))


def arxiv(c: Column) -> Column:
    """The number in an address, a DOI or an ``arXiv:`` reference, without its version."""
    found = F.regexp_extract(F.lower(c), r"arxiv(?:\.org/(?:abs|pdf)/|[.:]\s*)(\d{4}\.\d{4,5})", 1)
    return F.when(found != "", found)


def pair_id(*members: Column) -> Column:
    """One id for a question about some members, whatever their order."""
    return F.concat_ws(":", F.array_sort(F.array(*[m.cast("string") for m in members])))
