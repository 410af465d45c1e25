"""Text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed words that say nothing of a title.
TITLE_STOPS = ["a", "an", "and", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with"]
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def collapse(c: Column) -> Column:
    """Trimmed, lower case, white space as one space."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def title_tokens(c: Column) -> Column:
    """Distinct words of more than two letters, but for those that say nothing, in order."""
    words = F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(TITLE_STOPS)))


def shingles(c: Column, n: int = 3) -> Column:
    """Distinct runs of n words of the lowered text; of fewer words, all of them as one."""
    words = F.filter(F.split(collapse(c), " "), lambda w: w != "")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), lambda k: F.array_join(F.slice(words, k + 1, n), " "))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def bits_jaccard(a: list[Column], b: list[Column]) -> Column:
    """``jaccard`` of sets that are bits of longs, so that a pair costs a few instructions."""
    both, either = F.lit(0), F.lit(0)
    for x, y in zip(a, b, strict=True):
        both, either = both + F.bit_count(x.bitwiseAND(y)), either + F.bit_count(x.bitwiseOR(y))
    return F.when(either == 0, F.lit(0.0)).otherwise(both / either)


def deletion_keys(c: Column, least: int = 5) -> Column:
    """A word with doubled letters as one, and each way to leave out one letter; of short words the word alone."""
    w = F.regexp_replace(F.lower(c), r"(.)\1", "$1")
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda k: F.concat(F.substring(w, F.lit(1), k - 1), F.substring(w, k + 1, F.length(w))))
    return F.when(F.length(w) < least, F.array(w)).otherwise(F.array_distinct(F.concat(F.array(w), cut)))


def emails(c: Column) -> Column:
    """Distinct addresses in order, lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(f"({EMAIL})"), F.lit(1)), F.lower))


def best_email(found: Column, institution: str) -> Column:
    """The first address of the institution by alphabet, else the shortest (ties by alphabet)."""
    own = F.array_sort(F.filter(found, lambda e: e.endswith(institution)))
    short = F.transform(F.array_sort(F.transform(found, lambda e: F.struct(F.length(e).alias("n"), e.alias("e")))), lambda s: s["e"])
    return F.when(F.size(own) > 0, F.get(own, F.lit(0))).otherwise(F.get(short, F.lit(0)))


def links(c: Column) -> Column:
    """Addresses in a text, without what punctuation follows them."""
    found = F.regexp_extract_all(c, F.lit(r"(https?://[^\s<>\"']+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)\]}]+$", "")))


def abstract(inverted: Column) -> Column:
    """A text from its map of words to positions."""
    placed = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ")


def citation_numbers(label: Column, widest: int = 50) -> Column:
    """The numbers of a label such as ``1, 3-5``; a range wider than the limit counts for nothing."""
    def numbers(part: Column) -> Column:
        ends = F.transform(F.split(F.trim(part), "-"), lambda x: F.trim(x).try_cast("int"))
        a, b = F.get(ends, F.lit(0)), F.coalesce(F.get(ends, F.lit(1)), F.get(ends, F.lit(0)))
        return F.when((a <= b) & (b - a <= widest), F.sequence(a, b)).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(F.flatten(F.transform(F.split(label, ","), numbers)))


def truncated(c: Column, most: int = 200) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def without_addresses(c: Column) -> Column:
    """A text that may be shown: e-mail addresses and links go."""
    return F.regexp_replace(F.regexp_replace(c, EMAIL, "[email]"), r"https?://\S+", "[link]")


def grant_id(c: Column) -> Column:
    """A grant number in one spelling: upper case, one kind of dash, no prefix such as ``No.``."""
    c = F.regexp_replace(F.upper(F.trim(c)), "[‐-―−]", "-")
    c = F.regexp_replace(c, r"^(?:(?:GRANT|PROJECT|AGREEMENT|NO|NR|N|#|№)[.:\s]*)+(?=[\d#№])", "")
    return F.regexp_replace(c, r"\s+", "")


def mixed_script(c: Column) -> Column:
    """Whether a word has Cyrillic and Latin letters."""
    return F.exists(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w.rlike(r"\p{IsCyrillic}") & w.rlike(r"\p{IsLatin}"))


def initials_only(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?U)^(?:\w\.\s*){1,3}\S"), F.lit(False))


def logistic(features: list[Column], means: list[float], scales: list[float], weights: list[float], bias: float) -> Column:
    """Probability of standardised features under a logistic model, without overflow."""
    z = F.lit(bias)
    for x, m, s, w in zip(features, means, scales, weights, strict=True):
        z = z + (x - m) / s * w
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def zone(p: Column, low: float, high: float) -> Column:
    return F.when(p >= high, "merge").when(p <= low, "separate").otherwise("review")
