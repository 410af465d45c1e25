"""Which addresses of a reference list a text cites, by number."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# Headings, the forms of a list's number and of a citation, and the widest range of one.
HEADS = ("references", "bibliography", "литература", "список литературы", "список использованной литературы")
TAILS = ("appendix", "appendices", "supplement", "supplementary", "supporting information", "приложение", "приложения", "дополнительные материалы")
WIDEST = 50
URL = re.compile(r"https?://github\.com/[\w.-]+/[\w-]+(?:\.[\w-]+)*")
_NUMBERED = re.compile(r"(?m)^[ \t]*(?:\[(\d{1,4})\][.):]?|(\d{1,4})[.)])\s")
_CITED = re.compile(r"\[(\d[\d,; \t–—-]{0,80})\]")
_LINE = re.compile(r"(?m)^.*$")


def labels_of(inside: str) -> list[int]:
    """The numbers that a citation's brackets name; a range that runs backwards or too wide names none."""
    out: set[int] = set()
    for part in re.split("[,;]", re.sub("[–—]", "-", inside)):
        ends = [p.strip() for p in part.split("-")]
        if all(e.isdigit() and len(e) <= 4 for e in ends) and len(ends) == 2:
            low, high = map(int, ends)
            out |= set(range(low, high + 1)) if low <= high <= low + WIDEST else set()
        elif len(ends) == 1 and ends[0].isdigit():
            out.add(int(ends[0]))
    return sorted(out)


def _heading(line: str, words: tuple[str, ...], more: bool) -> bool:
    """Whether a line is a heading of these words, after a section number; ``more`` may follow."""
    plain = re.sub(r"^\s*(?:(?:[A-Z]?\d+(?:\.\d+)*|[A-Z])[.)]?[ \t]+)?", "", line).strip().rstrip(":").lower()
    return plain in words or (more and any(re.match(rf"{w}(?:\s+(?:material|materials|information|data|[a-zа-я]))?\s*(?:[:.–—-].*)?$", plain) for w in words))


def _section(text: str) -> tuple[int, int, int]:
    """Where the reference list is: start of its heading, end of the heading, end of the list."""
    start = after = end = len(text)
    for line in _LINE.finditer(text):
        if start == len(text) and _heading(line[0], HEADS, False):
            start, after = line.span()
        elif start < len(text) and line.start() >= after and _heading(line[0], TAILS, True):
            end = line.start()
            break
    return start, after, end


def cited_addresses(pages: list[str]) -> list[tuple[int, int, str, int]]:
    """(page, label, address, offset in the page) of every citation of a numbered reference that has an address; pages from 1.

    All of a text is one line of places, in which list numbers, addresses and citations are found once and matched by order. In the
    reference list an address belongs to the number before it; a bare number opens an entry only if it is cited or stands next
    to its neighbour by count. Elsewhere a numbered entry counts on its page only, and only if it was cited on that page before.
    """
    starts, text = [], ""
    for p in pages:
        starts.append(len(text))
        text += (p or "") + "\n"
    page_of = lambda at: bisect_right(starts, at) - 1
    addresses = [(m.start(), m[0]) for m in URL.finditer(text)]
    if not addresses:
        return []
    head, after, tail = _section(text)
    cites = [(m.start(), labels_of(m[1])) for m in _CITED.finditer(text)]
    cited = {x for _, labels in cites for x in labels}
    numbered = [(m.start(), int(m[1] or m[2]), bool(m[1])) for m in _NUMBERED.finditer(text)]
    listed = [n for n in numbered if after <= n[0] < tail]
    near = lambda k: any(0 <= j < len(listed) and listed[j][1] == listed[k][1] + j - k for j in (k - 1, k + 1))
    entries = [(at, n) for k, (at, n, told) in enumerate(listed) if told or n in cited or (n < 1000 and near(k))]
    known: dict[tuple[int | None, int], set[str]] = defaultdict(set)
    for at, url in addresses:
        k = bisect_right(entries, (at, 10**9)) - 1
        if after <= at < tail and k >= 0:
            known[None, entries[k][1]].add(url)
    shut = [(head, tail)]
    for k, (at, n, _) in enumerate(numbered):
        page = page_of(at)
        if any(a <= at < b for a, b in shut):
            continue
        if not any(starts[page] <= c and c < at and n in labels for c, labels in cites):
            continue
        following = numbered[k + 1][0] if k + 1 < len(numbered) else len(text)
        end = min(following, starts[page + 1] if page + 1 < len(starts) else len(text))
        own = {url for where, url in addresses if at <= where < end}
        if own:
            known[page, n] |= own
            shut.append((at, end))
    return sorted((page_of(at) + 1, n, url, at - starts[page_of(at)]) for at, labels in cites if not any(a <= at < b for a, b in shut) for n in labels for url in known.get((page_of(at), n)) or known.get((None, n), ()))


_CITATION = StructType([StructField("page", IntegerType()), StructField("label", IntegerType()), StructField("url", StringType()), StructField("at", IntegerType())])


@F.pandas_udf(ArrayType(_CITATION))
def _cited(c: pd.Series) -> pd.Series:
    return c.map(lambda pages: [dict(zip(("page", "label", "url", "at"), x, strict=True)) for x in cited_addresses(list(pages))] if pages is not None else [])


def citations(pages: Column) -> Column:
    """The citations of addresses in an array of pages, as structs (page, label, url, at); none for NULL. See cited_addresses."""
    return _cited(pages)
