"""What publishers and web pages wrap around a text: markup of formulas, hidden addresses."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quillgraph.functions.text import EMAIL

# Elements that carry a formula's text, signs that take no space before or after them, words that stand for signs.
LEAVES = {"mml:mi", "mml:mn", "mml:mo", "mml:mtext"}
TIGHT_BEFORE, TIGHT_AFTER = "/,;:.)]@-", "(["
SPELLED = {"at": "@", "dot": "."}
BRACKETS = {"[": "])}>", "(": "])}>", "{": "])}>", "<": "])}>"}

#: Kinds of a text's parts.
TEXT, SPACE, TAG = range(3)


def _parts(text: str) -> Iterator[tuple[int, str]]:
    """The text in order as words, white space and tags; a tag as its name, with a slash before it if it closes.

    Tags stand in angle brackets, or between ``-=`` and ``=-`` (a name only). A bracket that nothing closes is text.
    """
    at = 0
    while at < len(text):
        if text[at] == "<" and (end := text.find(">", at + 2)) > 0:
            yield TAG, text[at + 1 : end].strip().partition(" ")[0].lower()
            at = end + 1
        elif text.startswith("-=", at) and (end := text.find("=-", at + 2)) > 0 and (name := text[at + 2 : end]).removeprefix("/").isalnum():
            yield TAG, name.lower()
            at = end + 2
        else:
            space, start = text[at].isspace(), at
            at += 1
            while at < len(text) and text[at].isspace() == space and text[at] not in "<-":
                at += 1
            yield (SPACE if space else TEXT), text[start:at]


def _formula(parts: list[tuple[int, str]]) -> str:
    """A formula's text: what its leaf elements hold, as it stands, or, without any, all of it without white space."""
    leaves, open_, leaf = [], None, False
    for kind, value in parts:
        if kind == TAG:
            leaf |= value in LEAVES
            open_ = value if value in LEAVES else None if open_ and value == f"/{open_}" else open_
        elif open_:
            leaves.append(value)
    return "".join(leaves) if leaf else "".join(v for kind, v in parts if kind == TEXT)


def _chained(parts: list[tuple[int, str]], at: int) -> bool:
    """Whether the white space at ``at`` stands between a script and a symbol of one or two letters that has a script too."""
    if at == 0 or parts[at - 1] not in ((TAG, "/sub"), (TAG, "/sup")):
        return False
    rest = [p for p in parts[at + 1 : at + 4] if p[0] != SPACE][:2]
    return len(rest) == 2 and rest[0][0] == TEXT and len(rest[0][1]) <= 2 and rest[0][1].isascii() and rest[0][1].isalpha() and rest[1] in ((TAG, "sub"), (TAG, "sup"))


def plain_title(text: str) -> str:
    """A title without tags. Scripts join what they belong to, formulas are their own text, brackets and signs stand tight."""
    parts, flat, at = list(_parts(html.unescape(text))), [], 0
    while at < len(parts):
        if parts[at] == (TAG, "mml:math") and (TAG, "/mml:math") in parts[at:]:
            end = parts.index((TAG, "/mml:math"), at)
            flat.append((TEXT, _formula(parts[at + 1 : end])))
            at = end
        else:
            flat.append(parts[at])
        at += 1
    out, gap = "", False
    for k, (kind, value) in enumerate(flat):
        if kind == SPACE:
            gap |= not _chained(flat, k)
        elif kind == TAG:
            gap &= value not in ("sub", "sup")
        elif value:
            loose = gap and out and out[-1] not in TIGHT_AFTER and value[0] not in TIGHT_BEFORE
            out += (" " if loose else "") + value
            gap = False
    return " ".join(out.split())


@F.pandas_udf(StringType())
def _plain(c: pd.Series) -> pd.Series:
    return c.map(plain_title, na_action="ignore")


def without_markup(c: Column) -> Column:
    """A title without markup (see plain_title). NULL stays NULL; only texts with a sign of markup go to Python."""
    tight = F.regexp_replace(F.regexp_replace(c, r"([(\[])\s+", "$1"), r"\s+(?=[/,;:.)\]@-])", "")
    return F.when(c.rlike("<|&|-="), _plain(c)).otherwise(F.trim(F.regexp_replace(tight, r"(?U)\s+", " ")))


def revealed(page: str) -> str:
    """A page in which words in brackets that stand for signs of an address are those signs, without space around them."""
    page, out, at = html.unescape(page), [], 0
    while at < len(page):
        c, sign, end = page[at], "", at + 1
        if c in BRACKETS:
            stop = next((k for k in range(at + 1, min(at + 16, len(page))) if page[k] in BRACKETS[c]), 0)
            sign = SPELLED.get(page[at + 1 : stop].strip().lower(), "") if stop else ""
            end = stop + 1 if sign else end
        elif c == "@":
            sign = c
        if sign:
            while out and out[-1].isspace():
                out.pop()
            while end < len(page) and page[end].isspace():
                end += 1
        out.append(sign or c)
        at = end
    return "".join(out)


@F.pandas_udf(ArrayType(StringType()))
def _addresses(c: pd.Series) -> pd.Series:
    address = re.compile(EMAIL)
    return c.map(lambda page: sorted({a.lower().rstrip(".") for text in ((page, revealed(page)) if page else ()) for a in address.findall(text)}))


def emails_in_html(c: Column) -> Column:
    """Distinct addresses of a page in lower case, sorted: linked, plain, or spelled out to hide them. None for NULL."""
    return F.coalesce(_addresses(F.coalesce(c, F.lit(""))), F.array().cast("array<string>"))
