"""Romanised Russian names back in Cyrillic: a word is read from left to right, the longest spelling that its place allows first."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CONSONANTS, VOWELS = frozenset("bcdfghklmnpqrstvwxz"), frozenset("aeiou")


class Spelling(NamedTuple):
    """What letters stand for where: at the word's start or end, after one of some letters that was read by itself, before one of some letters."""

    latin: str
    cyrillic: str
    at: str = ""
    after: frozenset[str] | None = None
    before: frozenset[str] | None = None
    least: int = 0  # letters that must come before


# Sounds of several letters; endings; y and i by their neighbours; single letters; names that spelling does not give back.
SPELLINGS = [
    Spelling("shch", "щ"), Spelling("sch", "щ"), Spelling("zh", "ж"), Spelling("kh", "х"), Spelling("ts", "ц"), Spelling("ch", "ч"), Spelling("sh", "ш"), Spelling("yo", "ё"), Spelling("jo", "ё"),
    Spelling("ya", "ья", after=frozenset("dklnstz")), Spelling("ya", "я"), Spelling("ja", "я"), Spelling("yu", "ю"), Spelling("ju", "ю"), Spelling("iu", "ю", at="start"), Spelling("ye", "е", at="start"),
    Spelling("iia", "ия", at="end"), Spelling("aia", "ая", at="end"), Spelling("ia", "ия", at="end"), Spelling("ii", "ий", at="end"), Spelling("iy", "ий", at="end"), Spelling("ij", "ий", at="end"),
    Spelling("yy", "ый", at="end"), Spelling("yj", "ый", at="end"), Spelling("yi", "ый", at="end"), Spelling("ei", "ей", at="end"), Spelling("ai", "ай", at="end"),
    Spelling("yi", "ьи", after=CONSONANTS), Spelling("y", "ий", at="end", after=CONSONANTS), Spelling("i", "ий", at="end", after=CONSONANTS, least=2), Spelling("y", "й", at="end"),
    Spelling("y", "й", after=frozenset("aeo"), before=CONSONANTS | {"j"}), Spelling("i", "й", after=frozenset("ae"), before=frozenset({"ts"})),
    Spelling("y", "ь", after=CONSONANTS, before=frozenset("e")), Spelling("y", "", after=VOWELS, before=VOWELS),
]
LETTERS = {
    "a": "а", "b": "б", "c": "к", "d": "д", "e": "е", "f": "ф", "g": "г", "h": "х", "i": "и", "j": "й", "k": "к", "l": "л", "m": "м", "n": "н", "o": "о",
    "p": "п", "q": "к", "r": "р", "s": "с", "t": "т", "u": "у", "v": "в", "w": "в", "x": "кс", "y": "ы", "z": "з", "'": "ь", "’": "ь",
}
GIVEN = {
    "ilia": "Илья", "olga": "Ольга", "igor": "Игорь", "daria": "Дарья", "tatiana": "Татьяна", "petr": "Пётр", "piotr": "Пётр", "fedor": "Фёдор", "semen": "Семён", "liubov": "Любовь", "ielena": "Елена",
    "iakov": "Яков", "aleksander": "Александр", "aleksandr": "Александр", "eugene": "Евгений", "viacheslav": "Вячеслав", "liudmila": "Людмила", "eduard": "Эдуард", "artem": "Артём", "olesia": "Олеся", "nikita": "Никита", "lev": "Лев",
}
_LONGEST_FIRST = sorted(SPELLINGS, key=lambda s: (-len(s.latin), s.at == "", s.after is None, s.before is None))


def _stands(s: Spelling, word: str, at: int, last: str) -> bool:
    """Whether a spelling stands at a place of a word; last: the letters that were read just before it."""
    end = at + len(s.latin)
    if not word.startswith(s.latin, at) or at < s.least:
        return False
    if (s.at == "start" and at) or (s.at == "end" and end < len(word)):
        return False
    return (s.after is None or last in s.after) and (s.before is None or any(word.startswith(b, end) for b in s.before))


def _word(word: str) -> str:
    lower, out, at, last = word.casefold(), [], 0, ""
    while at < len(lower):
        found = next((s for s in _LONGEST_FIRST if _stands(s, lower, at, last)), None)
        last = found.latin if found else lower[at]
        out.append(found.cyrillic if found else LETTERS.get(last, last))
        at += len(last)
    text = "".join(out)
    if word.isupper():
        return text.upper()
    return text[:1].upper() + text[1:] if word[:1].isupper() else text


def _key(word: str) -> str:
    """One key for all spellings of a given name: y and j as i, x as ks, a c that is no ch as k."""
    plain = word.casefold().translate({ord("y"): "i", ord("j"): "i", ord("x"): "ks"})
    return re.sub("i+", "i", re.sub("c(?!h)", "k", plain))


@lru_cache(1 << 17)
def to_cyrillic(name: str | None) -> str | None:
    """A romanised name in Cyrillic, by its words, parts of compounds and initials; spaces become single. NULL stays NULL, Cyrillic stays as it is."""
    if name is None:
        return None
    return " ".join(re.sub(r"[^\s.\-]+", lambda m: _given(m[0]), w) for w in name.split())


def _given(part: str) -> str:
    known = GIVEN.get(_key(part))
    return _word(part) if known is None else known if part[:1].isupper() else known.lower()


@F.pandas_udf(StringType())
def cyrillic(c: pd.Series) -> pd.Series:
    """Names in Cyrillic; a worker remembers those that it has rewritten."""
    return c.map(to_cyrillic, na_action="ignore").astype(object).where(c.notna(), None)
