"""Names of units inside affiliation texts: many names against many texts, by one automaton."""

from __future__ import annotations

import re

import ahocorasick

#: Characters that words are written with or without.
APOSTROPHES = "'’‘´ʼʹ`"
QUOTES_AND_DASHES = '«»“”„‟‚‛"‐‑‒–—―-'
#: Words that open a part of an address below a unit, and words of a title or of the city.
SUB_UNIT = ("laboratory", "lab", "department", "group", "center", "centre", "chair", "кафедра", "лаборатория", "центр")
SAYS_NOTHING = {"professor", "prof", "dr", "phd", "associate", "head", "st", "saint", "petersburg", "russia", "санкт", "петербург", "россия"}
OTHER_ORGANISATION = ("university", "academy", "institute of", "college", "университет", "академия", "институт")


def plain(text: str | None) -> str:
    """Folded case, no apostrophes within words, single spaces for white space, quotes and dashes."""
    folded = (text or "").casefold()
    out = []
    for k, c in enumerate(folded):
        within = 0 < k < len(folded) - 1 and folded[k - 1].isalpha() and folded[k + 1].isalpha()
        out.append(("" if within and c in APOSTROPHES else " ") if c in APOSTROPHES or c in QUOTES_AND_DASHES else c)
    return " ".join("".join(out).split())


def _ends_open(name: str) -> bool:
    """Whether the word that ends a name may go on in a text: not if the name is one word, or its last word has two letters or fewer."""
    words = name.split(" ")
    return len(words) > 1 and len(words[-1]) > 2


class NameFinder:
    """Which names occur in a text. Names are built into an automaton once; a text is read once, whatever their number."""

    def __init__(self, names: list[str]) -> None:
        self.names = sorted({n for n in map(plain, names) if n})
        self.automaton = ahocorasick.Automaton()
        for k, name in enumerate(self.names):
            self.automaton.add_word(name, k)
        if self.names:
            self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, int, bool]]:
        """(start, end, number of the name, whether it stands there as a word) of every occurrence, in order of start."""
        if not self.names:
            return []
        out = []
        for last, k in self.automaton.iter(text):
            start, end = last + 1 - len(self.names[k]), last + 1
            opens = start == 0 or not text[start - 1].isalpha()
            closes = _ends_open(self.names[k]) or end == len(text) or not text[end].isalpha()
            out.append((start, end, k, opens and closes))
        return out

    def find(self, text: str | None) -> list[str]:
        """Names that stand in the text as words, outside every occurrence of a longer name that stands there too; in order."""
        return sorted({self.names[k] for k in outermost(self.spans(plain(text)))})


def outermost(spans: list[tuple[int, int, object, bool]], standing: set | None = None) -> set:
    """Which names have an occurrence as a word that lies in no occurrence of a longer name that stands somewhere as a word.

    standing: the names that do, if other texts count too.
    """
    standing = {k for *_, k, good in spans if good} if standing is None else standing
    found, farthest = set(), -1
    for _, end, k, good in sorted(spans, key=lambda s: (s[0], -s[1])):
        if k in standing:
            if good and farthest < end:  # spans before this one start here at the latest
                found.add(k)
            farthest = max(farthest, end)
    return found


def parts_near(text: str | None, marker: re.Pattern, units: NameFinder) -> list[str]:
    """The comma-separated parts of an affiliation that may borrow the organisation's mark, in plain form.

    Parts that hold titles and the city only do not count. A part next to a marked one (or marked itself) may; one more part may
    lie between if it is a sub-unit or opens with a unit's name, and names no other organisation. Across a semicolon the rest of
    the segment must consist of such parts. A part that another organisation owns, which is named before the next mark of its
    segment, never may.
    """
    parts, segment = [], []
    for s, one in enumerate(re.split(r"[;|]", text or "")):
        for p in map(str.strip, one.split(",")):
            words = plain(p).split()
            if any(w.isalpha() and w not in SAYS_NOTHING for w in words):
                parts.append(p)
                segment.append(s)
    flat = [plain(p) for p in parts]
    marked = [bool(marker.search(p)) for p in parts]
    other = [not m and any(re.search(rf"\b{w}\b", p) for w in OTHER_ORGANISATION) for m, p in zip(marked, flat, strict=True)]
    bridge = [p.startswith(SUB_UNIT) or any(a == 0 or p[:a].strip(" 0123456789") in ("", "the") for a, _, _, good in units.spans(p) if good) for p in flat]

    def owned(i: int) -> bool:
        ahead = [k for k in range(i, len(parts)) if segment[k] == segment[i] and (marked[k] or other[k])]
        return bool(ahead) and not marked[ahead[0]]

    def lends(i: int, j: int) -> bool:
        middle = (i + j) // 2
        if abs(i - j) == 2 and (not bridge[middle] or other[middle]):
            return False
        return segment[i] == segment[j] or all(bridge[k] for k in range(len(parts)) if segment[k] == segment[i] and k != i)

    near = lambda i: any(marked[j] and lends(i, j) for j in range(max(i - 2, 0), min(i + 3, len(parts))))
    return [flat[i] for i in range(len(parts)) if not owned(i) and near(i)]
