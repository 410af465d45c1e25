"""Periodic runs of words: aligned blocks of powers of two, searched by Aho-Corasick, seed exact extension."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from quillgraph.llm.common import in_parts, table

#: Words of a run at least; a run also has two periods at least.
LEAST = 12
#: Bits of a symbol's digit: names are spelt in digits, as an automaton looks through a node's children one by one.
DIGIT = 6
#: Names that are Python objects at once while an automaton runs over a text.
STEP = 1 << 18
_FOUND = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def scales(n: int, least: int = LEAST) -> list[tuple[int, list[int] | range]]:
    """Block sizes, and the periods whose runs in n words surely hold an aligned block of that size and its copy one period on.

    A run of period q has max(least, 2q) words at least. All but its last q words recur q words on; a stretch of 2b - 1 words
    or more holds an aligned block of b. Each period belongs to the largest such b.
    """
    out: dict[int, list[int]] = {}
    for q in range(1, min(least, n // 2 + 1)):
        out.setdefault(1 << ((max(least, 2 * q) - q + 1) // 2).bit_length() - 1, []).append(q)
    found: dict[int, list[int] | range] = dict(out)
    b = 1
    while 2 * b - 1 <= n // 2:
        long = range(max(2 * b - 1, least), min(4 * b - 2, n // 2) + 1)
        if long:
            found[b] = [*found.get(b, []), *long] if b in found else long
        b *= 2
    return sorted(found.items())


def _stretch(ids: np.ndarray, listed: list[int], at: int, size: int, q: int) -> tuple[int, int]:
    """The first and the last + 1 of the words around the block at ``at`` that equal the word q on."""
    low, end = at, len(listed) - q
    high = at + size
    for _ in range(8):
        if low == 0 or listed[low - 1] != listed[low - 1 + q]:
            break
        low -= 1
    else:
        step = 64
        while low:
            k = max(low - step, 0)
            other = np.flatnonzero(ids[k:low] != ids[k + q : low + q])
            if len(other):
                low = k + int(other[-1]) + 1
                break
            low, step = k, step * 2
    for _ in range(8):
        if high >= end or listed[high] != listed[high + q]:
            break
        high += 1
    else:
        step = 64
        while high < end:
            k = min(high + step, end)
            other = np.flatnonzero(ids[high:k] != ids[high + q : k + q])
            if len(other):
                high += int(other[0])
                break
            high, step = k, step * 2
    return low, high


def _doubled(names: np.ndarray, size: int, later: np.ndarray, step: int) -> np.ndarray:
    """At each word, the name of the aligned block of 2 * size words that stands there too, or 0; names has the same for size.

    An aligned block's key is the pair of its halves' names, spelt in digits that tell their place. The text is read as ``size`` sequences of names, each ``size`` words
    apart, so that halves are neighbours; an automaton of the keys runs over them, ``step`` names at a time.
    """
    n, out = len(names), np.zeros(len(names), np.int64)
    here = np.arange(0, n - 2 * size + 1, 2 * size)
    here = here[later[here // size] & later[here // size + 1]]
    if not len(here):
        return out
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    digits = range(max(-(-int(names.max()).bit_length() // DIGIT), 1))
    spelt = lambda x: np.stack([(x >> DIGIT * d) % (1 << DIGIT) + (d << DIGIT) for d in digits], 1).reshape(-1).tolist()
    pairs = np.unique(np.stack([names[here], names[here + size]], 1), axis=0)
    keys = iter(spelt(pairs.reshape(-1)))
    for k, key in enumerate(zip(*[keys] * (2 * len(digits)), strict=True), 1):
        automaton.add_word(key, k)
    automaton.make_automaton()
    rows = -(-n // size)
    grid = np.zeros((rows + 1, size), np.int64)  # a name 0 ends each sequence
    grid.reshape(-1)[:n] = names
    flat = grid.T.reshape(-1)
    for a in range(0, len(flat) - 1, step):
        met = np.array(list(automaton.iter(tuple(spelt(flat[a : a + step + 1])))), np.int64).reshape(-1, 2)
        first, row = np.divmod(met[:, 0] // len(digits) + a - 1, rows + 1)
        out[row * size + first] = met[:, 1]
    return out


def word_runs(words: list, least: int = LEAST, step: int = STEP) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of words, in order of start and period.

    The period is the run's smallest; a run has two periods and ``least`` words or more, and ends where the next word, if there
    is one, breaks the period. Scale by scale, aligned blocks are searched across the text; an occurrence at a distance that is
    a period of the scale seeds an extension to both sides, word by word. A block can recur only if both its halves do, so a
    block whose half was met nowhere later is not searched again.
    """
    n, number = len(words), {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == n or n < least:
        return []
    listed, todo = ids.tolist(), dict(scales(n, least))
    found: dict[tuple[int, int], int] = {}
    ends, periods = np.zeros(n, np.int64), np.ones(n, np.int64)  # of the run that reaches farthest over each word
    names, size = ids + 1, 1
    while True:
        here = np.arange(0, n - size + 1, size)
        of = names[here]
        last = np.zeros(int(names.max()) + 1, np.int64)
        places = np.flatnonzero(names)
        last[names[places]] = places  # the last assignment to a name holds
        later = np.zeros(-(-n // size), bool)
        later[here // size] = (of > 0) & (last[of] > here)
        if not later.any():
            break  # then no larger block recurs
        if size in todo:
            near, far = todo[size][0], todo[size][-1]
            open_ = later[here // size]
            covered = np.zeros(n + 1, np.int64)
            for (s, length), p in found.items():  # in such a run, copies are multiples of its period apart
                if 2 * p <= size and length > far + size:
                    covered[s] += 1
                    covered[s + length - far - size] -= 1
            open_ &= np.cumsum(covered)[here] == 0
            of, here = of[open_], here[open_]
            by = places[np.argsort(names[places], kind="stable")]
            key = names[by] * (n + 1) + by
            low, high = (np.searchsorted(key, of * (n + 1) + np.minimum(here + d, n)) for d in (near, far + 1))
            j = np.repeat(here, high - low)
            q = by[np.repeat(low - np.cumsum(high - low) + high - low, high - low) + np.arange((high - low).sum())] - j
            if far - near + 1 > len(todo[size]):
                allowed = np.isin(q, todo[size])
                j, q = j[allowed], q[allowed]
            order, stretched = np.lexsort((j, q)), {}
            for at, period in zip(j[order].tolist(), q[order].tolist(), strict=True):
                if at < stretched.get(period, 0) or (ends[at] >= at + period and period % periods[at] == 0):
                    continue  # of a stretch that is known, or of a run of a period that divides this one
                left, right = _stretch(ids, listed, at, size, period)
                stretched[period] = right
                length = right - left + period
                if length >= max(least, 2 * period):
                    found[left, length] = min(period, found.get((left, length), period))
                    e, p = ends[left : left + length], periods[left : left + length]
                    farther = (e < left + length) | (e == left + length) & (p > period)
                    e[farther], p[farther] = left + length, period
        if size >= max(todo, default=0):
            break
        names, size = _doubled(names, size, later, step), size * 2
    return sorted((s, length, p) for (s, length), p in found.items())


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """words without those that stand in a run after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for s, length, p in runs:
        change[s + p] += 1
        change[s + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, edit: Callable[[object, list], list] | None = None) -> DataFrame:
    """``(key, n_words, runs, collapsed)`` for every row of docs: its maximal periodic runs of words, and its words without the repeats.

    Words are what ASCII white space parts. ``runs`` are ``(start, length, period)`` by start, then period: stretches of
    consecutive words whose smallest period fits twice, of ``least`` words or more, that no neighbouring word extends. In
    ``collapsed`` each run keeps its first period; what is left is joined by one space. Whole texts are searched; very long
    ones in steps of STEP names. NULL and empty texts have no words, no runs and an empty ``collapsed``; keys may be
    NULL or repeat, and each row has its own result; equal texts have equal results; empty input, empty result. Other columns
    are not read. ``edit(key, words)`` may change a text's words beforehand.
    """
    schema = StructType([docs.schema[key], *_parse_datatype_string(_FOUND).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, text):
            counts, runs, collapsed = [], [], []
            for k, t in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist(), strict=True):
                words = (t or "").encode().split()
                words = edit(k, words) if edit and words else words
                met = word_runs(words, least)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in met])
                collapsed.append(b" ".join(kept_words(words, met)).decode())
            columns = [pa.array(c, f.type) for c, f in zip((counts, runs, collapsed), list(arrow)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key).cast(arrow[0].type), *columns], schema=arrow)

    return docs.select(key, text).mapInArrow(run, schema)


def planted(doc_id: int | None, words: list) -> list:
    """The words as op13's contract edits them: a tenth of the documents become periodic from some word on. A NULL id plants nothing."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    head = words[a : a + p]
    return words[:a] + (head * -(-(n - a) // p))[: n - a]


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """One row per document: the number of its runs, the longest, and digests of all runs and of what stays. See periodic_runs."""
    found = periodic_runs(table(spark, sf_dir, "documents"), edit=planted)
    longest = F.array_sort("runs", lambda a, b: F.when(a["length"] != b["length"], F.signum(b["length"] - a["length"])).when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["period"] - b["period"])).cast("int"))
    line: Callable[[Column], Column] = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    found = found.withColumn("r", F.get(longest, F.lit(0)))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("r.start").alias("start"), F.col("r.length").alias("length"), F.col("r.period").alias("period"),
        F.expr("1000 * r.length div r.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
