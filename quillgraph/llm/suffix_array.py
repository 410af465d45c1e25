"""Suffix-array deduplication of substrings.

A symbol (a byte, or a word) goes if a string of ``window`` symbols that covers it starts anywhere else as well. Every
start is assigned to an anchor: of the grams in its window, the one with the least hash. Equal
windows have equal anchors at equal places, so only starts whose anchors' hashes meet can be equal,
and a corpus-wide count of anchor hashes leaves little text to sort. Runs of starts that cover equal
text are then one representative; what is left is sorted, a shard of it in a task, as a suffix array by
linear grouping construction; neighbours whose common prefix spans a window are repeats.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import in_parts, intervals, map_texts, split_marked, table, where_marked
from quillgraph.operators.components import checkpoint
from quillgraph.operators.skew import join_counted

WINDOW = 400
#: Different strings with one common context that are sorted together; those of more are split by the bytes beside it.
MOST_STRINGS = 5_000
#: Starts that are hashed in one step.
CHUNK = 1 << 18
_MULTIPLIER = 0x9E3779B97F4A7C15
#: Words: what ASCII white space separates; in scripts without spaces each character.
_UNSPACED = "\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff"
_ONE = re.compile(f"[{_UNSPACED}]")
_WORD = re.compile(f"[{_UNSPACED}]|[^\x20\x09-\x0d{_UNSPACED}]+")


class Sizes(NamedTuple):
    """window: symbols of a string that counts. gram: of an anchor. step: starts compared together. width: bytes of a symbol."""

    window: int
    gram: int
    step: int
    width: int

    @classmethod
    def of(cls, window: int, words: bool) -> Sizes:
        return cls(window, max(1, window // 2), max(1, min(60, int(1.3 * window**0.5))), 16 if words else 1)


class _Powers:
    """Powers of an odd multiplier and of its inverse, modulo 2^64."""

    def __init__(self, multiplier: int) -> None:
        self.base = np.array([multiplier, pow(multiplier, -1, 1 << 64)], np.uint64)
        self.up = self.down = np.empty(0, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) <= n:
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, b, np.uint64)))) for b in self.base)


_POWERS = _Powers(_MULTIPLIER)


def _prefix(data: np.ndarray) -> np.ndarray:
    _POWERS.reach(len(data))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS.up[: len(data)])))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def anchors(texts: list[np.ndarray], sizes: Sizes) -> tuple[np.ndarray, ...]:
    """(text, hash, anchor, first, last): runs of starts first..last of a text (an array of symbols) that share an anchor.

    hash is of the gram at the anchor. It chooses what is compared and decides nothing.
    """
    window, gram = sizes.window, sizes.gram
    span = window - gram + 1
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    data = np.concatenate(texts) if texts else np.empty(0, np.uint8)
    found = []
    for low in range(0, max(1, len(data) - window + 1), CHUNK):
        part = data[low : low + CHUNK + window + 2 * span]
        starts = min(CHUNK, len(part) - window + 1)
        if starts <= 0:
            continue
        a = _prefix(part)
        at = np.arange(len(part) - gram + 1)
        h = _mix((a[gram:] - a[: len(at)]) * _POWERS.down[: len(at)])
        # the position in the low bits, so that of equal hashes the last is the least
        least = (h & ~np.uint64((1 << 21) - 1)) | np.uint64((1 << 21) - 1) - at.astype(np.uint64)
        width = 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        p = np.arange(starts)
        text = np.searchsorted(ends, p + low, "right")
        fits = p + low + window <= ends[np.minimum(text, len(ends) - 1)]
        p, text = p[fits], text[fits]
        if not len(p):
            continue
        s = ((1 << 21) - 1) - (least[p] & np.uint64((1 << 21) - 1)).astype(np.int64)
        new = np.concatenate(([True], (s[1:] != s[:-1]) | (text[1:] != text[:-1])))
        i = np.flatnonzero(new)
        first, last = p[i], p[np.concatenate((i[1:], [len(p)])) - 1]
        base = low - (ends - lengths)[text[i]]
        found.append((text[i], h[s[i]], s[i] + base, first + base, last + base))
    return tuple(np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 5


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of a list of integers, by linear grouping construction.

    Suffixes start in groups of equal first symbols. Groups are processed from the highest down:
    each suffix points to the nearest one on its left that is in a lower group, and those pointed to
    move to new groups right above their old ones, the further up the more pointers they got. A
    group then holds the suffixes that share a Lyndon prefix. The second pass walks the array from
    its least suffix and, through the same pointers, puts the suffixes before each found one at the
    front of their groups. Nothing is renamed or sorted again.
    """
    n = len(text)
    if not n:
        return []
    symbols = sorted(set(text))
    number = {c: k + 1 for k, c in enumerate(symbols)}
    of = [number[c] for c in text]
    of.append(0)  # an end below all symbols
    members: list[list[int]] = [[] for _ in range(len(symbols) + 1)]
    for s, g in enumerate(of):
        members[g].append(s)
    size = list(map(len, members))
    below = list(range(-1, len(symbols)))  # the next lower group
    above = [*range(1, len(symbols) + 1), -1]
    left = list(range(-1, n))  # of processed suffixes: where to look for a lower group
    done = bytearray(n + 1)
    previous = [-1] * (n + 1)

    group = len(symbols)
    while group >= 0:
        mine = members[group]
        if len(mine) != size[group]:
            mine = [s for s in mine if of[s] == group]
        members[group] = []
        for s in mine:
            done[s] = 1
        counts: dict[int, int] = {}
        for s in mine:
            p = left[s]
            while p >= 0 and done[p]:
                p = left[p]
            at = s  # shorten the way for later visits
            while (q := left[at]) != p:
                left[at], at = p, q
            if p >= 0:
                previous[s] = p
                counts[p] = counts.get(p, 0) + 1
        by_count: dict[int, list[int]] = {}
        for p, c in counts.items():
            by_count.setdefault(c, []).append(p)
        for c in sorted(by_count, reverse=True):
            together: dict[int, list[int]] = {}
            for p in by_count[c]:
                together.setdefault(of[p], []).append(p)
            for g, moved in together.items():
                if len(moved) == size[g]:
                    continue
                new = len(members)
                members.append(moved)
                size.append(len(moved))
                size[g] -= len(moved)
                for p in moved:
                    of[p] = new
                up = above[g]
                above[g], below[up] = new, new
                above.append(up)
                below.append(g)
        group = below[group]

    start, total, group = [0] * len(size), 0, 0
    while group >= 0:
        start[group] = total
        total += size[group]
        group = above[group]
    order = [-1] * (n + 1)
    order[0] = n
    placed = bytearray(n + 1)
    placed[n] = 1
    for i in range(n + 1):
        s = order[i] - 1
        while s >= 0 and not placed[s]:
            g = of[s]
            order[start[g]] = s
            start[g] += 1
            placed[s] = 1
            s = previous[s]
    return order[1:]


class _Text:
    """One text as symbols: bytes, or words."""

    def __init__(self, data: bytes, words: bool) -> None:
        self.data = data
        self.words = None
        if words:
            text = "" if data.isascii() else data.decode("utf-8", "replace")
            self.words = [w.encode() for w in _WORD.findall(text)] if _ONE.search(text) else data.split()

    def symbols(self) -> np.ndarray:
        """Numbers for hashing."""
        if self.words is None:
            return np.frombuffer(self.data, np.uint8)
        return np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))

    def bytes(self, start: int, end: int) -> bytes:
        """The symbols from start to end; words are joined by spaces, which none contains."""
        return self.data[start:end] if self.words is None else b" ".join(self.words[start:end])

    def codes(self, start: int, end: int) -> bytes:
        """The symbols from start to end in equally wide codes: a byte is its own, a word has a digest."""
        return self.data[start:end] if self.words is None else b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in self.words[start:end])

    def gone(self, runs: list[tuple[int, int]], window: int) -> tuple[np.ndarray, int]:
        """Which bytes the strings that start in these runs cover, and in how many maximal runs of symbols."""
        count = len(self.data) if self.words is None else len(self.words)
        change = np.zeros(count + 1, np.int32)
        np.add.at(change, [first for first, _ in runs], 1)
        np.add.at(change, [last + window for _, last in runs], -1)
        gone = np.cumsum(change[:-1]) > 0
        found = intervals(gone)
        if self.words is not None:
            text = self.data.decode("utf-8", "replace")
            spans = [m.span() for m in _WORD.finditer(text)]
            characters = np.zeros(len(text), bool)
            for s, e in found:
                characters[spans[s][0] : spans[e][1]] = True
            gone = np.repeat(characters, [len(c.encode()) for c in text])
        return gone, len(found)


def repeated_windows(strings: list[tuple[tuple, bytes, bytes, int]], sizes: Sizes) -> list[list[tuple[int, int]]]:
    """Of each different (core, left, right, times), the runs (from, to) of left lengths with which its windows occur again.

    A string stands for its left symbols, the core and its right symbols; a window takes as many
    on the left and right together as step - 1. All strings go through one suffix array; one that occurs several
    times repeats as a whole.
    """
    width, step = sizes.width, sizes.step
    number: dict = {}

    def coded(x: bytes) -> list[int]:
        parts = x if width == 1 else [x[i : i + width] for i in range(0, len(x), width)]
        return [number.setdefault(p, len(number)) for p in parts]

    cores = defaultdict(list)
    for k, x in enumerate(strings):
        cores[x[0]].append(k)
    text: list[int] = []
    at: dict[int, int] = {}
    for core, several in cores.items():
        if len(several) > 1:
            for k in several:
                _, left, right, _ = strings[k]
                at[k] = len(text)
                text += [*coded(left), number.setdefault((core,), len(number)), *coded(right), number.setdefault((core, k), len(number))]
    lefts, counts = [len(x[1]) // width for x in strings], [(len(x[1]) + len(x[2])) // width - step + 2 for x in strings]
    again = np.full(len(text), False)
    if text:
        symbols = np.array(text)
        starts = np.full(len(text), False)
        for k, p in at.items():
            starts[p : p + counts[k]] = True
        order = np.array(suffix_array(text))
        order = order[starts[order]]
        windows = np.lib.stride_tricks.sliding_window_view(symbols, step)
        for low in range(0, len(order), 1 << 16):  # neighbours, 65,536 at a time
            part = order[low : low + (1 << 16) + 1]
            same = (windows[part[1:]] == windows[part[:-1]]).all(axis=1)
            again[part[1:][same]] = again[part[:-1][same]] = True
    out = []
    for k, (_, _, _, times) in enumerate(strings):
        flags = np.full(counts[k], True) if times > 1 else again[at[k] : at[k] + counts[k]] if k in at else np.full(counts[k], False)
        out.append([(lefts[k] - z, lefts[k] - a) for a, z in intervals(flags)])
    return out


def _compared(cut: DataFrame, sizes: Sizes) -> DataFrame:
    """``(row, first, last)``: the starts of rows (core, at, l, r, row, n) with n = 1 whose windows occur again in any row.

    at is the core's place in the row. Strings are grouped by what all their windows share. A group of over
    MOST_STRINGS is split: one half of the windows takes in more of the left symbols, the other of the right, which tell its
    strings apart, and strings that are then equal are one. So no group grows with the number of copies, and every group is sorted.
    """
    w, most = sizes.width, sizes.step - 1

    def right(c: str, symbols: Column) -> Column:  # the last symbols
        return F.when(symbols <= 0, F.lit(b"")).otherwise(F.substring(F.col(c), F.greatest(F.octet_length(c) - symbols * w, F.lit(0)) + 1, symbols * w))

    def left(c: str, symbols: Column) -> Column:
        return F.when(symbols <= 0, F.lit(b"")).otherwise(F.substring(F.col(c), F.lit(1), symbols * w))

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        found = repeated_windows(list(zip(zip(pdf["core"], pdf["lo"], strict=True), pdf["l"], pdf["r"], pdf["m"], strict=True)), sizes)
        out = pdf[["core", "lo", "l", "r", "m"]].assign(x=[[{"u": u, "v": v} for u, v in x] for x in found])
        return out[out["x"].map(len) > 0]

    level, key, done = cut.withColumns({"lo": F.lit(0), "hi": F.lit(most)}), ["core", "lo", "l", "r"], []
    while True:
        level = checkpoint(level)
        different = checkpoint(level.groupBy(*key, "hi").agg(F.count("*").alias("m"), F.max(F.col("n") == 1).alias("asks")))
        shared = {"cl": right("l", F.col("lo")), "cr": left("r", most - F.col("hi"))}
        counted = checkpoint(different.withColumns(shared).groupBy("core", "lo", "cl", "cr").agg(F.count("*").alias("c"), F.max("m").alias("top"), F.max("asks").alias("asks")).where("asks AND (c > 1 OR top > 1)").select("core", "lo", "cl", "cr", "c", F.col("c").alias("rows")))
        total = counted.agg(F.sum("c")).first()[0] or 0
        if not total:
            break
        number = max(1, total // MOST_STRINGS)
        grouped = join_counted(different.drop("asks").withColumns(shared), counted, ["core", "lo", "cl", "cr"], "rows", total)
        few = grouped.where(F.col("c") <= MOST_STRINGS).withColumn("shard", F.pmod(F.xxhash64("core", "lo", "cl", "cr"), F.lit(number)))
        found = few.repartition(number, "shard").groupBy("shard").applyInPandas(shard, "core binary, lo int, l binary, r binary, m long, x array<struct<u:int,v:int>>")
        again = join_counted(level.where("n = 1"), checkpoint(found), key, "m")
        done.append(again.select("row", "at", F.explode("x").alias("x")).select("row", (F.col("at") - F.col("x.v")).alias("first"), (F.col("at") - F.col("x.u")).alias("last")))
        many = counted.where(F.col("c") > MOST_STRINGS)
        if many.isEmpty():
            break
        hot = join_counted(level.withColumns(shared), many, ["core", "lo", "cl", "cr"], "rows").select("core", "at", "l", "r", "row", "n", "lo", "hi")
        middle = F.expr("(lo + hi) div 2").cast("int")
        halves = F.explode(F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("hi").alias("hi")))).alias("half")
        level = hot.select("core", "at", "l", "r", "row", "n", halves).select("core", "at", "l", "r", "row", "n", "half.lo", "half.hi")
        level = level.withColumns({"l": right("l", F.col("hi")), "r": left("r", most - F.col("lo"))}).where(F.octet_length("l") + F.octet_length("r") >= most * w)
    return reduce(DataFrame.union, done) if done else cut.select("row", F.col("at").alias("first"), F.col("at").alias("last")).limit(0)


def repeated_starts(rows: DataFrame, sizes: Sizes, words: bool = False) -> DataFrame:
    """``(row, first, last)``: the starts whose windows start anywhere else as well; of rows (row, b), b binary."""

    def runs(texts: list, digests: bool) -> tuple:
        if not digests:  # no text's words outlive their hashes
            text, h, *_ = anchors([_Text(t or b"", words).symbols() for t in texts], sizes)
            return text, [h.view(np.int64)]
        read = [_Text(t or b"", words) for t in texts]
        text, h, anchor, first, last = anchors([t.symbols() for t in read], sizes)
        covered = (read[k].bytes(a, z + sizes.window) for k, a, z in zip(text.tolist(), first.tolist(), last.tolist(), strict=True))
        d = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in covered), np.int64).reshape(-1, 2)
        return text, [h.view(np.int64), d[:, 0], d[:, 1], anchor.astype(np.int32), first.astype(np.int32), last.astype(np.int32)]

    often = map_texts(rows, "b", "h bigint", lambda t: runs(t, False)).select("h").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    found = map_texts(rows, "b", "h bigint, d bigint, e bigint, s int, first int, last int", lambda t: runs(t, True))
    found = checkpoint(join_counted(found, often, ["h"], "n").drop("n"))
    groups = checkpoint(found.groupBy("h", "d", "e").agg(F.count("*").alias("n"), F.min(F.struct("row", "s", "first", "last")).alias("x")))
    whole = join_counted(found, groups.where("n > 1").select("h", "d", "e", "n"), ["h", "d", "e"], "n").select("row", "first", "last")

    # runs that share an anchor's hash, but not all symbols: one of each is compared
    mixed = groups.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    asked = join_counted(groups.select("h", "n", "x"), mixed, ["h"], "c").groupBy(F.col("x.row").alias("row")).agg(F.collect_list(F.struct("h", "n", "x.s", "x.first", "x.last")).alias("runs"))
    asked = checkpoint(asked)
    step, window = sizes.step, sizes.window

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches, "b"):
            out = []
            for row, data, asks in zip(b.column("row").to_pylist(), b.column("b").to_pylist(), b.column("runs").to_pylist(), strict=True):
                text = _Text(data, words)
                for r in asks:
                    s = r["s"]
                    for part in range((s - r["last"]) // step, (s - r["first"]) // step + 1):
                        near, far = part * step, part * step + step - 1
                        p, q = max(r["first"], s - far), min(r["last"], s - near)
                        core = hashlib.blake2b(text.bytes(s - near, s - far + window), digest_size=16, person=part.to_bytes(4) + r["h"].to_bytes(8, signed=True)).digest()
                        out.append((core, s - near, text.codes(p, s - near), text.codes(s - far + window, q + window), row, r["n"]))
            for k in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out[k : k + 10_000], strict=True), kinds, strict=True)], names)

    names = ["core", "at", "l", "r", "row", "n"]
    kinds = [pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    near = where_marked(rows, asked).join(asked, "row").select("row", "b", "runs")
    return whole.union(_compared(near.mapInArrow(strings, "core binary, at int, l binary, r binary, row bigint, n bigint"), sizes))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False, carry: tuple[str, ...] = (), window: int = WINDOW, words: bool = False) -> DataFrame:
    """``(key, n_bytes, n_removed, n_spans, kept_sha256)`` of every row, and the remaining text, ``kept``, if asked for.

    A byte of a text in UTF-8 is removed if it lies in a string of ``window`` bytes (words, if ``words``: from the first one's
    first byte to the last one's last) that starts anywhere else too, in the same or another row; strings may overlap, don't
    cross rows, and are those of the input. Words are equal if their bytes are, whatever white space parts them. Spans are
    maximal runs of removed bytes (words); ``kept`` also lacks the rest of a character that a span cuts. NULL counts as empty.
    Keys may be NULL or repeat (each row is a text of its own); columns in ``carry`` pass unchanged, others
    are not read. Empty input, empty result. docs is read several
    times and must give its rows in the same order each time, as a table does. Texts may have any length.
    Runs of starts that cover the same text are merged by 128-bit digests; different ones are compared by the suffix array
    symbol by symbol at either end, by a 128-bit digest of what all of them have in between.
    """
    sizes = Sizes.of(window, words)
    carried = [F.col(c).alias(f"carry_{k}") for k, c in enumerate(carry)]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("b"), *carried)
    spans = checkpoint(repeated_starts(rows.select("row", "b"), sizes, words).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("x")))
    # rows that surely keep all of their text do not move
    near, far = split_marked(rows, spans)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches, "b"):
            removed, runs, sha, left = [], [], [], []
            for data, x in zip(b.column("b").to_pylist(), b.column("x").to_pylist(), strict=True):
                gone, n = _Text(data, words).gone([(y["first"], y["last"]) for y in x], window) if x else (np.zeros(len(data), bool), 0)
                rest = np.frombuffer(data, np.uint8)[~gone].tobytes()
                removed.append(int(gone.sum())), runs.append(n), sha.append(hashlib.sha256(rest).hexdigest())
                left.append(rest.decode("utf-8", "ignore") if with_text else None)
            new = [pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string()), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), *new], [*own, "n_removed", "n_spans", "sha", "left"])

    own = ["key", "n_bytes", *(f"carry_{k}" for k in range(len(carry)))]
    size = F.octet_length("b").cast("bigint").alias("n_bytes")
    near = near.join(spans, "row", "left").select("key", size, "b", "x", *own[2:])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in near.select(*own).schema.fields)
    changed = near.mapInArrow(cut, f"{kinds}, n_removed bigint, n_spans bigint, sha string, left string")
    none = F.lit(0).cast("bigint")
    same = far.select("key", size, *own[2:], none.alias("n_removed"), none.alias("n_spans"), F.sha2("b", 256).alias("sha"), (F.col("b").cast("string") if with_text else F.lit(None).cast("string")).alias("left"))
    out = changed.union(same)
    return out.select(F.col("key").alias(key), "n_bytes", "n_removed", "n_spans", F.col("sha").alias("kept_sha256"), *[F.col("left").alias("kept")] * with_text, *[F.col(f"carry_{k}").alias(c) for k, c in enumerate(carry)])


def op9_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """``kept``, the remaining text, follows the contract's columns."""
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=True)
