"""Benchmark decontamination: an FM-index of each training shard, searched backwards for test phrases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from quillgraph.llm.common import intervals, table
from quillgraph.operators.checkpoints import checkpoint

#: Bytes of text in one shard; a longer text is cut into overlapping pieces, each a shard of its own.
SHARD_BYTES = 4_000_000
#: Text positions between two that a shard's index knows.
SAMPLE = 8
#: Bytes of benchmark texts that are searched, and broadcast, at once; more texts take more passes.
BLOCK_BYTES = 4_000_000
#: Words of a phrase.
WINDOW = 10
_FOUND = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"

_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words_of(data: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of texts that stand one after another in data, and how many each has. ends: where each text ends."""
    flag = _IS_WORD[data]
    first, last = flag.copy(), flag.copy()
    first[1:] &= ~flag[:-1]
    last[:-1] &= ~flag[1:]
    cuts = ends[(ends > 0) & (ends < len(data))]
    first[cuts] |= flag[cuts]
    last[cuts - 1] |= flag[cuts - 1]
    starts = np.flatnonzero(first)
    offsets = np.concatenate(([0], np.cumsum(np.flatnonzero(last) + 1 - starts)))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWERED[data[flag]])])
    return words, np.diff(np.searchsorted(starts, ends), prepend=0)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffixes of t in order; t ends with its only 0.

    The first sort takes as many symbols as 62 bits hold; each further round doubles the compared length and sorts only the
    suffixes that are still tied, so copies cost a number of rounds that grows with the logarithm of their length.
    """
    n, width = len(t), max(int(t.max(initial=0)).bit_length(), 1)
    reach = max(62 // width, 1)
    key = np.zeros(n, np.int64)
    for k in range(reach):
        key <<= width
        key[: max(n - k, 0)] |= t[k:]
    order = np.argsort(key)
    rank, slots = np.empty(n, np.int64), np.arange(n)
    key = key[order]
    while len(slots):
        new = np.concatenate(([True], key[1:] != key[:-1]))
        heads = np.flatnonzero(new)
        at = order[slots]
        rank[at] = slots[heads][np.cumsum(new) - 1]
        size = np.diff(np.append(heads, len(slots)))
        slots = slots[np.repeat(size > 1, size)]
        at = order[slots]
        key = rank[at] * (n + 1) + rank[np.minimum(at + reach, n - 1)]
        by = np.argsort(key)
        order[slots], key = at[by], key[by]
        reach *= 2
    return order


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits before ``at`` are set."""
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class FMIndex:
    """An index of integer symbols 1 and up: occurrences of a phrase, and where they stand.

    The Burrows-Wheeler transform lies in a wavelet tree stored level by level, each level one bit vector in which the symbols
    are parted by one more of their bits; a symbol's rank takes one bit rank a level. Every SAMPLE-th text position is kept.
    """

    def __init__(self, text: np.ndarray, sample: int = SAMPLE) -> None:
        t = np.append(text.astype(np.int64), 0)
        order = suffix_array(t)
        left = t[order - 1]
        self.width = max(int(t.max()).bit_length(), 1)
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=1 << self.width))))
        marked = order % sample == 0
        self.marks, self.places = Bits(marked), order[marked]
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(self.width - 1, -1, -1):
            one = (left >> shift) & 1 == 1
            self.levels.append((shift, Bits(one), len(one) - int(one.sum())))
            left = np.concatenate((left[~one], left[one]))
        symbols = np.arange(1 << self.width)
        self.shift = self.starts[:-1] - self._down(symbols, np.zeros(len(symbols), np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((symbols >> shift) & 1 == 1, zeros + ones, at - ones)
        return at

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of phrases, all of one length: the first and the last + 1 of the suffixes that begin with it (equal if none does)."""
        there = (phrases < len(self.shift)).all(1)
        low, high = np.zeros(len(phrases), np.int64), np.where(there, self.starts[-1], 0)
        left = np.flatnonzero(there)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[left, k]
            low[left], high[left] = self.shift[c] + self._down(c, low[left]), self.shift[c] + self._down(c, high[left])
            left = left[low[left] < high[left]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows start: steps to the left until a sampled position."""
        out, at, todo, steps = np.empty(len(rows), np.int64), rows.copy(), np.arange(len(rows)), 0
        while len(todo):
            known = self.marks.get(at)
            out[todo[known]] = self.places[self.marks.rank(at[known])] + steps
            todo, at = todo[~known], at[~known]
            symbol, down = np.zeros(len(at), np.int64), at
            for _, bits, zeros in self.levels:
                one, ones = bits.get(down), bits.rank(down)
                symbol, down = symbol * 2 + one, np.where(one, zeros + ones, down - ones)
            at, steps = self.shift[symbol] + down, steps + 1
        return out


class Phrases:
    """The distinct word windows of benchmark items, by length, and the items of each."""

    def __init__(self, items: list, texts: list, window: int = WINDOW) -> None:
        raw = [(t or "").encode() for t in texts]
        words, counts = words_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw], dtype=np.int64))
        coded = words.dictionary_encode()
        self.words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        # An item without an id marks words, but is no item to name.
        self.names = sorted({str(i) for i in items if i is not None})
        number = {name: k for k, name in enumerate(self.names)}
        first = np.cumsum(counts) - counts
        by_length: dict[int, list] = {}
        for item, a, n in zip(items, first.tolist(), counts.tolist(), strict=True):
            if n:
                length = min(n, window)
                rows = np.lib.stride_tricks.sliding_window_view(codes[a : a + n], length)
                by_length.setdefault(length, []).append((rows, np.full(len(rows), -1 if item is None else number[str(item)])))
        self.groups = []  # (phrases, pairs of phrase and item ordered by phrase, first pair of each phrase)
        for _, found in sorted(by_length.items()):
            phrases, which = np.unique(np.concatenate([r for r, _ in found]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.reshape(-1), np.concatenate([i for _, i in found])], 1), axis=0)
            pairs = pairs[pairs[:, 1] >= 0]
            self.groups.append((phrases, pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(phrases) + 1))))
        self.longest = max(by_length, default=1)


def search_shard(data: np.ndarray, ends: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, dict[int, list], dict[int, list]]:
    """Words of each text, and for texts with occurrences: covered runs of words, and the numbers of the items.

    One index for all the texts, with a symbol of its own after each.
    """
    words, counts = words_of(data, ends)
    coded = words.dictionary_encode()
    known = pc.index_in(phrases.words, coded.dictionary).to_numpy(zero_copy_only=False)
    known = np.where(np.isnan(known), -1, known).astype(np.int64) if known.dtype.kind == "f" else known.astype(np.int64)
    spans: dict[int, list] = {}
    items: dict[int, list] = {}
    wanted = [(known[g[0]], g) for g in phrases.groups]
    wanted = [(p[here], np.flatnonzero(here), g) for p, g in wanted if len(p) and (here := (p >= 0).all(1)).any()]
    if not wanted:
        return counts, spans, items
    first = np.cumsum(counts) - counts + np.arange(len(counts))
    text = np.ones(len(words) + len(counts), np.int64)
    text[np.arange(len(words)) + np.repeat(np.arange(len(counts)), counts)] = coded.indices.to_numpy(zero_copy_only=False) + 2
    index = FMIndex(text)
    change, met = np.zeros(len(text) + 1, np.int64), []
    for found, which, (_, of, start) in wanted:
        low, high = index.ranges(found + 2)
        n = high - low
        rows = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        at = index.locate(rows)
        np.add.at(change, at, 1)
        np.add.at(change, at + found.shape[1], -1)
        docs = np.searchsorted(first, at, "right") - 1
        pairs = np.unique(docs * (len(which) + 1) + np.repeat(np.arange(len(which)), n))
        doc, phrase = np.divmod(pairs, len(which) + 1)
        k = start[which[phrase] + 1] - start[which[phrase]]
        of = of[np.repeat(start[which[phrase]] - np.cumsum(k) + k, k) + np.arange(k.sum())]
        met.append(np.unique(np.repeat(doc, k) * (len(phrases.names) + 1) + of))
    for a, b in intervals(np.cumsum(change)[:-1] > 0):
        doc = int(np.searchsorted(first, a, "right") - 1)
        spans.setdefault(doc, []).append((a - int(first[doc]), b + 1 - int(first[doc])))
    for doc, item in zip(*(x.tolist() for x in np.divmod(np.unique(np.concatenate(met)), len(phrases.names) + 1)), strict=True):
        items.setdefault(doc, []).append(item)
    return counts, spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that meet or overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _long_text(data: np.ndarray, phrases: Phrases, size: int) -> tuple[int, list, list]:
    """A text of over ``size`` bytes: pieces that share the words a phrase may lack at the end of the piece before."""
    at, base, spans, items = 0, 0, [], set()
    while True:
        end = at + size
        while end < len(data) and _IS_WORD[data[end]]:
            end += 1
        piece = data[at:end]
        n, found, met = search_shard(piece, np.array([len(piece)]), phrases)
        spans += [(base + a, base + b) for a, b in found.get(0, [])]
        items |= set(met.get(0, []))
        if end >= len(data):
            return base + int(n[0]), merged(spans), sorted(items)
        flag = _IS_WORD[piece]
        begins = np.flatnonzero(flag & np.concatenate(([True], ~flag[:-1])))
        again = min(phrases.longest - 1, max(len(begins) - 1, 0))
        base += len(begins) - again
        at += int(begins[len(begins) - again]) if again else len(piece)


def _shards(texts: pa.Array, phrases: Phrases, size: int) -> Iterator[tuple]:
    """(words, spans, item numbers) of each text; shards are runs of texts of ``size`` bytes at most."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1, at + 1)
        part = data[offsets[at] : offsets[to]]
        if len(part) > size:
            yield _long_text(part, phrases, size)
        else:
            counts, spans, items = search_shard(part, offsets[at + 1 : to + 1] - offsets[at], phrases)
            for k, n in enumerate(counts.tolist()):
                yield n, spans.get(k, []), items.get(k, [])
        at = to


def _one_block(rows: DataFrame, text: str, block: list, window: int, size: int) -> DataFrame:
    """rows without text, with the fields of _FOUND for the items of block."""
    kept = [c for c in rows.columns if c != text]
    schema = StructType([rows.schema[c] for c in kept] + _parse_datatype_string(_FOUND).fields)
    arrow = to_arrow_schema(schema)
    phrases = rows.sparkSession.sparkContext.broadcast(Phrases([r[0] for r in block], [r[1] for r in block], window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = phrases.value
        for batch in batches:
            coded = pc.fill_null(batch.column(text), "").dictionary_encode()  # copies within a batch are indexed once
            found = list(_shards(coded.dictionary, wanted, size))
            names = [[wanted.names[i] for i in items] for _, _, items in found]
            spans = [[{"start": a, "end": b} for a, b in s] for _, s, _ in found]
            each = [pa.array(c, t).take(coded.indices) for c, t in zip(([n for n, _, _ in found], spans, names), arrow.types[-3:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c).cast(f.type) for c, f in zip(kept, arrow, strict=False)] + each, schema=arrow)
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, size: int = SHARD_BYTES, block: int = BLOCK_BYTES) -> DataFrame:
    """``(key, n_words, spans, items)`` for every row of docs: the words that occurrences of benchmark phrases cover.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII; A-Z count as a-z. A phrase is ``window``
    consecutive words of an item, or all of a shorter item; an item without words has none. ``spans`` are the covered runs of
    words ``[start, end)``, merged; ``items`` the ids, as strings, of items with a phrase in the text, in order. NULL texts
    have no words; keys may be NULL or repeat; each row has its own result; equal phrases of several items name them all. An
    item whose id is NULL covers words but is not named. A text longer than ``size`` is searched whole, in overlapping pieces.
    Empty docs: empty result; empty benchmark: no spans. Other columns are not read.

    Nothing is shuffled: each task indexes its rows in shards of ``size`` bytes and searches them for phrases that are
    broadcast, at most ``block`` bytes of items (or one longer item) at a time. If the benchmark has more, docs are indexed
    anew for each block and the rows' results are merged.
    """
    given = benchmark.select(F.col(item).cast("string").alias("i"), F.col(item_text).alias("t"))
    total = given.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-total // block) or 1
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    if blocks == 1:
        return _one_block(rows, "t", given.collect(), window, size).withColumnRenamed("k", key)
    rows = checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))
    given = checkpoint(given.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(blocks))))
    found = None
    for b in range(blocks):
        one = _one_block(rows, "t", given.where(F.col("b") == b).drop("b").collect(), window, size)
        found = one if found is None else found.union(one)
    each = found.groupBy("row").agg(F.first("k").alias("k"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = """aggregate(array_sort(spans), cast(array() as array<struct<start:bigint,end:bigint>>), (a, s) ->
        if(size(a) > 0 and s.start <= a[size(a) - 1].end,
           concat(slice(a, 1, size(a) - 1), array(named_struct('start', a[size(a) - 1].start, 'end', greatest(a[size(a) - 1].end, s.end)))),
           concat(a, array(s))))"""
    return each.select(F.col("k").alias(key), "n_words", F.expr(joined).alias("spans"), "items")


def op11_decontamination(spark, sf_dir: str) -> DataFrame:
    """One row per document: its words, those that benchmark phrases of ten words cover, and a digest of the items. See contaminated."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, n, w[i:i + n - 1] AS g
      FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(len(w), 10) AS n FROM b WHERE len(w) > 0))),
o AS (SELECT r, n, i, w[i:i + n - 1] AS g
      FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
m AS (SELECT r, i, o.n, item_id FROM o JOIN p ON o.n = p.n AND o.g = p.g),
h AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS x FROM m) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS v FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN s USING (r)
"""
