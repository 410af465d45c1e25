"""SimHash near-duplicates: vantage-point trees over 64-bit fingerprints.

A fingerprint pair within four bits agrees on one of three bands nearly or wholly: the bands
tolerate one, one and no differing bits, and a pair beyond all three differs in five bits or more.
Each band has its own vantage-point tree. A node compares the Hamming distance to its vantage
point with the node's radius; the triangle inequality says that partners lie at most the band's
tolerance further in or out, so only fingerprints near the boundary visit the other side as well.
Every leaf is a shard of one Spark group, in which a local tree prunes further and the whole
64-bit distance decides. Shards return spanning edges, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import map_texts, table
from quillgraph.operators.components import checkpoint, connected_components
from quillgraph.operators.skew import join_counted

DISTANCE = 4
_FULL = (1 << 64) - 1
#: (mask, tolerance) of each band; the tolerances and one for each band sum to more than DISTANCE.
BANDS = (((1 << 22) - 1, 1), (((1 << 21) - 1) << 22, 1), (((1 << 21) - 1) << 43, 0))
SEED = 42
#: How many fingerprints grow the trees, at least and at most.
SAMPLE = (32_768, 1 << 20)


def fingerprint(text: str | None, words: int = 4) -> int:
    """The SimHash of one text, unsigned: A-Z lowered, white-space words, shingles of ``words`` words, XXH64 with seed 42.

    NULL and texts without a word give zero; fewer words make one shingle. Repeated shingles count
    as often as they occur, and a bit is set if more than half of the hashes have it.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(parts) - words + 1)
    spans = zip(starts[:last].tolist(), ends[min(words, len(parts)) - 1 :].tolist(), strict=True)
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in spans), np.uint64, last)
    counts = np.zeros(64, np.int64)
    for k in range(0, last, 255 * 256):  # 255 ones still fit a byte
        block = hashes[k : k + 255 * 256]
        bits = np.unpackbits(block.astype(">u8").view(np.uint8)).reshape(-1, 64)
        bits = np.concatenate((bits, np.zeros((-len(bits) % 255, 64), np.uint8)))
        counts += bits.reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > last).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """``(key, fp)`` for every row; fp is the fingerprint as a signed long."""

    def each(texts: list) -> tuple:
        return None, [np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)]

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return map_texts(rows, "t", "fp bigint", each).withColumnRenamed("k", key)


def _apart(x: np.ndarray, vantage: int, mask: int) -> np.ndarray:
    return np.bitwise_count((x ^ np.uint64(vantage)) & np.uint64(mask)).astype(np.int16)


def _cut(x: np.ndarray, mask: int, tries: int = 3) -> tuple[int, int] | None:
    """A vantage point among x and a radius that divides x most evenly, or None if none does."""
    best, most = None, 0
    for k in range(tries):
        d = _apart(x, v := int(x[(k * len(x)) // tries]), mask)
        for radius in {int(np.median(d)), int(np.median(d)) + 1}:
            if (less := min(n := int((d < radius).sum()), len(x) - n)) > most:
                best, most = (v, radius), less
    return best


class Tree:
    """A vantage-point tree of one band, grown on a sample. Nodes: (vantage, mask, tolerance, radius, inner, outer)."""

    def __init__(self, sample: np.ndarray, mask: int, tolerance: int, leaf: int) -> None:
        self.nodes: list[tuple | None] = []
        self._grow(np.sort(sample), mask, tolerance, leaf)

    def _grow(self, x: np.ndarray, mask: int, tolerance: int, leaf: int) -> int:
        self.nodes.append(None)
        at = len(self.nodes) - 1
        if len(x) > leaf:
            cut = _cut(x, mask)
            if not cut and mask != _FULL:  # one band value: the whole fingerprint tells them apart
                mask, tolerance = _FULL, DISTANCE
                cut = _cut(x, mask)
            if cut:
                inside = _apart(x, cut[0], mask) < cut[1]
                inner = self._grow(x[inside], mask, tolerance, leaf)
                outer = self._grow(x[~inside], mask, tolerance, leaf)
                self.nodes[at] = (cut[0], mask, tolerance, cut[1], inner, outer)
        return at

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home): each row's own leaf, and as a visitor every leaf that may hold partners."""
        found, open_ = [], [(0, np.arange(len(x)), np.ones(len(x), bool))]
        while open_:
            at, rows, home = open_.pop()
            if not len(rows):
                continue
            if (node := self.nodes[at]) is None:
                found.append((rows, np.full(len(rows), at), home))
                continue
            vantage, mask, tolerance, radius, inner, outer = node
            d = _apart(x[rows], vantage, mask)
            inside = d < radius
            near_in, near_out = d < radius + tolerance, d + tolerance >= radius
            go_in, go_out = near_in, np.where(home, ~inside, near_out)  # one side visits: a pair meets once
            open_ += [(inner, rows[go_in], (home & inside)[go_in]), (outer, rows[go_out], home[go_out])]
        return tuple(np.concatenate(z) if found else np.empty(0, int) for z in zip(*found, strict=True)) if found else (np.empty(0, int),) * 3


def _union(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the classes of i and j in place; a label is the smallest index of its class."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not (label[label] == label).all():
            label[:] = label[label]


def _search(x: np.ndarray, h: np.ndarray, v: np.ndarray, mask: int, tolerance: int, label: np.ndarray, work: int) -> None:
    """Link every home h with the homes and visitors v within DISTANCE."""
    if not len(h):
        return
    if len(h) * (len(h) + len(v)) > work:
        metrics = [(mask, tolerance), (_FULL, DISTANCE)]
        for m, t in metrics:
            if not (cut := _cut(x[h], m)):
                continue
            dh, dv = _apart(x[h], cut[0], m), _apart(x[v], cut[0], m)
            inside = dh < cut[1]
            halves = (h[inside], np.concatenate((h[~inside & (dh < cut[1] + t)], v[dv < cut[1] + t]))), (h[~inside], v[dv + t >= cut[1]])
            if sum(len(a) * (len(a) + len(b)) for a, b in halves) < 0.95 * len(h) * (len(h) + len(v)):
                for a, b in halves:
                    _search(x, a, b, m, t, label, work)
                return
    others = np.concatenate((h, v))
    step = max(1, (1 << 20) // len(others))
    for k in range(0, len(h), step):
        near = np.bitwise_count(x[h[k : k + step], None] ^ x[None, others]) <= DISTANCE
        i, j = np.nonzero(near)
        _union(label, h[k : k + step][i], others[j])


def _shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["rep"], kind="stable")  # the smallest index is the smallest representative
    x, rep = pdf["fp"].to_numpy().view(np.uint64), pdf["rep"].to_numpy()
    label, home = np.arange(len(x)), pdf["home"].to_numpy()
    mask, tolerance = BANDS[int(pdf["band"].iat[0])]
    _search(x, np.flatnonzero(home), np.flatnonzero(~home), mask, tolerance, label, 1 << 18)
    moved = label != np.arange(len(x))
    return pd.DataFrame({"a": rep[moved], "b": rep[label[moved]]})


def near_links(unique: DataFrame, leaf: int = 2048) -> DataFrame:
    """Edges ``(a, b)`` that span the links of at most DISTANCE bits among unique ``(fp, rep)`` rows.

    leaf: fingerprints of a shard to aim at. The driver sees a sample of them, picked by their hash,
    to grow the trees: 16 for each shard, within SAMPLE. They place boundaries only and decide no link.
    """
    n = unique.count()
    share = min(1.0, min(max(16 * n // leaf, SAMPLE[0]), SAMPLE[1]) / max(n, 1))
    picked = unique.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("fp").toPandas()
    seen = picked["fp"].to_numpy(np.int64).view(np.uint64)
    trees = unique.sparkSession.sparkContext.broadcast([Tree(seen, mask, t, max(8, int(leaf * share))) for mask, t in BANDS])

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b["fp"].to_numpy().view(np.uint64)
            for band, tree in enumerate(trees.value):
                rows, at, home = tree.route(x)
                yield pd.DataFrame({"band": np.full(len(rows), band, np.int32), "leaf": at.astype(np.int32), "fp": b["fp"].to_numpy()[rows], "rep": b["rep"].to_numpy()[rows], "home": home.astype(bool)})

    kind = unique.schema["rep"].dataType.simpleString()
    shards = unique.select("fp", "rep").mapInPandas(route, f"band int, leaf int, fp bigint, rep {kind}, home boolean")
    return shards.groupBy("band", "leaf").applyInPandas(_shard, f"a {kind}, b {kind}")


def near_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """``(a, b)``: edges between keys that span the links of at most DISTANCE bits; texts of one fingerprint are linked to the smallest key of them. NULL keys have none."""
    fps = checkpoint(fingerprints(docs.where(F.col(key).isNotNull()), key, text, words))
    unique = checkpoint(fps.groupBy("fp").agg(F.min(key).alias("rep"), F.count("*").alias("n")))
    same = join_counted(fps, unique.where("n > 1"), ["fp"], "n").where(F.col("rep") < F.col(key)).select(F.col("rep").alias("a"), F.col(key).alias("b"))
    return near_links(unique.select("fp", "rep")).union(same)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """``(key, fingerprint, component_id)`` for every row of docs.

    fingerprint: 16 hex digits. component_id: the smallest key that links of at most four bits reach.
    NULL and empty texts have fingerprint zero and link like any other; rows with a NULL key form
    no link and take the component of their fingerprint (NULL if no other row has it). Repeated
    rows give repeated results. Other columns of docs are not read. Empty input, empty result.
    """
    fps = checkpoint(fingerprints(docs, key, text, words))
    unique = checkpoint(fps.groupBy("fp").agg(F.min(key).alias("rep"), F.count("*").alias("n")))
    links = near_links(unique.where("rep IS NOT NULL"))
    found = connected_components(links, "a", "b")
    classes = unique.join(found, unique["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"), "n")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return join_counted(fps, classes, ["fp"], "n").select(key, digits.alias("fingerprint"), "component_id")


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
