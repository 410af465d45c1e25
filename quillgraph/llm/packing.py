"""Best-fit packing by minimum bin slack.

What a bin can hold depends only on how many pieces there are of each length. So the driver sees
the histogram of lengths (a row for each length up to the capacity), finds the fullest feasible
combination for the largest length left, takes it as often as the histogram allows, and goes on.
Each combination uses up a length, so there are no more combinations than lengths. Spark then
ranks the pieces of each length and looks each rank up in that plan.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.bpe import added_tokens, encode_with_added, encoding
from quillgraph.llm.common import map_texts, table
from quillgraph.operators.components import checkpoint

CAPACITY = 1024
END = 2
#: Pieces of one length are ranked in parts of about RANKED, and all lengths in MOST_PARTS parts besides one each.
RANKED, MOST_PARTS = 1_000, 100_000


def fullest(room: int, counts: dict[int, int]) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to room; larger lengths first.

    A bit of ``reach`` is a sum that the lengths so far can make; shifting by a length adds it.
    """
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        steps.append((length, reach))
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            reach |= (reach << (length * take)) & full
            left, take = left - take, take * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        n = 0
        while not before >> total & 1:
            total, n = total - length, n + 1
        if n:
            chosen[length] = n
    return chosen


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """``(bins, {length: how many in each bin})``: combinations that use up all counts."""
    counts, plan = {k: v for k, v in counts.items() if v}, []
    while counts:
        largest = max(counts)
        counts[largest] -= 1
        bin_ = fullest(capacity - largest, counts)
        counts[largest] += 1
        bin_[largest] = bin_.get(largest, 0) + 1
        times = min(counts[k] // n for k, n in bin_.items())
        plan.append((times, bin_))
        counts = {k: left for k, v in counts.items() if (left := v - times * bin_.get(k, 0))}
    return plan


def pack(pieces: DataFrame, order: list[str], length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """pieces with ``sequence_id`` and ``offset``, gapless from 0 in each sequence.

    Lengths run from 1 to capacity. order: columns that rank pieces of one length; equal rows get
    ranks in any order. A length that many pieces share is ranked in parts, so that no part has more than
    RANKED pieces or one in MOST_PARTS of all. An empty input gives an empty result. pieces is read several times: cut its lineage first.
    """
    sizes = pieces.groupBy(length).agg(F.count("*").alias("_n"))
    counts = {r[0]: r[1] for r in sizes.collect()}
    if any(not 1 <= k <= capacity for k in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    each = max(RANKED, sum(counts.values()) // MOST_PARTS + 1)
    salts = sizes.select(length, F.ceil(F.col("_n") / each).alias("_salts"))  # capacity rows at most
    salted = pieces.join(F.broadcast(salts), length).withColumn("_salt", F.pmod(F.xxhash64(*order), F.col("_salts")).cast("int")).drop("_salts")
    parts = salted.groupBy(length, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(length).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(length, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    rank = F.row_number().over(Window.partitionBy(length, "_salt").orderBy(*order)) - 1
    # at most capacity + MOST_PARTS rows
    ranked = salted.withColumn("_rank", rank).join(F.broadcast(parts), [length, "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_from"))

    taken, rows, first = dict.fromkeys(counts, 0), [], 0
    for times, bin_ in minimum_bin_slack(counts, capacity):
        at = 0
        for k, n in sorted(bin_.items(), reverse=True):
            rows.append((k, taken[k], first, n, at))
            taken[k], at = taken[k] + times * n, at + k * n
        first += times
    plan = np.array(sorted(rows), np.int64).reshape(-1, 5)
    starts = {k: int(np.searchsorted(plan[:, 0], k)) for k in counts}

    names = pieces.columns

    def place(batches):
        for b in batches:
            kinds, ranks = (b.column(c).to_numpy(zero_copy_only=False) for c in (length, "_rank"))
            row = np.empty(len(kinds), np.int64)
            for k in np.unique(kinds):
                here, s = kinds == k, starts[int(k)]
                e = int(np.searchsorted(plan[:, 0], k, "right"))
                row[here] = s + np.searchsorted(plan[s:e, 1], ranks[here], "right") - 1
            _, begin, bins, n, at = plan[row].T
            local = ranks - begin
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(bins + local // n), pa.array(at + local % n * kinds)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def token_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """``(key, piece, start, length, ids_crc32)`` of each piece, and its ``ids`` if asked for.

    A document's ids are its text's, then ``end``. Only those of more than capacity ids are cut, so that
    all pieces but the first have capacity ids. NULL counts as the empty text, which has the end id
    alone. path: the vocabulary as JSON, whose added tokens' strings have their own ids, or as a rank file.
    """

    def each(texts: list) -> tuple:
        enc, added = encoding(path), added_tokens(path)
        rows, piece, start, length, crc, cut = [], [], [], [], [], []
        for k, t in enumerate(texts):
            ids = np.append(encode_with_added(t, enc, added), end).astype("<u4")
            edges = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
            for n, (s, e) in enumerate(zip(edges, edges[1:], strict=False)):
                rows.append(k), piece.append(n), start.append(s), length.append(e - s)
                crc.append(zlib.crc32(ids[s:e].tobytes()))
                if with_ids:
                    cut.append(ids[s:e].astype(np.int64))
        return rows, [piece, start, length, crc] + [cut] * with_ids

    fields = "piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return map_texts(rows, "t", fields, each).withColumnRenamed("k", key)


def packed(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of all docs with their place in sequences of at most CAPACITY tokens.

    Keys may be NULL or repeat (such rows are packed each for itself); other columns of docs are not read.
    """
    cut = checkpoint(token_pieces(docs, path, key, text, with_ids=with_ids))
    return pack(cut, [key, "piece", "start", "ids_crc32"])


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
