"""Substring deduplication by line and sentence hashing.

Units are lines, and the sentences within them; each is normalised and digested. Digests are grouped
over the whole corpus, the unit that ranks first by (key, offset) stays and the others go, by
their offsets in the original text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import intervals, map_texts, table, where_marked
from quillgraph.operators.components import checkpoint
from quillgraph.operators.skew import join_counted

#: A sentence within a line has so many characters or more once normalised, words or not; a line may have any number.
MIN_CHARS = 16
_LINE = re.compile(r"[^\n]+")
_SENTENCE = re.compile(r"[^.!?。！？]*[.!?。！？]+|[^.!?。！？]+")


def units(text: str, min_chars: int = MIN_CHARS) -> Iterator[tuple[int, int, bytes]]:
    """(start, length, digest) of each line that is not blank, and of each sentence of min_chars characters or more of a line of several.

    Offsets are code points. Normalised: lowered, white space at the ends dropped and within made one space.
    """
    for line in _LINE.finditer(text):
        spans = [line.span()]
        inner = [m.span() for m in _SENTENCE.finditer(text, *line.span())]
        for s, e in spans + (inner if len(inner) > 1 else []):
            plain = " ".join(text[s:e].lower().split())
            if plain and ((s, e) == line.span() or len(plain) >= min_chars):
                yield s, e - s, hashlib.blake2b(plain.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def repeated_units(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(row, start, length, source)`` of the units that repeat an earlier one, and that one's key; of rows (row, key, t)."""

    def each(texts: list) -> tuple:
        found = [(k, s, n, d) for k, t in enumerate(texts) for s, n, d in units(t or "", min_chars)]
        digests = np.frombuffer(b"".join(x[3] for x in found), np.int64).reshape(-1, 2)
        return [x[0] for x in found], [[x[1] for x in found], [x[2] for x in found], digests[:, 0], digests[:, 1]]

    found = map_texts(rows, "t", "start int, length int, d bigint, e bigint", each)
    # half of the digest settles for most units that nothing repeats them
    often = found.select("d").groupBy("d").agg(F.count("*").alias("n")).where("n > 1")
    found = checkpoint(join_counted(found, often, ["d"], "n").drop("n").withColumn("rank", F.struct("key", "start", "row")))
    first = found.groupBy("d", "e").agg(F.min("rank").alias("first"), F.count("*").alias("n")).where("n > 1")
    return join_counted(found, first, ["d", "e"], "n").where("rank > first").select("row", "start", "length", F.col("first.key").alias("source"))


def drop_repeated_units(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, with_text: bool = False) -> DataFrame:
    """``(key, n_chars, n_removed, n_spans, spans, kept_sha256, repeats_of)`` of every row, and the remaining text, ``kept``, if asked for.

    n_removed: characters that go. spans: ``start-end`` of the maximal removed runs in the original
    text, in code points, comma-joined, empty without one. repeats_of: keys of the rows that keep what goes here, sorted. Of equal units the one of the smallest (key,
    start) stays; a NULL key ranks before all others. NULL counts as empty. Repeated rows are rows of their own.
    Other columns of docs are not read. Empty input, empty result. docs is read several times and must
    give its rows in the same order each time, as a table does.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    spans = repeated_units(rows, min_chars).groupBy("row").agg(F.collect_list(F.struct("start", "length")).alias("x"), F.array_sort(F.collect_set("source")).alias("sources"))
    spans = checkpoint(spans)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row, t, x in zip(b.column("row").to_pylist(), b.column("t").to_pylist(), b.column("x").to_pylist(), strict=True):
                gone = np.zeros(len(t), bool)
                for y in x:
                    gone[y["start"] : y["start"] + y["length"]] = True
                runs = intervals(gone)
                edges = [0, *(z for s, e in runs for z in (s, e + 1)), len(t)]
                left = "".join(t[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))
                out.append((row, int(gone.sum()), len(runs), ",".join(f"{s}-{e + 1}" for s, e in runs), hashlib.sha256(left.encode("utf-8", "surrogatepass")).hexdigest(), left if with_text else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names = ["row", "n_removed", "n_spans", "spans", "sha", "left"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    changed = where_marked(rows.select("row", "t"), spans).join(spans.select("row", "x"), "row").mapInArrow(cut, "row bigint, n_removed bigint, n_spans bigint, spans string, sha string, left string")
    whole = rows.select("row", "key", F.length("t").cast("bigint").alias("n_chars"), F.sha2("t", 256).alias("whole"), *["t"] * with_text)
    joined = whole.join(changed, "row", "left").join(spans.select("row", "sources"), "row", "left")
    kept = [F.coalesce("left", "t").alias("kept")] if with_text else []
    return joined.select(F.col("key").alias(key), "n_chars", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("sha", "whole").alias("kept_sha256"), F.coalesce("sources", F.array().cast(f"array<{docs.schema[key].dataType.simpleString()}>")).alias("repeats_of"), *kept)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return drop_repeated_units(table(spark, sf_dir, "documents"))
