"""The closest title by matching blocks, found through pieces that a close title must share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from difflib import SequenceMatcher
from fractions import Fraction

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.checkpoints import checkpoint, shared_folder
from quillgraph.operators.skew import join_dealt

#: Ratio of a close title.
CUTOFF = 0.9


def _edits(a: int, b: int, cutoff: float) -> int:
    """Letters without a partner in titles of a and b letters, at most, if their ratio is cutoff: a + b - 2 M for the least M."""
    limit = Fraction(str(cutoff))
    return int((a + b) * (1 - limit))


def _longest(n: int, cutoff: float) -> int:
    """The longest title that can be close to one of n letters: its matching letters are n at most."""
    limit = Fraction(str(cutoff))
    return int(2 * n / limit - n)


def pieces(title: str, cutoff: float = CUTOFF) -> list[tuple[int, int, str]]:
    """(number, start, text) of the pieces a title is cut into: one more than edits can spoil, so a close title has one of them unchanged."""
    n = len(title)
    count = min(_edits(_longest(n, cutoff), n, cutoff) + 1, n)
    cuts = [n * k // count for k in range(count + 1)] if count else [0, 0]
    return [(k, a, title[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def windows(query: str, lengths: range, cutoff: float = CUTOFF) -> set[tuple[int, int, str]]:
    """(length, number, text): where the pieces of a close title of some length can stand in query.

    The letters before a piece are shifted by half the edits and half the difference in length at most.
    """
    out, m = set(), len(query)
    for n in lengths:
        count = min(_edits(_longest(n, cutoff), n, cutoff) + 1, n)
        shift = (_edits(m, n, cutoff) + abs(m - n)) // 2
        for k in range(count):
            a, b = n * k // count, n * (k + 1) // count
            for at in range(max(a - shift, 0), min(a + shift, m - (b - a)) + 1):
                out.add((n, k, query[at : at + b - a]))
    return out


def closest_titles(queries: DataFrame, key: str, query: str, titles: DataFrame, title: str, cutoff: float = CUTOFF) -> DataFrame:
    """``(key, title, ratio)``: for each query the title that equals it, else the closest of those at ``cutoff`` or above.

    The ratio is twice the matching blocks' length over both lengths, taken from title to query; of equal ratios the greatest
    title counts. No close title: no row. Found without pairing all: titles are cut into one piece more than the edits that a
    close query can hold, so a query has one piece unchanged, near its place, in a length that the ratio allows; only such pairs,
    of a letter count that the ratio allows, are compared. The filter loses none. NULL and empty queries and titles find
    nothing; repeated titles count once, repeated queries each.
    """
    known = checkpoint(titles.select(F.col(title).alias("title")).where("title <> ''").distinct())
    asked = checkpoint(queries.select(F.col(key).alias("key"), F.col(query).alias("q")).where("q <> ''"))
    texts = checkpoint(asked.select("q").distinct())
    exact = texts.join(known, F.col("q") == F.col("title")).select("q", "title", F.lit(1.0).alias("ratio"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t, len(t), k, p) for t in batch.column(0).to_pylist() for k, _, p in pieces(t, cutoff)]
            yield pa.RecordBatch.from_pydict(dict(zip(("title", "n", "k", "piece"), map(list, zip(*rows, strict=True)), strict=True)) if rows else {"title": [], "n": [], "k": [], "piece": []}, schema=pa.schema([("title", pa.string()), ("n", pa.int32()), ("k", pa.int32()), ("piece", pa.string())]))

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("q", pa.string()), ("n", pa.int32()), ("k", pa.int32()), ("piece", pa.string())])
        for batch in batches:
            for q in batch.column(0).to_pylist():
                m = len(q)
                lengths = range(next((n for n in range(m + 1) if _longest(n, cutoff) >= m), m), _longest(m, cutoff) + 1)
                found = windows(q, lengths, cutoff)
                if found:
                    n, k, piece = zip(*found, strict=True)
                    yield pa.RecordBatch.from_pydict({"q": [q] * len(n), "n": n, "k": k, "piece": piece}, schema=schema)

    open_ = texts.join(exact.select("q"), "q", "left_anti")
    # Written, so that the planner knows how large it is: a title has thousands of places for pieces.
    folder = f"{shared_folder(queries.sparkSession)}/windows-{uuid.uuid4().hex}"
    open_.mapInArrow(slide, "q string, n int, k int, piece string").write.parquet(folder)
    left = queries.sparkSession.read.parquet(folder)
    right = known.mapInArrow(cut, "title string, n int, k int, piece string")
    # A piece that very many titles share is one row of its own and does not meet the queries in one task.
    shared = left.select("n", "k", "piece").distinct()
    met = join_dealt(right, shared, ["n", "k", "piece"], ["title"])
    pairs = checkpoint(left.join(met, ["n", "k", "piece"]).select("q", "title").distinct())

    @F.pandas_udf("double")
    def ratio(t: pd.Series, q: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(t, q, strict=True):
            s = SequenceMatcher(None, a, b)
            out.append(s.ratio() if s.quick_ratio() >= cutoff else 0.0)
        return pd.Series(out)

    close = pairs.withColumn("ratio", ratio("title", "q")).where(F.col("ratio") >= cutoff)
    best = close.groupBy("q").agg(F.max(F.struct("ratio", "title")).alias("b")).select("q", "b.title", "b.ratio")
    return asked.join(exact.unionByName(best), "q").select(F.col("key").alias(key), "title", "ratio")


def placed_titles(queries: DataFrame, key: str, query: str, works: DataFrame, work: str, title: str, cutoff: float = CUTOFF) -> DataFrame:
    """``(key, outcome, work, ratio)`` for every row of queries: exact or fuzzy with the one work of that title, ambiguous, or absent."""
    found = closest_titles(queries, key, query, works, title, cutoff)
    bearers = works.where(F.col(title) != "").groupBy(F.col(title).alias("title")).agg(F.count("*").alias("n"), F.min(work).alias("work"))
    named = found.join(bearers, "title").select(F.col(key).alias("_key"), "n", "work", "ratio")
    all_ = queries.select(key).distinct().join(named, queries[key].eqNullSafe(F.col("_key")), "left")
    outcome = F.when(F.col("n").isNull(), "absent").when(F.col("n") > 1, "ambiguous").when(F.col("ratio") == 1.0, "exact").otherwise("fuzzy")
    return all_.select(key, outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("work")).alias("work"), F.when(F.col("n") == 1, F.col("ratio")).alias("ratio"))
