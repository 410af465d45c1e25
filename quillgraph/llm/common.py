"""What the operators share: reading a table and mapping texts batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Bits of the filter that keeps rows without a match from moving. Its size is fixed: a fuller one lets more rows through.
FILTER_BITS = 1 << 23
#: Texts that a Python task holds as Python objects at once, in bytes.
PART_BYTES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_parts(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches, cut where their texts reach PART_BYTES, so that texts don't add up; one longer text is a part of its own."""
    for whole in batches:
        read = whole.column(text)
        lengths = pc.list_value_length(read) if pa.types.is_list(read.type) else pc.binary_length(read)
        start = total = 0
        for k, size in enumerate(pc.fill_null(lengths, 0).to_pylist()):
            if total and total + size > PART_BYTES:
                yield whole.slice(start, k - start)
                start, total = k, 0
            total += size
        yield whole.slice(start)
        pa.default_memory_pool().release_unused()  # workers are used again by later stages


def map_texts(df: DataFrame, text: str, fields: str, each: Callable[[list], tuple], keep: bool = False) -> DataFrame:
    """df without its text column (with it if ``keep``), and the fields that ``each`` computes from a list of texts (or of id lists).

    ``each`` returns ``(rows, columns)``: which of the texts each row comes from (None: one row for
    each text) and a list of columns. All other columns pass as Arrow arrays, untouched, so NULL
    keys and large integers stay as they are. Texts come in parts (see ``in_parts``).
    """
    kept = [c for c in df.columns if keep or c != text]
    added = _parse_datatype_string(fields)
    schema = StructType([df.schema[c] for c in kept] + added.fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, text):
            rows, columns = each(batch.column(text).to_pylist())
            left = [batch.column(c) for c in kept]
            left = left if rows is None else [c.take(pa.array(rows, pa.int64())) for c in left]
            right = [pa.array(c, f.type, from_pandas=False) for c, f in zip(columns, list(arrow)[len(kept) :], strict=True)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(left, arrow, strict=False)] + right, schema=arrow)

    return df.mapInArrow(run, schema)


def intervals(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each maximal run of set flags."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


def split_marked(rows: DataFrame, marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows whose ``row`` may be in marked (all that are, and few others), and the rest; by a filter of a fixed size."""
    bit = F.pmod(F.xxhash64("row"), F.lit(FILTER_BITS))
    words = marked.select(bit.alias("p")).groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("m"))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for w, m in words.toPandas().itertuples(index=False):
        bits[w] = m
    shared = rows.sparkSession.sparkContext.broadcast(bits)
    names = rows.columns

    def part(set_: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = b.column("p").to_numpy(zero_copy_only=False)
                yield b.select(names).filter(pa.array((shared.value[p >> 6] >> (p & 63)) & 1 == set_))

        return keep

    return tuple(rows.withColumn("p", bit).mapInArrow(part(k), rows.schema) for k in (1, 0))


def where_marked(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """rows whose ``row`` may be in marked: all that are, and few others."""
    return split_marked(rows, marked)[0]
