"""Exact deduplication by deterministic block naming, in DataFrame operations only.

A text is a run of fixed-size blocks. Sorting the distinct blocks gives each an integer name; then
adjacent names are paired and the distinct pairs sorted and named, until one name is left of each
text. Equal blocks get equal names and different ones different names at every level, so a
document's last name, together with its level, is equal for equal texts only.

Blocks are sorted by (hash, length) and, where that ties, by content. Whether it ties is not left
to chance: every distinct block is compared. So the rows that are sorted, joined and paired carry
16 bytes of a block, and each distinct block's content moves once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import table
from quillgraph.llm.text_sql import ascii_lower
from quillgraph.operators.components import checkpoint
from quillgraph.operators.skew import join_counted

BLOCK = 16384


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of rows, sorted, with ``name``, integers that rise in that order, and ``n``, how many rows have them."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return checkpoint(counted.orderBy(*keys).withColumn("name", F.monotonically_increasing_id()))


def _blocks(text: Column, size: int) -> Column:
    """The blocks of a text; the empty text has one, empty."""
    last = F.greatest(F.ceil(F.length(text) / size).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(text, k * size + 1, F.lit(size)))


def identities(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``(key, text_sha256, level, name)``: level and name are equal for equal texts only.

    Texts are compared with A-Z lowered, as a whole; NULL counts as empty. block: characters of a
    block; any size gives the same classes. Keys may be NULL or repeat.
    """
    # a row's own number tells repeated keys apart while its blocks are paired
    rows = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), ascii_lower(F.col(text)).alias("t"))
    digest = F.when(F.col("at") == 0, F.sha2("t", 256))
    parts = rows.select("key", "row", "t", F.posexplode(_blocks(F.col("t"), block)).alias("at", "b"))
    h, size = F.xxhash64("b").alias("h"), F.length("b").alias("size")
    current = checkpoint(parts.select("key", "row", "at", h, size, digest.alias("sha")))

    contents = parts.select("b").distinct().select(h, size)
    tied = checkpoint(contents.groupBy("h", "size").count().where("count > 1").select("h", "size"))
    if tied.isEmpty():
        current = current.withColumn("tie", F.lit(0))
    else:  # hashes that different blocks share: their contents are sorted as well
        same = parts.select("row", "at", "b", h, size).join(tied, ["h", "size"])
        ties = same.select("b").distinct().withColumn("tie", F.dense_rank().over(Window.partitionBy(F.xxhash64("b")).orderBy("b")))
        ties = same.join(ties, "b").select("row", "at", "tie")
        current = current.join(ties, ["row", "at"], "left").withColumn("tie", F.coalesce("tie", F.lit(0)))

    names = _named(current, ["h", "size", "tie"])
    current = checkpoint(join_counted(current, names, ["h", "size", "tie"], "n").select("key", "row", "at", "name", "sha"))
    several = current.where("at = 1").select("row")
    done = current.join(several, "row", "left_anti").select("key", "sha", F.lit(0).alias("level"), "name")
    current, level = current.join(several, "row", "left_semi"), 0
    while not current.isEmpty():
        level += 1
        pairs = current.groupBy("row", F.expr("at div 2").alias("at")).agg(
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
            F.max("key").alias("key"),
            F.max("sha").alias("sha"),
        )
        pairs = checkpoint(pairs)
        current = checkpoint(join_counted(pairs, _named(pairs, ["left", "right"]), ["left", "right"], "n").select("key", "row", "at", "name", "sha"))
        several = current.where("at = 1").select("row")
        done = done.union(current.join(several, "row", "left_anti").select("key", "sha", F.lit(level), "name"))
        current = current.join(several, "row", "left_semi")
    return done.select(F.col("key").alias(key), F.col("sha").alias("text_sha256"), "level", "name")


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``(key, keep_id, group_size, kept, text_sha256)`` for every row of docs.

    Of rows with equal texts (A-Z lowered, NULL as empty) the largest key stays; if several rows
    have it, all of them are marked as kept. keep_id is NULL only where all keys of a group are;
    such rows are kept. Other columns of docs are not read. Empty input, empty result.
    """
    found = checkpoint(identities(docs, key, text, block))
    groups = found.groupBy("level", "name").agg(F.max(key).alias("keep_id"), F.count("*").alias("group_size"))
    joined = join_counted(found, groups, ["level", "name"], "group_size")
    return joined.select(key, "keep_id", "group_size", F.col(key).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)
"""
