"""Which readings of cut addresses a document itself confirms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.wraps import unwrapped


def confirmed_readings(mentions: DataFrame) -> DataFrame:
    """``(doc, mention, url, settled)`` of mentions (doc, mention, raw): the readings that stay, and whether just one can be meant.

    If a document also writes some readings of a mention out, without a break, those stay; else all do. Case tells no
    addresses apart. A mention without a reading gives no row; a NULL doc confirms nothing. Readings of one mention are 32 at most,
    and a written address joins once for each document, so no group grows with the table.
    """
    written = mentions.where(~F.contains("raw", F.lit("\n"))).select("doc", F.explode(unwrapped(F.col("raw"))).alias("u"))
    written = written.select("doc", F.lower("u").alias("u")).distinct().withColumn("sure", F.lit(True))
    read = mentions.select("doc", "mention", F.explode(unwrapped(F.col("raw"))).alias("url")).distinct().withColumn("u", F.lower("url"))
    of_mention = Window.partitionBy("doc", "mention")
    marked = read.join(written, ["doc", "u"], "left").withColumn("sure", F.coalesce("sure", F.lit(False))).withColumn("some", F.bool_or("sure").over(of_mention))
    return marked.where(F.col("sure") | ~F.col("some")).select("doc", "mention", "url", (F.count("*").over(of_mention) == 1).alias("settled"))
