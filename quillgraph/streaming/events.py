"""Structured Streaming over an append-only event log.

Each operator takes a streaming DataFrame and returns one; ``drain`` runs it over what is there and stops.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillgraph.operators.components import shared_folder


def read_log(spark: SparkSession, path: str, files_each: int = 100) -> DataFrame:
    """An append-only parquet log as a stream, oldest files first; the schema is that of what is there now."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # as a pattern, a log may also be a single file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(pattern)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream gives for all input there is, exactly once, by way of the shared folder."""
    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{place}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{place}/out")
    # other modes hand over a whole batch at a time; the last write of a key counts, so a batch is kept under its number
    writer.foreachBatch(lambda df, k: df.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{place}/out/{k}")).start().awaitTermination()
    return spark.read.parquet(f"{place}/out/*")


def deduplicated(stream: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """The first row of each key; a key is forgotten ``late`` after it was last seen."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, key: str, at: str, gap: str, late: str = "0 seconds") -> DataFrame:
    """``(key, start, end, n)`` of runs of events less than gap apart; on a stream, once they are over."""
    if events.isStreaming:
        events = events.withWatermark(at, late)
    found = events.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windows(events: DataFrame, at: str, length: str, slide: str | None = None, late: str = "0 seconds") -> DataFrame:
    """``(start, n, total)`` of tumbling windows, or of sliding ones."""
    if events.isStreaming:
        events = events.withWatermark(at, late)
    return events.groupBy(F.window(at, length, slide).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "n", "total")


def latest_values(stream: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``(key, at_us, value, disputed)`` after each batch: the newest value of a key.

    An older observation changes nothing however late it comes; two different ones of the same time leave the value
    unknown until a newer one. State is one row for each key.
    """
    def step(key_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at_, value_, disputed = state.get if state.exists else (None, None, False)
        for pdf in batches:
            for t, v in zip(pdf["at_us"], pdf["value"], strict=True):
                if at_ is None or t > at_:
                    at_, value_, disputed = int(t), float(v), False
                elif t == at_ and (disputed or v != value_):
                    value_, disputed = None, True
        state.update((at_, value_, disputed))
        yield pd.DataFrame({"key": [key_[0]], "at_us": [at_], "value": [value_], "disputed": [disputed]}).astype({"value": "float64"})

    rows = stream.select(F.col(key).cast("bigint").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at_us"), F.col(value).cast("double").alias("value"))
    out = rows.groupBy("key").applyInPandasWithState(step, "key bigint, at_us bigint, value double, disputed boolean", "at_us bigint, value double, disputed boolean", "update", GroupStateTimeout.NoTimeout)
    return out.withColumnRenamed("key", key)


def lockouts(stream: DataFrame, key: str, at: str, most: int = 30, within_s: int = 900, locked_s: int = 900) -> DataFrame:
    """``(key, locked_at, until)``: a key is locked by ``most`` failures within ``within_s`` seconds of a run's first one.

    A run's window starts at its first failure; a later one starts a new run. Failures while locked count for
    nothing. Input is failures only; those of a batch are put in order, so batches must follow time.
    """
    def step(key_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, count, until = state.get if state.exists else (None, 0, None)
        times = sorted(int(t) for pdf in batches for t in pdf["at_us"])
        out = []
        for t in times:
            if until is not None and t < until:
                continue
            if first is None or t - first > within_s * 1_000_000:
                first, count = t, 0
            count += 1
            if count >= most:
                until, first, count = t + locked_s * 1_000_000, None, 0
                out.append((key_[0], t, until))
        state.update((first, count, until))
        yield pd.DataFrame(out, columns=["key", "locked_us", "until_us"]).astype("int64")

    rows = stream.select(F.col(key).cast("bigint").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at_us"))
    out = rows.groupBy("key").applyInPandasWithState(step, "key bigint, locked_us bigint, until_us bigint", "first bigint, count int, until bigint", "append", GroupStateTimeout.NoTimeout)
    return out.select(F.col("key").alias(key), F.timestamp_micros("locked_us").alias("locked_at"), F.timestamp_micros("until_us").alias("until"))


def job_states(stream: DataFrame, key: str, at: str, state: str, final: list[str]) -> DataFrame:
    """``(key, state)`` after each batch: the newest state, but once final it stays."""
    x = F.struct(F.col(state).isin(final).alias("final"), F.when(F.col(state).isin(final), -F.unix_micros(F.col(at).cast("timestamp"))).otherwise(F.unix_micros(F.col(at).cast("timestamp"))).alias("t"), F.col(state).alias("s"))
    return stream.groupBy(key).agg(F.max(x).alias("x")).select(key, F.col("x.s").alias(state))


def audit(stream: DataFrame, write, bulk_over: int) -> DataFrame:
    """Hand each batch to ``write(df, kind)``: its rows, or one summary if they are more than bulk_over."""
    def each(df: DataFrame, number: int) -> None:
        if df.limit(bulk_over + 1).count() > bulk_over:
            write(df.agg(F.count("*").alias("n")).withColumn("batch", F.lit(number)), "bulk")
        else:
            write(df, "rows")

    return stream.writeStream.foreachBatch(each)
