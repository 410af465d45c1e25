"""Reading stores: the raw log, grouped rows, catalogs, node and edge files, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "source string, `group` string, fetched_at timestamp, request string, payload string, provider string, record_type string, record_key string, schema_version int"


def raw(spark: SparkSession, path: str, source: str, group: str | None = None) -> DataFrame:
    """A source's envelopes, oldest first. Partitions of other sources are not read."""
    rows = spark.read.schema(RAW).parquet(path).where(F.col("source") == source)
    return (rows if group is None else rows.where(F.col("group") == group)).orderBy("fetched_at")


def by_provider(rows: DataFrame, provider: str, old_sources: list[str]) -> DataFrame:
    """A provider's envelopes: those that name it, and older ones by their source."""
    return rows.where((F.col("provider") == provider) | (F.col("provider").isNull() & F.col("source").isin(old_sources)))


def latest_payloads(rows: DataFrame, key: Column) -> DataFrame:
    """``(key, payload)`` of each key's latest envelope; of equal times the larger payload."""
    return rows.groupBy(key.alias("key")).agg(F.max_by("payload", F.struct("fetched_at", "payload")).alias("payload"))


def of_group(rows: DataFrame, group: str, hide: tuple[str, ...] = ("groups", "_version")) -> DataFrame:
    """Rows that a group claims, without bookkeeping columns."""
    return rows.where(F.array_contains("groups", group)).drop(*hide)


def by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key or any merged id is among ids (``id``), once each."""
    wanted = ids.select(F.col("id").alias("_id")).distinct()
    every = rows.select(key, F.explode(F.array_union(F.array(key), F.coalesce("merged_ids", F.array().cast("array<string>")))).alias("_id"))
    return rows.join(every.join(wanted, "_id").select(key).distinct(), key, "left_semi")


def known_groups(tables: list[DataFrame]) -> DataFrame:
    """All groups that claim a row of any table, sorted."""
    out = tables[0].select(F.explode("groups").alias("group"))
    for t in tables[1:]:
        out = out.union(t.select(F.explode("groups")))
    return out.distinct().orderBy("group")


def departments(catalog: DataFrame) -> DataFrame:
    """``(id, name, parent_id, organization_id)`` of catalog rows (uid, name, kind, parent): a parent of kind organization is one.

    A parent that the catalog lacks is an error when the row is read.
    """
    p = catalog.select(F.col("uid").alias("parent"), F.col("kind").alias("parent_kind"))
    joined = catalog.where("kind <> 'organization'").join(p, "parent", "left")
    lost = F.col("parent").isNotNull() & F.col("parent_kind").isNull()
    parent = F.when(lost, F.raise_error(F.concat(F.lit("unknown parent "), "parent"))).otherwise(F.col("parent"))
    is_org = F.col("parent_kind") == "organization"
    return joined.select(F.col("uid").alias("id"), "name", F.when(~is_org, parent).when(lost, parent).alias("parent_id"), F.when(is_org, parent).alias("organization_id"))


def staff(spark: SparkSession, path: str) -> DataFrame:
    """A staff list as CSV with a header; rows without a surname go, and so does a byte order mark."""
    rows = spark.read.csv(path, header=True)
    return rows.toDF(*[c.lstrip("﻿") for c in rows.columns]).where(F.trim("surname") != "")


def node_files(spark: SparkSession, path: str) -> DataFrame:
    """``(id, labels, properties)`` of node files; properties is a variant, NULL where the text is no JSON."""
    rows = spark.read.schema("id string, labels string, properties string").csv(path, header=True, escape='"', multiLine=True)
    return rows.withColumn("properties", F.try_parse_json("properties"))


def edge_files(spark: SparkSession, path: str) -> DataFrame:
    """Edges of relationship files, with their properties as a variant."""
    rows = spark.read.schema("start_id string, end_id string, src_label string, tgt_label string, type string, properties string").csv(path, header=True, escape='"', multiLine=True)
    return rows.withColumn("properties", F.try_parse_json("properties"))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''").distinct()


def period(rows: DataFrame, at: str, first: str, last: str) -> DataFrame:
    """Rows of a closed period; the comparison reaches the scan."""
    if first > last:
        raise ValueError("the period ends before it begins")
    return rows.where(F.col(at).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def newest_snapshot(names: DataFrame) -> DataFrame:
    """The name, of those that end in a day as ``dd-mm-yyyy``, with the latest one: by date, not by text."""
    day = F.try_to_date(F.regexp_extract("name", r"(\d{2}-\d{2}-\d{4})(?:\.\w+)?$", 1), "dd-MM-yyyy")
    return names.select(F.max_by("name", day).alias("name"), F.max(day).alias("day"))


def documents(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files as bytes, by path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")
