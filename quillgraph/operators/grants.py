"""Grants that works name: one key for a number that is cut short, one entry for a grant, no fragments beside the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words before a number, as words of their own; a number shorter than this groups nothing.
BEFORE = r"^(?:(?:GRANT|PROJECT|CONTRACT|AGREEMENT|NO\.?|N°|№|#)(?![A-Z])\s*)+"
LEAST = 5


def _dashed(raw: Column) -> Column:
    """A number in upper case with one kind of dash, without the words before it; empty for NULL."""
    one = F.regexp_replace(F.upper(F.trim(F.coalesce(raw, F.lit("")))), "[‐-―−]", "-")
    return F.trim(F.regexp_replace(one, BEFORE, ""))


def _plain(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_dashed(raw), r"[^0-9A-Z/.\-]", ""), r"^[-./]+|[-./]+$", "")


def grant_key(raw: Column) -> Column:
    """The key of a grant number, NULL for one that ends in a dash (it was cut), is too short or is NULL."""
    return F.when(~_dashed(raw).endswith("-") & (F.length(_plain(raw)) >= LEAST), _plain(raw))


def whole_keys(keys: DataFrame) -> DataFrame:
    """``(key, whole)`` of distinct keys that others continue after a dash: the one longest continuation, NULL where there are several.

    Keys meet by their own prefixes, so no key is compared with all; of A, A-1 and A-1-2 only the last counts.
    """
    k = keys.select("key").where("key IS NOT NULL").distinct()
    parts = F.split("key", "-")
    cuts = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-")))
    longer = k.select("key", F.explode(cuts).alias("short")).join(k.select(F.col("key").alias("short")), "short")
    ends = longer.join(longer.select(F.col("short").alias("key")).distinct(), "key", "left_anti")
    return ends.groupBy(F.col("short").alias("key")).agg(F.count("*").alias("n"), F.min("key").alias("one")).select("key", F.when(F.col("n") == 1, F.col("one")).alias("whole"))


def distinct_grants(funding: DataFrame) -> DataFrame:
    """``(pid, position, funder, grant_id, grant_key)`` of the entries that stay, of rows (pid, position, funder, grant_id).

    Of entries with one key the first of a work stays (at one position: by funder, then number). An entry without a key goes where its number begins a key of the same work,
    or where it has no number and its funder has an entry with a key. Rows of a NULL pid are no work's.
    """
    rows = funding.where("pid IS NOT NULL").select("pid", "position", "funder", "grant_id", grant_key(F.col("grant_id")).alias("key"), _plain(F.col("grant_id")).alias("said"))
    whole = whole_keys(rows.select("key")).withColumn("_cut", F.lit(True))
    keyed = rows.join(whole, "key", "left").withColumn("grant_key", F.when(F.col("_cut"), F.col("whole")).otherwise(F.col("key"))).drop("key", "whole", "_cut")
    first = keyed.where("grant_key IS NOT NULL").groupBy("pid", "grant_key").agg(F.min(F.struct("position", "funder", "grant_id")).alias("e")).select("pid", "e.*", "grant_key")
    bare = keyed.where("grant_key IS NULL")
    known = keyed.where("grant_key IS NOT NULL").select("pid", "grant_key", F.col("funder").alias("f"))
    b = bare.select("pid", "position", "funder", "grant_id", "said")
    same_pid = b["pid"] == known["pid"]
    told = F.when(b["said"] != "", F.startswith(known["grant_key"], b["said"])).otherwise(b["funder"].eqNullSafe(known["f"]))
    left = b.join(known, same_pid & told, "left_anti").select("pid", "position", "funder", "grant_id", F.lit(None).cast("string").alias("grant_key"))
    return first.union(left)
