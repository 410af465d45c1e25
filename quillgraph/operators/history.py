"""Versions, claims and decisions: what a store of changing rows does, as table rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(current: DataFrame, incoming: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(new state, archived rows). Both inputs have key and fields; current has ``_version`` as well.

    A row whose fields are equal stays; a changed one gets the next version and its old row is archived
    as a revision; a new one starts at 1. Rows that are not incoming stay.
    """
    fields = [c for c in incoming.columns if c != key]
    old = current.select(key, F.struct(*fields).alias("old"), "_version")
    new = incoming.select(key, F.struct(*fields).alias("new"), F.lit(True).alias("given"))
    joined = old.join(new, key, "full")
    changed = F.col("given") & F.col("_version").isNotNull() & ~F.col("old").eqNullSafe(F.col("new"))
    value = F.when(F.col("given"), F.col("new")).otherwise(F.col("old"))
    version = F.when(F.col("_version").isNull(), 1).when(changed, F.col("_version") + 1).otherwise(F.col("_version"))
    state = joined.select(key, value.alias("v"), version.alias("_version")).select(key, "v.*", "_version")
    return state, joined.where(changed).select(key, "old.*", "_version")


def replace_group(rows: DataFrame, written: DataFrame, key: str, group: str) -> DataFrame:
    """rows after a group wrote its own: rows it no longer wrote lose its claim, and unclaimed ones go."""
    is_written = written.select(key).distinct().withColumn("_w", F.lit(True))
    joined = rows.join(is_written, key, "left")
    groups = F.when(F.col("_w"), F.array_union("groups", F.array(F.lit(group)))).otherwise(F.array_remove("groups", group))
    return joined.withColumn("groups", groups).where(F.size("groups") > 0).drop("_w")


def trim(rows: DataFrame, at: str, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """(rows kept, rows that a retention cutoff drops)."""
    return rows.where(F.col(at) >= cutoff), rows.where(F.col(at) < cutoff)


def first_claims(claims: DataFrame, key: str, owner: str, order: list[str]) -> DataFrame:
    """``(key, owner)``: who claimed a key first."""
    return claims.groupBy(key).agg(F.min_by(owner, F.struct(*order)).alias(owner))


def owners(identifiers: DataFrame, registry: DataFrame, entity: str, key: str, owner: str) -> DataFrame:
    """``(entity, owner, state)`` by the owners of an entity's identifiers: known, new or conflict."""
    joined = identifiers.join(registry, key, "left").groupBy(entity).agg(F.min(owner).alias("low"), F.max(owner).alias("high"))
    state = F.when(F.col("low").isNull(), "new").when(F.col("low") == F.col("high"), "known").otherwise("conflict")
    return joined.select(entity, F.when(F.col("low") == F.col("high"), F.col("low")).alias(owner), state.alias("state"))


def latest_writes(changes: DataFrame, keys: list[str], at: list[str], value: str) -> DataFrame:
    """The value of the latest change of each field."""
    return changes.groupBy(*keys).agg(F.max_by(value, F.struct(*at)).alias(value))


def version_diffs(snapshots: DataFrame, key: str, version: str, fields: list[str]) -> DataFrame:
    """``(key, version, field, old, new)``: what changed from each version to the next; fields as text."""
    order = Window.partitionBy(key).orderBy(version)
    paired = snapshots.select(key, version, *[F.struct(F.col(c).cast("string").alias("old"), F.lead(F.col(c).cast("string")).over(order).alias("new")).alias(c) for c in fields], F.lead(version).over(order).alias("_next"))
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c)["old"].alias("old"), F.col(c)["new"].alias("new")) for c in fields]))
    return paired.where("_next IS NOT NULL").select(key, version, stacked.alias("d")).select(key, version, "d.*").where("NOT (old <=> new)")


def fresher(stored: DataFrame, incoming: DataFrame, key: str, at: str) -> DataFrame:
    """Incoming rows that are newer than what is stored, or new."""
    seen = stored.select(key, F.col(at).alias("_stored"))
    return incoming.join(seen, key, "left").where(F.col("_stored").isNull() | (F.col(at) > F.col("_stored"))).drop("_stored")


def decisions(answers: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(a, b, verdict)`` from answers (x, y, verdict, at) under aliases (old, new).

    A pair's latest answer counts, but once it was told to be different no other answer overrides that; a
    pair that became one entity is dropped.
    """
    def mapped(df: DataFrame, c: str) -> DataFrame:
        m = aliases.select(F.col("old").alias("_o"), F.col("new").alias("_n"))
        return df.join(m, df[c] == m["_o"], "left").withColumn(c, F.coalesce("_n", c)).drop("_o", "_n")

    pairs = mapped(mapped(answers, "x"), "y").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "verdict", "at")
    last = F.max_by("verdict", F.struct("at", "verdict"))
    return pairs.groupBy("a", "b").agg(F.when(F.bool_or(F.col("verdict") == "different"), "different").otherwise(last).alias("verdict"))


def with_overrides(rows: DataFrame, overrides: DataFrame, key: str, field: str) -> DataFrame:
    """rows with the overridden field, and ``covered``: the automatic value that an override hides."""
    o = overrides.select(key, F.col("value").alias("_value"))
    joined = rows.join(o, key, "left")
    return joined.withColumn("covered", F.when(F.col("_value").isNotNull(), F.col(field))).withColumn(field, F.coalesce("_value", field)).drop("_value")
