"""Writing: the raw log, nodes and edges by declaration, snapshots, reports, site files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """Which columns of an entity become a node's properties; nested ones as JSON text."""

    label: str
    key: str
    properties: list[str] = field(default_factory=list)

    def rows(self, entities: DataFrame) -> DataFrame:
        kinds = dict(entities.dtypes)
        nested = [F.to_json(c).alias(c) if kinds[c].startswith(("struct", "map")) or "struct" in kinds[c] else F.col(c) for c in self.properties]
        return entities.where(F.col(self.key).isNotNull()).select(F.lit(self.label).alias("label"), F.col(self.key).alias("id"), *nested)


@dataclass(frozen=True)
class Edge:
    """Edges out of an embedded list: ``target`` is an id, or a struct's field of ids; ``keep`` guards it."""

    kind: str
    key: str
    each: str
    target: str | None = None
    properties: list[str] = field(default_factory=list)
    keep: Column | None = None

    def rows(self, entities: DataFrame) -> DataFrame:
        many = dict(entities.dtypes)[self.each].startswith("array")
        x = F.explode(self.each) if many else F.col(self.each)
        out = entities.select(F.col(self.key).alias("src"), x.alias("x"))
        out = out.where(self.keep) if self.keep is not None else out
        tgt = F.col(f"x.{self.target}") if self.target else F.col("x")
        return out.select(F.lit(self.kind).alias("rel"), "src", tgt.alias("tgt"), *[F.col(f"x.{p}").alias(p) for p in self.properties]).where("tgt IS NOT NULL")


def append_raw(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("source").parquet(path)


def write_snapshot(tables: dict[str, DataFrame], path: str, only: set[str] | None = None) -> None:
    """Each table as parquet under its name; ``only``: rewrite these and leave the others."""
    for name, t in tables.items():
        if only is None or name in only:
            t.write.mode("overwrite").parquet(f"{path}/{name}")


def write_report(rows: DataFrame, path: str) -> None:
    """CSV with a header, quotes doubled; a part of the report for each partition."""
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("lineSep", "\r\n").csv(path)


def write_site(tables: dict[str, DataFrame], path: str, public: dict[str, list[str]] | None = None) -> None:
    """JSON lines for each table; ``public``: the columns that may leave, tables without any are not written."""
    for name, t in tables.items():
        if public is None or name in public:
            (t if public is None else t.select(*public[name])).write.mode("overwrite").json(f"{path}/{name}")


def grant_report(publications: DataFrame, authors: DataFrame) -> DataFrame:
    """One row for each publication (pid, title, year), newest first, unknown years last, with its authors (pid, position, name) in order."""
    placed = F.array_sort(F.collect_list(F.struct("position", "name")))
    joined = authors.groupBy("pid").agg(F.array_join(F.transform(placed, lambda x: x["name"]), "; ").alias("authors"))
    return publications.join(joined, "pid", "left").orderBy(F.col("year").desc_nulls_last(), "pid")


def archive(snapshots: DataFrame, archived: DataFrame) -> DataFrame:
    """archived with the snapshots it lacks, each under the hash of its content."""
    named = snapshots.select(F.sha2(F.to_json(F.struct(*snapshots.columns)), 256).alias("hash"), F.struct(*snapshots.columns).alias("snapshot"))
    return archived.unionByName(named.join(archived.select("hash"), "hash", "left_anti").dropDuplicates(["hash"]))
