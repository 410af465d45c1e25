"""Connected components as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.checkpoints import checkpoint, shared_folder
from quillgraph.operators.skew import join_counted

__all__ = ["checkpoint", "connected_components", "shared_folder", "spark_session"]


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """``(node, component)`` of every node that has an edge; the component is its smallest node.

    Alternates large-star and small-star steps until the edges no longer change. Every step is a
    partially aggregated minimum and an equi-join in which a hub's edges are dealt out, and no step
    makes more rows than it reads. Loops and NULL ends are ignored; an empty input gives an
    empty result. Nodes may be of any ordered type.
    """
    e = edges.select(F.col(src).alias("x"), F.col(dst).alias("y")).where("x <> y")
    e = checkpoint(e.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    before = None
    while (now := _signature(e)) != before:
        before = now
        both = e.union(e.select("b", "a")).toDF("u", "n")
        low = both.groupBy("u").agg(F.min("n").alias("m"), F.count("*").alias("c")).select("u", F.least("m", "u").alias("m"), "c")
        e = checkpoint(join_counted(both, low, ["u"], "c", 2 * now[0]).where("n > u").select(F.col("n").alias("a"), F.col("m").alias("b")))
        low = e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c"))
        rest = join_counted(e, low, ["a"], "c", now[0]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = checkpoint(low.select("a", F.col("m").alias("b")).union(rest).where("a <> b").distinct())
    return e.toDF("node", "component").union(e.select("b", "b").distinct())


def spark_session(name: str = "quillgraph", cores: int | str = "*") -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
