"""The driver's star schema read as a publication graph.

publications are orders, persons suppliers (internal: non-negative balance), authorship the line
items of an order, repositories parts, departments nations, organisations regions; a publication
is produced by its customer's nation and implemented by the parts that it buys at a high discount.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ["publications", "persons", "authorship", "repositories", "repo_pubs", "departments", "organizations", "pub_depts"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The graph's tables; each is a projection that reads only the columns it needs."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "customer", "supplier", "part", "lineitem", "nation", "region")}
    orders, items = t["orders"], t["lineitem"]
    return {
        "publications": orders.select(F.col("o_orderkey").alias("pid"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("type"), F.to_date("o_orderdate").alias("date"), F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("venue"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents")),
        "persons": t["supplier"].select(F.col("s_suppkey").alias("per"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("did"), (F.col("s_acctbal") >= 0).alias("internal")),
        "authorship": items.groupBy(F.col("l_orderkey").alias("pid"), F.col("l_suppkey").alias("per")).agg(F.min("l_linenumber").alias("position"), F.bool_or(F.col("l_returnflag") == "R").alias("corresponding")),
        "repositories": t["part"].select(F.col("p_partkey").alias("rid"), F.col("p_name").alias("name"), F.col("p_size").alias("stars"), F.col("p_brand").alias("owner"), F.col("p_type").alias("language")),
        "repo_pubs": items.where("l_discount >= 0.09").select(F.col("l_partkey").alias("rid"), F.col("l_orderkey").alias("pid")).distinct(),
        "departments": t["nation"].select(F.col("n_nationkey").alias("did"), F.col("n_name").alias("dname"), F.col("n_regionkey").alias("oid")),
        "organizations": t["region"].select(F.col("r_regionkey").alias("oid"), F.col("r_name").alias("oname")),
        "pub_depts": orders.join(t["customer"], orders["o_custkey"] == t["customer"]["c_custkey"]).select(F.col("o_orderkey").alias("pid"), F.col("c_nationkey").alias("did")),
    }


#: The same tables for the oracle.
SQL = """WITH RECURSIVE publications AS (SELECT o_orderkey AS pid, o_orderpriority AS title, o_orderstatus AS type, CAST(o_orderdate AS DATE) AS date,
    CAST(year(o_orderdate) AS INTEGER) AS year, o_custkey AS venue, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
persons AS (SELECT s_suppkey AS per, s_name AS name, s_nationkey AS did, s_acctbal >= 0 AS internal FROM supplier),
authorship AS (SELECT l_orderkey AS pid, l_suppkey AS per, min(l_linenumber) AS position, bool_or(l_returnflag = 'R') AS corresponding FROM lineitem GROUP BY 1, 2),
repositories AS (SELECT p_partkey AS rid, p_name AS name, p_size AS stars, p_brand AS owner, p_type AS language FROM part),
repo_pubs AS (SELECT DISTINCT l_partkey AS rid, l_orderkey AS pid FROM lineitem WHERE l_discount >= 0.09),
departments AS (SELECT n_nationkey AS did, n_name AS dname, n_regionkey AS oid FROM nation),
organizations AS (SELECT r_regionkey AS oid, r_name AS oname FROM region),
pub_depts AS (SELECT o_orderkey AS pid, c_nationkey AS did FROM orders JOIN customer ON o_custkey = c_custkey)
"""
