"""Sources and sinks on files of the test's own."""

import pytest
from pyspark.sql import functions as F

from quillgraph.sources import sinks, stores


def test_raw_log(spark, tmp_path):
    path = str(tmp_path / "raw")
    rows = [("a", "g", 2, "p2", None, "k"), ("a", "g", 1, "p1", "prov", "k"), ("b", "h", 1, "q", "prov", "l"), ("a", "h", 3, "p0", "prov", "m")]
    df = spark.createDataFrame(rows, "source string, `group` string, s long, payload string, provider string, record_key string").select("source", "group", F.timestamp_seconds("s").alias("fetched_at"), F.lit("").alias("request"), "payload", "provider", F.lit("work").alias("record_type"), "record_key", F.lit(2).alias("schema_version"))
    sinks.append_raw(df.where("source = 'a'"), path)
    sinks.append_raw(df.where("source = 'b'"), path)
    assert [r.payload for r in stores.raw(spark, path, "a", "g").collect()] == ["p1", "p2"]
    every = spark.read.parquet(path)
    assert sorted(r.payload for r in stores.by_provider(every, "prov", ["a"]).collect()) == ["p0", "p1", "p2", "q"]
    assert {r.key: r.payload for r in stores.latest_payloads(every, F.col("record_key")).collect()} == {"k": "p2", "l": "q", "m": "p0"}


def test_grouped_rows(spark):
    rows = spark.createDataFrame([("1", ["g"], ["9"]), ("2", ["g", "h"], None), ("3", ["h"], [])], "id string, groups array<string>, merged_ids array<string>")
    assert sorted(r.id for r in stores.of_group(rows, "g").collect()) == ["1", "2"]
    ids = spark.createDataFrame([("9",), ("3",), ("1",)], "id string")
    assert sorted(r.id for r in stores.by_ids(rows, ids, "id").collect()) == ["1", "3"]
    assert [r["group"] for r in stores.known_groups([rows, rows]).collect()] == ["g", "h"]


def test_catalogs(spark, tmp_path):
    c = spark.createDataFrame([("o", "Org", "organization", None), ("d", "Dep", "department", "o"), ("e", "Lab", "lab", "d")], "uid string, name string, kind string, parent string")
    assert {tuple(r) for r in stores.departments(c).collect()} == {("d", "Dep", None, "o"), ("e", "Lab", "d", None)}
    with pytest.raises(Exception, match="unknown parent"):
        stores.departments(c.where("uid <> 'd'")).collect()
    (tmp_path / "staff.csv").write_text("﻿name_ru,surname\nx,S\ny,\n", encoding="utf-8")
    assert [tuple(r) for r in stores.staff(spark, str(tmp_path / "staff.csv")).collect()] == [("x", "S")]
    (tmp_path / "ids.txt").write_text("a\n\n b \na\n")
    assert sorted(r.id for r in stores.id_list(spark, str(tmp_path / "ids.txt")).collect()) == ["a", "b"]
    names = spark.createDataFrame([("s-02-01-2024.json",), ("s-30-12-2023.json",), ("other",)], "name string")
    assert stores.newest_snapshot(names).first().name == "s-02-01-2024.json"
    with pytest.raises(ValueError, match="ends before"):
        stores.period(names, "name", "2024-02-01", "2024-01-01")


def test_files(spark, tmp_path):
    (tmp_path / "x_nodes.csv").write_text('id,labels,properties\n1,Person,"{""a"": 1}"\n2,Person,oops\n')
    out = stores.node_files(spark, str(tmp_path / "*_nodes.csv")).select("id", F.try_variant_get("properties", "$.a", "int").alias("a"))
    assert {tuple(r) for r in out.collect()} == {("1", 1), ("2", None)}
    (tmp_path / "p.pdf").write_bytes(b"%PDF")
    assert [bytes(r.content) for r in stores.documents(spark, str(tmp_path)).collect()] == [b"%PDF"]


def test_declared_nodes_and_edges(spark):
    e = spark.createDataFrame([("p", [("r1", "owner"), (None, "x"), ("r2", "member")], ("n", 1), "d"), (None, [], None, None)], "id string, repos array<struct<rid:string,role:string>>, extra struct<a:string,b:int>, dept string")
    assert [tuple(r) for r in sinks.Node("Person", "id", ["dept", "extra"]).rows(e).collect()] == [("Person", "p", "d", '{"a":"n","b":1}')]
    out = sinks.Edge("CONTRIBUTED_TO", "id", "repos", "rid", ["role"], F.col("x.role") != "member").rows(e)
    assert [tuple(r) for r in out.collect()] == [("CONTRIBUTED_TO", "p", "r1", "owner")]
    assert [tuple(r) for r in sinks.Edge("BELONGS_TO", "id", "dept").rows(e).collect()] == [("BELONGS_TO", "p", "d")]


def test_outputs(spark, tmp_path):
    pubs = spark.createDataFrame([(1, "t", 2020), (2, "u", None), (3, "v", 2021)], "pid long, title string, year int")
    authors = spark.createDataFrame([(1, 2, "B"), (1, 1, "A")], "pid long, position int, name string")
    assert [(r.pid, r.authors) for r in sinks.grant_report(pubs, authors).collect()] == [(3, None), (1, "A; B"), (2, None)]
    sinks.write_snapshot({"pubs": pubs, "authors": authors}, str(tmp_path / "s"))
    sinks.write_snapshot({"pubs": pubs.limit(1), "authors": authors.limit(0)}, str(tmp_path / "s"), {"pubs"})
    assert spark.read.parquet(str(tmp_path / "s/pubs")).count() == 1 and spark.read.parquet(str(tmp_path / "s/authors")).count() == 2
    sinks.write_site({"pubs": pubs, "authors": authors}, str(tmp_path / "w"), {"pubs": ["title"]})
    assert spark.read.json(str(tmp_path / "w/pubs")).columns == ["title"] and not (tmp_path / "w/authors").exists()
    sinks.write_report(pubs, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True, escape='"').count() == 3
    empty = spark.createDataFrame([], "hash string, snapshot struct<pid:long,title:string,year:int>")
    once = sinks.archive(pubs, empty)
    assert sinks.archive(pubs.union(pubs), once).count() == 3
