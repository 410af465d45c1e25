"""Block lists of any size go through Bloom filter cascades."""

import time

from quillgraph.llm import url_filter


def test_a_list_of_200_000_hosts(spark):
    listed = spark.range(200_000).selectExpr("concat('h', id * 3, '.example.org') AS key")
    pages = spark.range(600).selectExpr("id AS page_id", "concat('https://a.h', id, '.example.org/x') AS url")
    start = time.perf_counter()
    found = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, listed, []).collect()}
    assert found == {k: "block" if k % 3 == 0 else "allow" for k in range(600)}
    assert time.perf_counter() - start < 60


def test_a_list_in_parts_has_the_same_verdicts(spark):
    listed = spark.range(300).selectExpr("concat('h', id * 3, '.example.org') AS key").union(spark.createDataFrame([(None,), ("",)], "key string"))
    pages = spark.range(900).selectExpr("id AS page_id", "concat('https://h', id, '.example.org/x') AS url").union(spark.createDataFrame([(None, None), (-1, "no host")], "page_id bigint, url string"))
    whole, parts = (sorted(map(tuple, url_filter.judge(pages, listed, url_filter.RULES, most=most).select("host", "verdict").collect()), key=str) for most in (None, 500))
    assert whole == parts and sum(v == "block" for _, v in whole) == 302
