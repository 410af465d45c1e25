"""Work that grows with the rows is done once: names that are repeated, a person's years, pairs that a plan reads again."""

import datetime

from quillgraph.functions.to_cyrillic import to_cyrillic
from quillgraph.plans import QUERIES
from quillgraph.plans.entity_queries import j21_affiliation_of_the_year

SF = "/root/testdata/sf0.001"


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_repeated_name_is_rewritten_once():
    before = to_cyrillic.cache_info().misses
    assert {to_cyrillic("Zhuravlyov Nikita") for _ in range(9)} == {to_cyrillic("Zhuravlyov Nikita")}
    assert to_cyrillic.cache_info().misses <= before + 1 and to_cyrillic(None) is None


def test_names_are_dealt_to_several_tasks(spark):
    assert QUERIES["f15_cyrillic_names"](spark, SF).rdd.getNumPartitions() >= 8


def test_a_person_has_one_affiliation_a_year(spark):
    df, day = spark.createDataFrame, datetime.date
    wrote = [(10, 1), (20, 1), (30, 1), (11, 1), (12, 1), (13, 1), (13, 2)]
    years = [(10, 2001), (20, 2001), (30, 2003), (11, 2001), (12, 2002), (13, 2003)]
    t = {"authorship": df(wrote, "pid long, per long"), "publications": df([(p, y, day(y, 1, 1)) for p, y in years], "pid long, year int, date date"), "pub_depts": df([(10, 7), (20, 4), (30, 9), (10, 5)], "pid long, did long")}
    found = j21_affiliation_of_the_year(t)
    assert {(r.per, r.pid, r.did) for r in found.collect()} == {(1, 10, 4), (1, 20, 4), (1, 30, 9), (1, 11, 4), (1, 12, 9), (1, 13, 9)}
    assert "min(did" in planned(found)


def test_planned_edges_read_their_pairs_once(spark):
    plan = planned(QUERIES["g20_planned_edges"](spark, SF))
    assert plan.count("LogicalRDD") >= 3
