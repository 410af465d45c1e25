"""Grants of works: numbers cut short, repeats, fragments and funders without a number."""

import pytest
from pyspark.sql import functions as F

from quillgraph.operators.grants import distinct_grants, grant_key, whole_keys

ROWS = [
    (1, 1, "RSF", "No. 18-19-0001"), (1, 2, "RSF", "18–19–0001"), (1, 3, "RSF", None), (1, 4, "RFBR", None), (1, 5, "RSF", "18-"), (1, 6, None, "99"),
    (2, 1, "Min", "075-15"), (2, 2, "Min", "075-15-2019"), (2, 3, "Min", "075-15-2019-1896"), (3, 1, "Min", "075-15-2019"), (3, 2, "Min", ""),
    (4, 1, "X", "AAAAA"), (5, 1, "X", "AAAAA-1"), (6, 1, "X", "AAAAA-2"), (None, 1, "X", "AAAAA-2"), (7, 1, None, None),
]


@pytest.fixture
def funding(spark):
    return spark.createDataFrame(ROWS, "pid long, position int, funder string, grant_id string")


def test_keys(spark):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(["Project 075-15-2019-1896?", "18-19-", "9999", None, " ab–12 ", "Grant No. N°75/1-3.", "Nova-12"])], "k int, g string")
    assert [r.x for r in rows.orderBy("k").select(grant_key(F.col("g")).alias("x")).collect()] == ["075-15-2019-1896", None, None, None, "AB-12", "75/1-3", "NOVA-12"]


def test_cut_numbers_lead_to_the_one_whole_number(funding):
    found = {tuple(r) for r in whole_keys(funding.select(grant_key(F.col("grant_id")).alias("key"))).collect()}
    assert found == {("075-15", "075-15-2019-1896"), ("075-15-2019", "075-15-2019-1896"), ("AAAAA", None)}


def test_entries_that_stay(funding):
    found = {(r.pid, r.position, r.grant_key) for r in distinct_grants(funding).collect()}
    assert found == {(1, 1, "18-19-0001"), (1, 4, None), (1, 6, None), (2, 1, "075-15-2019-1896"), (3, 1, "075-15-2019-1896"), (4, 1, None), (5, 1, "AAAAA-1"), (6, 1, "AAAAA-2"), (7, 1, None)}


def test_no_rows(funding):
    assert distinct_grants(funding.where("false")).count() == 0
