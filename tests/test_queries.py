"""Every query of the engine against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from quillgraph import plans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(rows, columns):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 5)
        return v

    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(one(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_sql(spark, db, name):
    found = plans.QUERIES[name](spark, DATA)
    cursor = db.execute(plans.ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    assert plain(map(tuple, found.collect()), found.columns) == plain(cursor.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_query_runs(spark, name):
    found = plans.QUERIES[name](spark, DATA)
    assert found.columns and found.count() >= 0


def test_entry_works_without_the_corpus_operators(spark):
    import __spark_entry__

    assert set(plans.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["a", "b", "w"]
