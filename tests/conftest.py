import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quillgraph.operators.components import spark_session

    session = spark_session("tests", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def stored(spark, tmp_path):
    """Rows as a table that is read in one order each time."""

    def put(rows, schema, name="t"):
        path = str(tmp_path / name)
        spark.createDataFrame(rows, schema).coalesce(2).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    return put
