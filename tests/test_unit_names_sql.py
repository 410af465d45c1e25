"""f42's SQL states the rule of its operator where a name overlaps a longer one without lying in it."""

import duckdb

from quillgraph import plans


def test_a_name_that_only_overlaps_a_longer_one_counts(spark, tmp_path):
    items = [(1, "der der die das und"), (2, "an an")]
    texts = ["so der der der die x", "so der der die x", "an an an", None, "der der die der der", "ader der die"]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    for name in ("benchmark", "documents"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = {tuple(r) for r in plans.QUERIES["f42_unit_names"](spark, str(tmp_path)).collect()}
    assert found == set(db.execute(plans.ORACLE["f42_unit_names"]).fetchall())
    assert {(d, n) for d, _, n in found} == {(0, "der der"), (0, "der der die"), (1, "der der die"), (2, "an an"), (4, "der der"), (4, "der der die")}
