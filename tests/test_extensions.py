"""Stages and stored models."""

import json

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.models import PairModel
from quillgraph.plans.stages import Stage, run_stages


def test_stages_run_in_order_and_by_name(spark):
    more = lambda t: {"x": t["x"].withColumn("id", F.col("id") + 1)}
    twice = lambda t: {"x": t["x"].withColumn("id", F.col("id") * 2), "y": t["x"]}
    stages = [Stage("more", more, ("x",)), Stage("twice", twice), Stage("again", more, ("y",), optional=True)]
    start = {"x": spark.range(1)}
    assert run_stages(stages, start)["x"].first().id == 2 and run_stages(stages, start, {"twice"})["x"].first().id == 0
    with pytest.raises(ValueError, match="no such"):
        run_stages(stages, start, {"nothing"})
    with pytest.raises(ValueError, match="lacks"):
        run_stages(stages, start, {"again"})


def test_stored_model(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"bias": 0.0, "low": 0.13, "high": 0.94, "features": [{"name": "a", "mean": 0, "scale": 1, "weight": 4}, {"name": "b", "mean": 1, "scale": 2, "weight": 0}]}))
    m = PairModel.read(spark, str(path), ["a", "b"])
    rows = spark.createDataFrame([(3.0, 1.0, False), (-3.0, 1.0, False), (0.0, 9.0, None), (3.0, 0.0, True)], "a double, b double, v boolean")
    assert [r.d for r in rows.select(m.decision([F.col("v")]).alias("d")).collect()] == ["merge", "separate", "review", "separate"]
    with pytest.raises(ValueError, match="differ"):
        PairModel.read(spark, str(path), ["b", "a"])
