"""Schema guards, probability extraction, refit parameters, payload coercion and routing."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import types as T

from riskweave.operators import models as ml
from riskweave.operators import schema as sch
from riskweave.sources import payloads as pl


def test_resolve_and_require_target(spark):
    df = spark.createDataFrame([(1, "1")], "id long, target string")
    assert sch.resolve_target(df) == "target"
    assert sch.resolve_target(df.withColumnRenamed("target", "HasDetections")) == "HasDetections"
    with pytest.raises(KeyError):
        sch.resolve_target(df.drop("target"))
    assert dict(sch.require_target(df).dtypes)["target"] == "int"
    with pytest.raises(KeyError):
        sch.require_target(df.drop("target"))


def test_prediction_column_and_width_guard(spark):
    df = spark.createDataFrame([(1, 0.2, 0.3)], "id long, score double, oof_pred double")
    assert sch.prediction_column(df) == "oof_pred"
    assert sch.prediction_column(df.drop("oof_pred")) == "id"
    sch.attribution_width_check(3, 3)
    with pytest.raises(ValueError):
        sch.attribution_width_check(3, 4)


def test_align_adds_drops_orders(spark):
    df = spark.createDataFrame([(1, "x", 9)], "b long, stray string, a int")
    out = sch.align(df, [("a", T.DoubleType()), ("b", T.LongType()), ("c", T.StringType())])
    assert out.columns == ["a", "b", "c"] and out.first()["c"] is None


def test_gbt_probability_is_sigmoid_of_twice_margin(spark):
    from pyspark.ml.functions import array_to_vector, vector_to_array
    rows = [(i, [float(i % 7), float(i % 3)], float(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x array<double>, target double").withColumn(
        "features", array_to_vector("x"))
    m = ml.gbt_leafwise(max_iter=5, maxDepth=3).setLabelCol("target").fit(df)
    out = ml.positive_probability(m.transform(df)).select(
        "p", vector_to_array("rawPrediction")[1].alias("margin")).collect()
    for r in out:
        assert math.isclose(r.p, 1.0 / (1.0 + math.exp(-2.0 * r.margin)), rel_tol=1e-9)


def test_early_stopping_uses_held_out_fold(spark):
    from pyspark.ml.functions import array_to_vector
    rows = [(i, i % 5, [float(i % 11)], float((i * 7) % 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, fold int, x array<double>, target double").withColumn(
        "features", array_to_vector("x"))
    res = ml.train_oof(df, ml.gbt_leafwise(max_iter=50, maxDepth=2), k=5)
    assert res.oof.count() == 300
    assert all(m.getNumTrees <= 50 for m in res.models)


def test_refit_whole_number_floats(spark):
    from pyspark.ml.functions import array_to_vector
    df = spark.createDataFrame([(float(i % 2), [float(i)]) for i in range(40)], "target double, x array<double>") \
        .withColumn("features", array_to_vector("x"))
    m = ml.refit(ml.gbt_leafwise(max_iter=3), df, {"maxDepth": 2.0, "stepSize": 0.1})
    assert m.getOrDefault("maxDepth") == 2


def test_coerce_flags_and_required_fields(spark):
    df = spark.createDataFrame([(True, "4096"), (False, "n/a")], "IsGamer boolean, TotalPhysicalRAMMB string")
    out = pl.coerce_flags(df, ["IsGamer", "TotalPhysicalRAMMB"]).collect()
    assert out[0]["IsGamer"] == 1 and out[0]["TotalPhysicalRAMMB"] == 4096.0 and out[1]["TotalPhysicalRAMMB"] is None
    fields = T.StructType([T.StructField("k", T.LongType())])
    req = spark.createDataFrame([(1, '{"instance": {"k": 1}}'), (2, '{"instance": {"z": 1}}'),
                                 (3, '{"instances": [{"k": 1}, {"k": 2}]}'), (4, '{"k": 5'), (5, '[1]')],
                                "request_id long, payload string")
    got = {r.request_id: r.error for r in pl.parse_requests(req, "payload", fields, required=("k",)).collect()}
    assert got == {1: None, 2: "missing field k", 3: None, 4: "invalid JSON", 5: "provide instance or instances"}


def test_cluster_conf_scales_partitions():
    from riskweave.session import cluster_conf
    small = cluster_conf(10 << 20, executors=2, cores_per_executor=4)
    big = cluster_conf(100 << 40, executors=1000, cores_per_executor=8)
    assert int(small["spark.sql.shuffle.partitions"]) == 16            # two waves of 8 cores
    assert int(big["spark.sql.shuffle.partitions"]) == (100 << 40) // (256 << 20) + 1
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"
