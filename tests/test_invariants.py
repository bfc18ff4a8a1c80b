"""Invariants over the supplied tables (sf0.001) and the two-level rank vs the plain window."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from riskweave import views
from riskweave.operators import explain as xp
from riskweave.operators import metrics
from riskweave.operators.rank import running_totals, running_totals_simple
from riskweave.plans.catalog import QUERIES, t_spec
from riskweave.plans.feature_spec import FeatureModel

from .conftest import SF_SMALL


def test_two_level_rank_equals_window(spark):
    p = views.preds(spark, SF_SMALL)
    a = running_totals(p, ["model"], ["p", "id"], ["target"]).select("model", "id", "cum_target")
    b = running_totals_simple(p, ["model"], ["p", "id"], ["target"]).select("model", "id", "cum_target")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_oof_each_id_once(spark):
    oof = QUERIES["oof_assembly"](spark, SF_SMALL)
    n = views.telemetry(spark, SF_SMALL).count()
    assert oof.count() == n and oof.select("id").distinct().count() == n


def test_scaled_mean_zero_std_one(spark):
    t = views.telemetry(spark, SF_SMALL)
    x = t_spec().fit(t).transform(t, keep=("id",), wide=True)
    row = x.agg(F.avg("amount"), F.stddev_pop("amount")).first()
    assert abs(row[0]) < 1e-9 and abs(row[1] - 1.0) < 1e-9


def test_weights_sum_to_one_and_blend_bounded(spark):
    p = views.preds(spark, SF_SMALL)
    w = ens_weights = None
    from riskweave.operators import ensemble as ens
    ens_weights = ens.auc_weights(p)
    w = ens_weights.agg(F.sum("weight")).first()[0]
    assert math.isclose(w, 1.0, rel_tol=1e-12)
    blend = ens.blend_weighted(p, ens_weights)
    bounds = p.groupBy("id").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    bad = blend.join(bounds, "id").where((F.col("p") < F.col("lo") - 1e-12) | (F.col("p") > F.col("hi") + 1e-12))
    assert bad.count() == 0


def test_linear_shap_additivity(spark):
    from riskweave.plans.catalog import ATTR_COLS, MEMBER_COEFS, attribution_matrix
    x = attribution_matrix(spark, SF_SMALL)
    means = xp.feature_means(x, ATTR_COLS)
    a = xp.linear_shap(x, ATTR_COLS, {"lgb": MEMBER_COEFS["lgb"]}, means=means)
    s = a.groupBy("id").agg(F.sum("phi").alias("s"))
    margin = x.select("id", sum(F.lit(c) * F.col(k) for c, k in zip(MEMBER_COEFS["lgb"], ATTR_COLS)).alias("m"))
    base = xp.base_value(ATTR_COLS, MEMBER_COEFS["lgb"], means)
    bad = s.join(margin, "id").where(F.abs(F.col("s") + F.lit(base) - F.col("m")) > 1e-9)
    assert bad.count() == 0


def test_single_row_transform_equals_batch(spark):
    t = views.telemetry(spark, SF_SMALL)
    fm = t_spec().fit(t)
    one_id = t.select(F.min("id")).first()[0]
    batch = fm.transform(t, keep=("id",)).where(F.col("id") == one_id).first()["features"]
    single = fm.transform(t.where(F.col("id") == one_id), keep=("id",)).first()["features"]
    assert batch == single                       # age uses fitted state, not the batch max


def test_save_load_identical_transform(spark, tmp_path):
    t = views.telemetry(spark, SF_SMALL)
    fm = t_spec().fit(t)
    path = str(tmp_path / "state")
    fm.save(spark, path)
    fm2 = FeatureModel.load(spark, path)
    a = fm.transform(t, keep=("id",)).select("id", F.col("features").cast("string").alias("f"))
    b = fm2.transform(t, keep=("id",)).select("id", F.col("features").cast("string").alias("f"))
    assert a.exceptAll(b).count() == 0
    assert fm.names() == fm2.names()


def test_stream_equals_batch(spark, tmp_path):
    from riskweave.plans.catalog import PAYLOAD_FIELDS, payload_model, payload_requests
    from riskweave.streaming.scoring import score_requests, start_scoring_stream
    fm, model = payload_model(spark, SF_SMALL)
    reqs = payload_requests(spark, SF_SMALL).withColumnRenamed("event_id", "request_id")
    batch, _ = score_requests(reqs, PAYLOAD_FIELDS, fm, model)
    root = str(tmp_path)
    reqs.select(F.to_json(F.struct("request_id", "payload")).alias("value")).write.text(f"{root}/src")
    q = start_scoring_stream(spark, f"{root}/src", f"{root}/sink", f"{root}/ck", PAYLOAD_FIELDS, fm, model)
    q.awaitTermination()
    stream = spark.read.parquet(f"{root}/sink/scored").select("request_id", "pos", "p", "band")
    b = batch.select("request_id", "pos", "p", "band")
    assert stream.exceptAll(b).count() == 0 and b.exceptAll(stream).count() == 0


def test_auc_matches_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    p = views.preds(spark, SF_SMALL).where(F.col("model") == "cat")
    ours = metrics.roc_auc(p).first()["auc"]
    ev = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="target", numBins=0)
    ref = ev.evaluate(p.withColumn("target", F.col("target").cast("double")))
    assert abs(ours - ref) < 1e-9


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() >= 0 and df.columns == ["band", "n", "mean_p"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_stack_matrix_groups_once(spark):
    """Members side by side with one exchange on the id; missing members are null, rows kept apart."""
    from riskweave.operators import ensemble as ens
    p = spark.createDataFrame([(1, "a", 0, 1, 0.25), (1, "b", 0, 1, 0.5), (2, "b", 1, 0, 0.75)], "id long, model string, fold int, target int, p double")
    wide = ens.stack_matrix(p, ["a", "b"])
    assert sorted(tuple(r) for r in wide.select("id", "fold", "target", "a", "b").collect()) == [(1, 0, 1, 0.25, 0.5), (2, 1, 0, None, 0.75)]
    assert wide._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_feature_partitions_follow_the_rows(spark, monkeypatch):
    """Vectors of a larger table lie in more partitions, whatever the shuffle partitions are."""
    from riskweave.operators import models as ml
    from riskweave.plans import training
    monkeypatch.setattr(ml, "FIT_BYTES", 1 << 16)
    fm, x = training.featurised(spark, "/root/testdata/sf0.001")
    rows = x.count()
    assert x.rdd.getNumPartitions() == ml.fit_partitions(rows, len(fm.names())) > 8
