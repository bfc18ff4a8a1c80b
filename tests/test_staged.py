"""AUC after each iteration, fits that wait for it, gain importance, vector summaries of attributions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorIndexer
from pyspark.sql import functions as F

from riskweave.operators import explain as xp
from riskweave.operators import metrics, staged
from riskweave.operators import models as ml
from riskweave.operators.treeshap import read_trees, tree_shap, tree_shap_wide
from tests.test_early_stopping import rows


def plain_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return float(np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)))


def gbt(n, **kw):
    return GBTClassifier(maxIter=n, **{"maxDepth": 3, "seed": 4, "featuresCol": "features", "labelCol": "target", **kw})


def test_staged_auc_is_that_of_every_shorter_model(spark):
    df, val = rows(spark), rows(spark, 300, seed=3)
    model = gbt(6).fit(df)
    got = {r["iter"]: r["auc"] for r in staged.staged_auc(val, model).collect()}
    assert sorted(got) == list(range(6))
    for i in range(6):
        part = ml.positive_probability(ml.truncated(model, i + 1).transform(val)).select("target", "p").toPandas()
        assert abs(got[i] - plain_auc(part.target.to_numpy(), part.p.to_numpy().round(12))) < 1e-9


def test_categorical_splits_and_missing_labels(spark):
    df = spark.range(400).select(F.col("id"), F.array((F.col("id") % 5).cast("double"), F.rand(3)).alias("x"),
                                 ((F.col("id") % 5).isin(1, 3) != (F.rand(5) < 0.2)).cast("double").alias("target"))
    from pyspark.ml.functions import array_to_vector
    df = df.withColumn("raw", array_to_vector("x"))
    df = VectorIndexer(inputCol="raw", outputCol="features", maxCategories=6).fit(df).transform(df)
    model = gbt(3).fit(df)
    assert any(c is not None for t in read_trees(spark, model)[0] for c in t.categories)
    last = staged.staged_auc(df, model).where("iter = 2").first()["auc"]
    p = ml.positive_probability(model.transform(df)).select("target", "p").toPandas()
    assert abs(last - plain_auc(p.target.to_numpy(), p.p.to_numpy().round(12))) < 1e-9
    some = df.withColumn("target", F.when(F.col("id") >= 100, F.col("target")))
    assert staged.staged_cells(some, model).where("iter = 0").agg(F.sum(F.col("pos") + F.col("neg"))).first()[0] == 300


def test_fit_patient_grows_until_the_rule_stops(spark):
    df, val = rows(spark), rows(spark, 200, seed=2)
    long = [r["auc"] for r in staged.staged_auc(val, gbt(24, maxDepth=4).fit(df)).orderBy("iter").collect()]
    keep, run = ml.best_prefix([-v for v in long], 3)
    model, aucs = staged.fit_patient(gbt(24, maxDepth=4), df, val, wait=3)
    assert model.getNumTrees == keep and np.allclose(aucs, long[:run])
    model, aucs = staged.fit_patient(gbt(2), df, val, wait=50)               # maxIter ends it
    assert len(aucs) == 2
    with pytest.raises(ValueError, match="both classes"):
        staged.fit_patient(gbt(2), df, val.where("target = 1"), wait=1)


def test_train_oof_waits_for_the_auc(spark):
    df = rows(spark).withColumn("fold", (F.col("id") % 3).cast("int"))
    out = ml.train_oof(df, gbt(8), 3, wait=2)
    assert out.oof.count() == 400
    best = {r["fold"]: r["best_iter"] for r in metrics.waiting_point(out.curves, 2, group_cols=["fold"]).collect()}
    assert [m.getNumTrees for m in out.models] == [best[f] + 1 for f in range(3)]
    out.release()


@pytest.mark.parametrize("values", [[5, 4, 3, 3.5, 3.6, 2], [5, 4, 3, 2], [1], [2, 2, 2, 2], [3, 4, 2, 5, 5, 5]])
@pytest.mark.parametrize("wait", [1, 2, 5])
def test_waiting_point_is_the_plain_rule(spark, values, wait):
    curve = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "iter int, loss double")
    got = metrics.waiting_point(curve, wait, value_col="loss", larger=False).first()
    keep, run = ml.best_prefix(values, wait)
    assert (got.best_iter, got.last_iter, got.best_loss, got.stopped) == (keep - 1, run - 1, values[keep - 1], run - keep >= wait)


def test_waiting_point_of_an_empty_curve(spark):
    empty = spark.createDataFrame([], "g string, iter int, auc double")
    assert metrics.waiting_point(empty, 2, group_cols=["g"]).count() == 0


def test_gain_importance_is_the_models_own(spark):
    models = [gbt(4, seed=s).fit(rows(spark, seed=s)) for s in (1, 2)]
    nodes = ml.node_table(spark, models)
    got = {r["feature_idx"]: r for r in ml.gain_importance(nodes, 2).collect()}
    gain = np.zeros(3)
    for r in nodes.collect():
        gain[r["feature_idx"]] += r["gain"] * r["cover"] / 2
    assert np.allclose([got[i]["gain"] for i in range(3)], gain) and abs(sum(r["share"] for r in got.values()) - 1) < 1e-9
    one = {r["feature_idx"]: r["share"] for r in ml.gain_importance(nodes.where("fold = 0"), 1).collect()}
    assert np.allclose([one.get(i, 0.0) for i in range(3)], models[0].featureImportances.toArray())


def test_mean_abs_of_wide_attributions(spark):
    df = rows(spark, 60)
    model = gbt(3).fit(df)
    long = {r["feature_idx"]: r["mean_abs"] for r in xp.mean_abs(tree_shap(df, model)).collect()}
    wide = {r["feature_idx"]: r["mean_abs"] for r in xp.mean_abs_wide(tree_shap_wide(df, model)).collect()}
    assert long.keys() == wide.keys() and all(abs(long[i] - wide[i]) < 1e-12 for i in long)


def test_leaf_values_are_tabled_once(spark, monkeypatch):
    """failed with values computed again for every batch; long paths, beyond the table, give the same."""
    from riskweave.operators import treeshap
    model = gbt(3).fit(rows(spark))
    trees, factor = read_trees(spark, model)
    X = np.random.default_rng(0).normal(size=(50, 3))
    calls, whole = [], treeshap.shap_batch(trees, factor, X, 3)
    ready = treeshap.tabled(trees, factor)
    monkeypatch.setattr(treeshap, "leaf_values", lambda *a, old=treeshap.leaf_values: (calls.append(1), old(*a))[1])
    assert np.array_equal(treeshap.shap_batch(trees, factor, X, 3, ready), whole) and not calls
    monkeypatch.setattr(treeshap, "TABLED", 0)
    assert np.allclose(treeshap.shap_batch(trees, factor, X, 3), whole, atol=1e-12) and calls
    assert np.allclose(whole[0], treeshap.brute_force_shapley(trees, factor, X[0], 3), atol=1e-9)
