"""Early stopping by waiting rounds, truncated boosted models, fit inputs that do not depend on cores."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector

from riskweave.operators import models as ml


def rows(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, 3))
    y = ((X[:, 0] + 0.7 * rng.normal(size=n)) > 0).astype(float)
    return spark.createDataFrame([(i, X[i].tolist(), float(y[i])) for i in range(n)], "id long, x array<double>, target double") \
        .withColumn("features", array_to_vector("x"))


def test_best_prefix():
    assert ml.best_prefix([5, 4, 3, 3.5, 3.6, 2], 2) == (3, 5)       # stops before the later minimum
    assert ml.best_prefix([5, 4, 3, 2], 2) == (4, 4)
    assert ml.best_prefix([1], 5) == (1, 1)
    assert ml.best_prefix([2, 2, 2, 2], 2) == (1, 3)                 # an equal loss is no new least


def test_truncated_model_is_the_shorter_fit(spark):
    df = rows(spark)
    kw = dict(maxDepth=3, seed=5, featuresCol="features", labelCol="target")
    cut = ml.truncated(GBTClassifier(maxIter=6, **kw).fit(df), 3)
    short = GBTClassifier(maxIter=3, **kw).fit(df)
    a, b = (sorted((r.id, round(r.p, 12)) for r in ml.positive_probability(m.transform(df)).collect()) for m in (cut, short))
    assert cut.getNumTrees == 3 and a == b


def test_fit_early_stopped_keeps_the_least_validation_loss(spark):
    df = rows(spark)
    val = rows(spark, 200, seed=2)
    model, losses = ml.fit_early_stopped(GBTClassifier(maxIter=15, maxDepth=4, seed=1, featuresCol="features", labelCol="target"), df, val, wait=3)
    assert model.getNumTrees == 1 + min(range(len(losses)), key=lambda i: losses[i])
    assert abs(ml.staged_losses(model, val)[-1] - min(losses)) < 1e-9


def test_fit_input_does_not_depend_on_partitions(spark):
    df = rows(spark)
    a, b = (ml.fit_input(d.select("id", "target", "features"), id_col="id") for d in (df.repartition(3), df.repartition(11)))
    assert a.rdd.getNumPartitions() == b.rdd.getNumPartitions() == ml.FIT_PARTITIONS
    order = lambda d: d.select("id").rdd.glom().map(lambda p: [r.id for r in p]).collect()
    assert order(a) == order(b)
    a.unpersist(), b.unpersist()
