"""Logistic members over packed rows: the models that Spark ML fits, one pass a step for all folds."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from riskweave.operators import logistic
from riskweave.operators import models as ml


def table(spark, n=900, width=6, seed=1, k=3):
    """Sparse and dense vectors: numbers far from zero, a column of one value, flags and columns of zeros, with a fold."""
    rng = np.random.default_rng(seed)
    X = np.zeros((n, width))
    X[:, :5] = np.column_stack([1990 + rng.integers(0, 9, n), rng.normal(size=n) * 300, np.full(n, 0.1), rng.integers(0, 2, n), rng.integers(0, 40, n) == 0])
    y = (((X[:, 0] - 1994) / 2 + X[:, 1] / 200 + X[:, 3] + rng.normal(size=n)) > 0.5).astype(float)
    rows = [(i, i % k, float(y[i]), Vectors.sparse(width, [(j, v) for j, v in enumerate(X[i]) if v]) if i % 2 else Vectors.dense(X[i])) for i in range(n)]
    return spark.createDataFrame(rows, ["id", "fold", "target", "features"]).withColumn("fold", F.col("fold").cast("int"))


def member(**kw):
    return LogisticRegression(**{"regParam": 0.01, "maxIter": 50, "featuresCol": "features", "labelCol": "target", **kw})


@pytest.mark.parametrize("kw", [{}, {"maxIter": 3}, {"maxIter": 15}, {"standardization": False}, {"fitIntercept": False}, {"regParam": 0.0, "tol": 1e-9, "maxIter": 200}])
def test_same_models_as_spark_ml(spark, kw):
    df, est = table(spark).repartition(3), member(**kw)
    for f, own in enumerate(logistic.fit_folds(df, est, [0, 1, 2])):
        ref = est.fit(df.where(F.col("fold") != f))
        assert np.allclose(own.coefficients.toArray(), ref.coefficients.toArray(), rtol=1e-6, atol=1e-9) and np.isclose(own.intercept, ref.intercept, rtol=1e-6, atol=1e-9)
        assert own.coefficients[2] == 0.0 and own.numFeatures == 6 and own.numClasses == 2


def test_wide_rows_stay_sparse(spark):
    df = table(spark, width=400)
    own, ref = logistic.fit_folds(df, member(), [0])[0], member().fit(df.where("fold <> 0"))
    assert np.allclose(own.coefficients.toArray(), ref.coefficients.toArray(), rtol=1e-6, atol=1e-9)


def test_one_class_and_other_labels(spark):
    df = table(spark, n=60)
    for label in (0.0, 1.0):
        one = df.withColumn("target", F.when(F.col("fold") == 0, 1.0 - F.lit(label)).otherwise(F.lit(label)))
        own, ref = logistic.fit_folds(one, member(), [0])[0], member().fit(one.where("fold <> 0"))
        assert own.intercept == ref.intercept and not own.coefficients.toArray().any()
    three = df.withColumn("target", (F.col("id") % 3).cast("double"))
    assert logistic.fit_folds(three, member(), [0]) is None
    assert ml.train_oof(three, member(), 3).models[0].numClasses == 3            # left to Spark ML
    with pytest.raises(Exception, match="NaN or infinite"):
        logistic.fit_folds(df.select("id", "fold", "target").crossJoin(spark.createDataFrame([(Vectors.dense([float("nan"), 1.0]),)], ["features"])), member(), [0])


def test_other_settings_are_left_to_spark_ml():
    assert logistic.can_fit(member()) and not logistic.can_fit(member(elasticNetParam=0.5))
    assert not logistic.can_fit(member(weightCol="w")) and not logistic.can_fit(member(family="multinomial")) and not logistic.can_fit(lambda f: member())


def test_passes_and_rows_do_not_follow_the_folds(spark):
    """failed with a Spark ML fit per fold, each with its own copy of the rows and its own passes."""
    df, sc, jobs = table(spark), spark.sparkContext, []
    for k in (2, 6):
        sc.setJobGroup(f"logistic{k}", "")
        ml.train_oof(df.withColumn("fold", (F.col("id") % k).cast("int")), member(maxIter=8), k)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"logistic{k}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] > 0 and jobs[1] <= jobs[0] + 4


def test_average_computes_only_probabilities(spark):
    """failed with a column of raw scores per model, whose vectors were written and read again for each row."""
    df, models = table(spark), logistic.fit_folds(table(spark), member(), [0, 1, 2])
    avg = ml.fold_average(models, df)
    assert avg._jdf.queryExecution().optimizedPlan().toString().count("UDF(") == 2 * len(models)
    ref = [ml.positive_probability(m.transform(df)).orderBy("id").toPandas()["p"].to_numpy() for m in models]
    assert (avg.orderBy("id").toPandas()["p"].to_numpy() == (ref[0] + ref[1] + ref[2]) / 3.0).all()


def test_roles_read_the_rows_once(spark):
    """failed with a second pass for the categories."""
    from riskweave.operators.features import detect_roles
    seen = spark.sparkContext.accumulator(0)

    def counted(r):
        seen.add(1)
        return r
    rows = spark.sparkContext.parallelize([(i, f"a{i}", "xyz"[i % 3] if i % 7 else None) for i in range(50)], 2).map(counted)
    got = detect_roles(spark.createDataFrame(rows, "id long, name string, kind string"), ["id"], "target", [], 5)
    assert got["low_card"] == ["kind"] and got["high_card"] == ["name"] and got["categories"] == {"kind": ["__missing__", "x", "y", "z"]}
    assert got["distinct"] == {"name": 50, "kind": 4} and seen.value == 50


def test_written_table_is_not_copied(spark, tmp_path, monkeypatch):
    """failed where every fit kept a copy of the table it had just written."""
    from riskweave import views
    from riskweave.plans import training
    from tests.conftest import SF_SMALL
    views.telemetry(spark, SF_SMALL).write.parquet(f"{tmp_path}/t")
    t, held = spark.read.parquet(f"{tmp_path}/t"), []
    whole = training.t_spec().fit(t).state
    persist = type(t).persist
    monkeypatch.setattr(type(t), "persist", lambda df, *a: held.append(df.columns) or persist(df, *a))
    assert training.t_spec().fit(t, written=True).state == whole and held == [["c", "v"]]
