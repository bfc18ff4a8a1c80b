"""Hand-computed micro cases (4-6 rows) for the operators with edge semantics."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.functions import scoring as sc
from riskweave.functions.dates import age_days, parse_datetime
from riskweave.operators import ensemble as ens
from riskweave.operators import features as fx
from riskweave.operators import metrics
from riskweave.operators.folds import stratified_kfold
from riskweave.operators.target_encoding import TargetEncoding, target_encode_oof


def sk_auc(y, s):
    """Pairwise AUC with ties counting one half (brute force)."""
    pos = [a for a, t in zip(s, y) if t == 1]
    neg = [a for a, t in zip(s, y) if t == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_with_ties(spark):
    y = [1, 0, 1, 0, 1, 0, 0]
    s = [0.9, 0.9, 0.5, 0.5, 0.2, 0.1, 0.5]
    df = spark.createDataFrame(list(zip(y, s)), "target int, p double")
    got = metrics.roc_auc(df).first()["auc"]
    assert math.isclose(got, sk_auc(y, s), rel_tol=1e-12)
    neg = metrics.roc_auc(df.withColumn("p", -F.col("p"))).first()["auc"]
    assert math.isclose(neg, 1 - got, rel_tol=1e-12)


def test_confusion_strict_threshold(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.51), (0, 0.5), (0, 0.9)], "target int, p double")
    cells = {(r.actual, r.predicted): r.n for r in metrics.confusion(df).collect()}
    assert cells == {(0, 0): 1, (0, 1): 1, (1, 0): 1, (1, 1): 1}


def test_pr_curve_points(spark):
    df = spark.createDataFrame([(1, 0.8), (0, 0.8), (1, 0.3), (0, 0.1)], "target int, p double")
    pts = sorted((r.threshold if r.threshold is not None else -1, r.precision, r.recall)
                 for r in metrics.pr_curve(df).collect())
    assert pts == [(-1, 1.0, 0.0), (0.1, 0.5, 1.0), (0.3, 2 / 3, 1.0), (0.8, 0.5, 0.5)]


def test_stratified_fold_sizes_not_divisible(spark):
    rows = [(i, 1 if i % 3 == 0 else 0) for i in range(53)]
    df = spark.createDataFrame(rows, "id long, target int")
    f = stratified_kfold(df, "id", "target", k=5).groupBy("target", "fold").count().collect()
    for t in (0, 1):
        sizes = [r["count"] for r in f if r["target"] == t]
        assert max(sizes) - min(sizes) <= 1
    assert sum(r["count"] for r in f) == 53


def test_target_encoding_edge_keys(spark):
    # key 'solo' only in fold 0 -> its fold-0 rows get the global mean; NULL key -> global mean
    rows = [(1, "a", 0, 1), (2, "a", 1, 0), (3, "a", 2, 1), (4, "solo", 0, 1), (5, None, 1, 0), (6, "b", 2, 0)]
    df = spark.createDataFrame(rows, "id long, k string, fold int, target int")
    out = {r.id: r.enc for r in target_encode_oof(df, "k", "fold", smoothing=10.0).collect()}
    g = 3 / 6
    assert math.isclose(out[4], g)
    assert math.isclose(out[5], g)
    assert math.isclose(out[1], (10 * g + 0.5) / 11)          # other folds of 'a': 0, 1 -> 0.5
    enc = TargetEncoding.fit(df, "k", smoothing=10.0)
    t = spark.createDataFrame([(7, "unseen"), (8, None), (9, "a")], "id long, k string")
    got = {r.id: r.enc for r in enc.transform(t).collect()}
    assert math.isclose(got[7], g) and math.isclose(got[8], g)
    assert math.isclose(got[9], (10 * g + 2 / 3) / 11)


def test_one_hot_unseen_and_missing(spark):
    df = spark.createDataFrame([("x",), ("y",), (None,)], "c string")
    cats = fx.categories(df, ["c"])["c"]
    assert cats == ["__missing__", "x", "y"]
    t = spark.createDataFrame([("x",), ("zz",), (None,)], "c string")
    rows = t.select(*fx.one_hot_columns("c", cats)).collect()
    assert [sum(r) for r in rows] == [1.0, 0.0, 1.0]


def test_scale_constant_column(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "x double")
    med = fx.medians(df, ["x"])
    mom = fx.moments(df, ["x"], med)
    out = [r[0] for r in df.select(fx.scaled("x", med["x"], *mom["x"])).collect()]
    assert out == [0.0, 0.0, 0.0]


def test_median_even_count_and_all_missing(spark):
    df = spark.createDataFrame([(1.0, None), (4.0, None), (2.0, None), (10.0, None)], "x double, y double")
    med = fx.medians(df, ["x", "y"])
    assert med["x"] == 3.0 and med["y"] is None


def test_date_age_all_missing_and_times(spark):
    df = spark.createDataFrame([("2020-01-02 06:00:00",), ("bad",), ("2020-01-01 12:00:00",)], "d string")
    ts = parse_datetime(F.col("d"))
    out = [r[0] for r in df.select(age_days(ts, "2020-01-02 06:00:00")).collect()]
    assert out == [0, 999999, 0]                         # 18 hours is zero whole days
    assert [r[0] for r in df.select(age_days(ts, None)).collect()] == [999999] * 3


def test_risk_band_boundaries(spark):
    df = spark.createDataFrame([(0.75,), (0.7499,), (0.4,), (0.3999,)], "p double")
    assert [r[0] for r in df.select(sc.risk_band(F.col("p"))).collect()] == ["High", "Medium", "Medium", "Low"]


def test_blend_missing_member_raises(spark):
    a = spark.createDataFrame([(1, 0.2), (2, 0.4)], "id long, p double")
    b = spark.createDataFrame([(1, 0.6)], "id long, p double")
    from riskweave.operators.schema import submission_check
    chk = submission_check(b, a, "id").first()
    assert chk.n_missing == 1 and not chk.ok
    with pytest.raises(ValueError):
        ens.require_members(1, 2, "stacking")


def test_weights_normalise():
    w = ens.normalise({"a": 1.0, "b": 3.0})
    assert w == {"a": 0.25, "b": 0.75}
    assert ens.normalise({"a": 0.0, "b": 0.0}) == {"a": 0.5, "b": 0.5}


def test_tree_shap_brute_force_3_features(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    from riskweave.operators import treeshap as ts
    rng = np.random.default_rng(3)
    X = rng.normal(size=(300, 3))
    y = ((X[:, 0] - X[:, 1] * X[:, 2]) > 0).astype(float)
    df = spark.createDataFrame([(i, X[i].tolist(), float(y[i])) for i in range(300)],
                               "id long, x array<double>, label double").withColumn("features", array_to_vector("x"))
    m = GBTClassifier(maxIter=6, maxDepth=3, seed=2).fit(df)
    trees, fac = ts.read_trees(spark, m)
    for i in range(5):
        a = ts.shap_row(trees, fac, X[i], 3)
        b = ts.brute_force_shapley(trees, fac, X[i], 3)
        assert np.allclose(a, b, atol=1e-12)


def test_target_encoding_options(spark):
    rows = [(1, "a", 0, 1), (2, "a", 1, 0), (3, "a", 2, 1), (4, "b", 0, 0), (5, "b", 1, 0), (6, "b", 2, 1)]
    df = spark.createDataFrame(rows, "id long, k string, fold int, target int")
    # count weighted: (n * mean + s * prior) / (n + s) over the other folds, s = 2
    out = {r.id: r.enc for r in target_encode_oof(df, "k", "fold", smoothing=2.0, count_weighted=True).collect()}
    g = 3 / 6
    assert math.isclose(out[1], (2 * 0.5 + 2 * g) / (2 + 2))       # other folds of 'a': 0, 1
    # fold-safe prior: prior from rows outside the fold only
    out2 = {r.id: r.enc for r in target_encode_oof(df, "k", "fold", smoothing=10.0, fold_safe_prior=True).collect()}
    prior_f0 = (0 + 1 + 0 + 1) / 4                                  # rows of folds 1, 2
    assert math.isclose(out2[1], (10 * prior_f0 + 0.5) / 11)


def test_target_encoding_hot_key_split_is_exact(spark):
    # one key holds most rows; the split path must give the same encodings as the plain join
    rows = [(i, "hot" if i % 4 else f"k{i % 9}", i % 5, (i * 7) % 3 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k string, fold int, t boolean").selectExpr(
        "id", "k", "fold", "cast(t as int) as target")
    a = {r.id: r.enc for r in target_encode_oof(df, "k", "fold").collect()}
    b = {r.id: r.enc for r in target_encode_oof(df, "k", "fold", hot_key_rows=50).collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[i], b[i], rel_tol=1e-12) for i in a)


def test_attributions_are_written_in_zstd(spark, tmp_path):
    """F16: default files of the long table took half as much again."""
    from riskweave.sources.artifacts import load_attribution, save_attribution
    rows = spark.createDataFrame([(1, "a", 0, 0.5), (1, "b", 0, 0.25)], "id long, model string, feature_idx int, phi double")
    save_attribution(rows, str(tmp_path / "a"))
    assert list((tmp_path / "a").glob("model=*/*.parquet")) == list((tmp_path / "a").glob("model=*/*.zstd.parquet")) != []
    assert [tuple(r) for r in load_attribution(spark, str(tmp_path / "a"), "b").select("id", "phi").collect()] == [(1, 0.25)]


def test_requests_are_parsed_once(spark):
    """every use of a request's keys and elements parsed its text again."""
    import re

    from pyspark.sql import types as T

    from riskweave.sources.payloads import parse_requests
    fields = T.StructType([T.StructField("k", T.LongType())])
    texts = ['{"instance": {"k": 1}}', '{"instances": [{"k": 1}, {"k": 2}]}', '{"k": 5', "[1]", ' {"k": 3} ', "{'k': 1}", None, '{"instances": []}']
    df = spark.createDataFrame(list(enumerate(texts)), "request_id long, payload string")
    out = parse_requests(df.repartition(2), "payload", fields)
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert len(re.findall(r"json_?object_?keys", plan)) <= 1 and len(re.findall(r"from_?json|jsontostructs", plan)) <= 3, plan
    got = {r.request_id: (r.error, r.error is None and [i.k for i in r.instances]) for r in out.collect()}
    assert got == {0: (None, [1]), 1: (None, [1, 2]), 2: ("invalid JSON", False), 3: ("provide instance or instances", False), 4: (None, [3]),
                   5: ("invalid JSON", False), 6: ("invalid JSON", False), 7: ("provide instance or instances", False)}
