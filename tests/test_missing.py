"""NaN as missing, incomplete blends, strict request bodies, empty histogram bins, full string ranks."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import types as T

from riskweave.operators import ensemble as ens
from riskweave.operators import features as fx
from riskweave.operators import metrics
from riskweave.operators import profile as prof
from riskweave.operators import rank
from riskweave.plans.feature_spec import FeatureSpec
from riskweave.sources.payloads import parse_requests

NAN = float("nan")


def test_nan_is_missing_in_state_and_features(spark):
    df = spark.createDataFrame([(1, NAN, 0), (2, 1.0, 1), (3, 3.0, 0), (4, None, 1)], "id long, x double, target int")
    med = fx.medians(df, ["x"])
    assert med == {"x": 2.0} and fx.moments(df, ["x"], med)["x"] == (2.0, math.sqrt(0.5))
    m = FeatureSpec(id_cols=("id",), date_cols=()).fit(df)
    out = {r.id: r.x for r in m.transform(df, keep=("id",), wide=True).collect()}
    assert out[1] == out[4] == 0.0 and out[2] == pytest.approx(-math.sqrt(2))
    assert not math.isnan(sum(out.values()))


def test_nan_is_missing_in_profiles(spark):
    df = spark.createDataFrame([(NAN, 1.0), (None, 2.0), (5.0, 3.0)], "a double, b double")
    assert {r.column_name: r.n_missing for r in prof.null_counts(df).collect()} == {"a": 2, "b": 0}
    assert {r.column_name: round(r.fraction, 6) for r in prof.null_fraction(df).collect()} == {"a": 0.666667, "b": 0.0}
    assert {r.column_name: r.non_null for r in prof.table_info(df).collect()} == {"a": 1, "b": 3}


def test_histogram_has_all_bins(spark):
    rows = prof.histogram(spark.createDataFrame([(0.0,), (100.0,), (NAN,), (None,)], "x double"), "x", 50).orderBy("bin").collect()
    assert [r.bin for r in rows] == list(range(50)) and [r.n for r in rows] == [1] + [0] * 48 + [1]
    assert prof.histogram(spark.createDataFrame([(None,)], "x double"), "x").collect() == []
    assert [r.n for r in prof.histogram(spark.createDataFrame([(7.0,), (7.0,)], "x double"), "x", 3).orderBy("bin").collect()] == [2, 0, 0]


def test_blends_raise_when_a_member_lacks_an_id(spark):
    full = [(1, "m", 0.2), (2, "m", 0.4), (1, "n", 0.6), (2, "n", 0.8)]
    w = spark.createDataFrame([("m", 0.5), ("n", 0.5)], "model string, weight double")
    make = lambda rows: spark.createDataFrame(rows, "id long, model string, p double")
    assert {r.id: round(r.p, 9) for r in ens.blend_weighted(make(full), w).collect()} == {1: 0.4, 2: 0.6}
    for broken in (full[:3], [*full, (2, "n", 0.1)], [*full[:3], (2, "n", None)]):
        with pytest.raises(Exception, match="missing or repeated for id 2"):
            ens.blend_weighted(make(broken), w).collect()
    a = spark.createDataFrame([(1, 0.2), (2, 0.4)], "id long, p double")
    b = spark.createDataFrame([(1, 0.6)], "id long, p double")
    with pytest.raises(Exception, match="for id 2"):
        ens.blend_fixed({"a": a, "b": b}, {"a": 0.5, "b": 0.5}).collect()
    filled = ens.blend_fixed({"a": a, "b": b}, {"a": 0.5, "b": 0.5}, fill_missing=0.0)
    assert {r.id: round(r.p, 9) for r in filled.collect()} == {1: 0.4, 2: 0.2}


@pytest.mark.parametrize("body, ks, error", [
    ('{"instance": {"k": 1, "other": [1]}}', [1], None), ('{"instances": [{"k": 1}, {"k": null}]}', [1, None], None), (' {"k": 3} ', [3], None),
    ("{'instance': {'k': 1}}", None, "invalid JSON"), ('{"k": 1} garbage', None, "invalid JSON"), ('{"k": 1}, {"k": 2}', None, "invalid JSON"),
    ('{"k": 1', None, "invalid JSON"), ("", None, "invalid JSON"), (None, None, "invalid JSON"), ('[{"k": 1}]', None, "provide instance or instances"),
    ('"x"', None, "provide instance or instances"), ('{"instances": []}', None, "provide instance or instances"),
    ('{"instances": null}', None, "provide instance or instances"), ('{"instance": {"k": "abc"}}', None, "invalid instance"),
    ('{"instances": [1, 2]}', None, "invalid instance"), ('{"instance": null}', None, "invalid instance")])
def test_request_bodies(spark, body, ks, error):
    df = spark.createDataFrame([(body,)], "payload string")
    r = parse_requests(df, "payload", T.StructType([T.StructField("k", T.LongType())])).first()
    assert r.error == error and (error is not None or [x.k for x in r.instances] == ks)


def test_label_codes_use_the_whole_string(spark):
    names = [f"Customer#{i:09d}" for i in range(500)] + ["Customer", "z", ""]
    codes = fx.label_codes(spark.createDataFrame([(n,) for n in names for _ in range(2)], "c string"), "c")
    assert {r.c: r.code for r in codes.collect()} == {n: i for i, n in enumerate(sorted(names))}
    buckets = rank.range_buckets(spark.createDataFrame([(n,) for n in names], "c string"), "c").groupBy("_bucket").count()
    assert max(r["count"] for r in buckets.collect()) < 0.2 * len(names)


def test_auc_of_scores_outside_the_unit_interval(spark):
    rows = [(1, -3.0), (0, -7.5), (1, 0.5), (0, 0.5), (1, 9.0), (0, 1.5), (0, 1.0), (1, 1.0)]
    pairs = [(p > n) + 0.5 * (p == n) for a, p in rows if a for b, n in rows if not b]
    got = metrics.roc_auc(spark.createDataFrame(rows, "target int, p double")).first()["auc"]
    assert got == pytest.approx(sum(pairs) / len(pairs))


def test_categories_refuse_large_columns(spark):
    df = spark.range(50).selectExpr("cast(id as string) as c")
    with pytest.raises(ValueError, match="more than 20"):
        fx.categories(df, ["c"], limit=20)
