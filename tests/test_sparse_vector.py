"""The sparse feature vector against the plain dense form, and its size at full hashing width."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from riskweave.operators import features as fx
from riskweave.plans.feature_spec import FeatureSpec

COLS = [f"c{i}" for i in range(20)]


def frame(spark, n=300):
    rows = [(i, float(i % 7) if i % 11 else None, None if i % 13 == 0 else f"k{i % 3}", i % 2,
             *[None if (i + j) % 17 == 0 else f"v{(i * (j + 2)) % 61}" for j in range(20)]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, x double, kind string, target int, " + ", ".join(f"{c} string" for c in COLS)), rows


def test_vector_equals_wide_columns(spark):
    df, rows = frame(spark)
    m = FeatureSpec(n_hash_features=32, id_cols=("id",), date_cols=()).fit(df)
    names = m.names()
    wide = {r["id"]: [r[c] for c in names] for r in m.transform(df, keep=("id",), wide=True).collect()}
    got = {r["id"]: r["features"] for r in m.transform(df, keep=("id",)).collect()}
    assert all(list(got[i].toArray()) == wide[i] for i in wide) and len(got) == len(rows)
    assert all(v != 0 for x in got.values() for v in x.values)
    at = names.index("hash_0")
    for r in rows:                                              # the hashing rule, spelled out
        want = [0.0] * 32
        for c, v in zip(COLS, r[4:]):
            h = hashlib.md5(f"{c}={'__missing__' if v is None else v}".encode()).hexdigest()
            want[int(h[:8], 16) % 32] += 1.0 if int(h[8], 16) % 2 == 0 else -1.0
        assert wide[r[0]][at:] == want


def test_entries_are_sorted_and_small(spark):
    df, rows = frame(spark)
    m = FeatureSpec(n_hash_features=256, id_cols=("id",), date_cols=()).fit(df)
    for r in m.entries(df, keep=("id",)).collect():
        idx = [e["idx"] for e in r["entries"]]
        assert idx == sorted(set(idx)) and len(idx) <= 2 + 20
    plan = m.transform(df, keep=("id",))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5") <= 2 * len(COLS)                   # no expression per bucket


def test_unseen_missing_and_absent_columns(spark):
    df, _ = frame(spark)
    m = FeatureSpec(n_hash_features=8, id_cols=("id",), date_cols=()).fit(df)
    odd = spark.createDataFrame([(1, None, "never seen"), (2, 3.0, None)], "id long, x double, kind string")
    a, b = m.transform(odd, keep=("id",)).orderBy("id").collect()
    kinds = [i for i, r in enumerate(m.lineage_rows()) if r[2] == "onehot"]
    assert [a["features"][i] for i in kinds] == [0.0] * len(kinds)
    assert sum(b["features"][i] for i in kinds) == 1.0


def test_no_features_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0)], "id long, target int")
    m = FeatureSpec(id_cols=("id",), date_cols=()).fit(df)
    assert m.transform(df, keep=("id",)).first()["features"].size == 0
    some, _ = frame(spark)
    assert FeatureSpec(id_cols=("id",), date_cols=()).fit(some).transform(some.limit(0)).count() == 0


def test_signed_sums_cancel(spark):
    pairs = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(s).alias("sign")) for b, s in ((3, 1.0), (1, 1.0), (3, -1.0), (1, 1.0), (0, -1.0))])
    got = spark.range(1).select(fx.signed_sums(pairs).alias("e")).first()["e"]
    assert [(e["bucket"], e["value"]) for e in got] == [(0, -1.0), (1, 2.0)]


def test_vectors_come_from_batches(spark):
    """No hash, lambda or JSON text per row in the plan; pairs follow the column rule, odd values too."""
    from riskweave.functions.hashing import hash_bucket, hash_sign, token
    df, _ = frame(spark)
    m = FeatureSpec(n_hash_features=256, id_cols=("id",), date_cols=()).fit(df)
    plan = m.transform(df, keep=("id",))._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("md5(", "from_json", "lambdafunction")) and "ArrowEvalPython" in plan
    odd = spark.createDataFrame([(1, "é=中"), (2, ""), (3, None), (4, "v" * 3000)], "id long, c string")
    t = token("c", F.col("c"))
    rows = odd.select(fx.hash_pairs(["c"], 97).alias("p"), hash_bucket(t, 97).alias("b"), hash_sign(t).alias("s")).collect()
    assert all([tuple(x) for x in r["p"]] == [(r["b"], r["s"])] for r in rows) and len(rows) == 4
