"""Op 6: held-out accuracy, calibration, the contract's cases, and the plain form of the model."""

import zlib

import numpy as np

from riskweave.llm import langid, queries

from ..conftest import SF_ORACLE


def test_query(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op6_language_id"](spark, SF_ORACLE).collect()}
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "text", "lang").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert {d.doc_id for d in held} == {k for k, r in got.items() if r.held_out}
    right = [got[d.doc_id].lang_pred == d.lang for d in held]
    assert np.mean(right) > 0.97
    score = np.array([got[d.doc_id].score for d in held])
    assert ((0 <= score) & (score <= 1)).all() and abs(score.mean() - np.mean(right)) < 0.05


def test_logits_match_plain_sums():
    rnd = np.random.default_rng(1)
    model = langid.Model(["a", "b", "c"], rnd.random(langid.DIM), rnd.normal(size=(langid.DIM, 3)), rnd.normal(size=3))
    texts = ["Hello, Wörld! 42", "", "中文 and ÀÉ", "x", "  ", "Straße " * 50]
    blob = "".join(texts).encode()
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    z, some = model.logits(np.frombuffer(blob, np.uint8), off)
    assert some.tolist() == [True, False, True, True, False, True]
    for i, t in enumerate(texts):
        if some[i]:
            u, n = next(langid._vectors([t]))
            x = n * model.idf[u]
            np.testing.assert_allclose(z[i], langid.SCALE * (x @ model.weights[u]) / x.sum() + model.bias, rtol=1e-4, atol=1e-4)


def make(spark, rows):
    return spark.createDataFrame([(d, t, v, 0.5, "y") for d, t, v in rows], "doc_id long, text string, lang string, score double, lang_pred string")


def test_edges(spark):
    rows = [(i, f"the cat and the dog number {i}" if i % 2 else f"le chat et le chien numéro {i}", "en" if i % 2 else "fr") for i in range(200)]
    rows += [(500, None, "en"), (501, "", "fr"), (502, "123 !?", None), (None, "the the the", None), (503, "le " * 50_000, None), (503, "le " * 50_000, None)]
    docs = make(spark, rows)
    model = langid.fit_documents(docs)
    out = langid.predict(docs.select("doc_id", "text"), model).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and model.labels == ["en", "fr"]
    assert [(by[k].lang_pred, by[k].score) for k in (500, 501, 502)] == [("und", 0.0)] * 3
    assert by[503].lang_pred == "fr" and by[None].lang_pred == "en"
    assert langid.predict(docs.limit(0).select("doc_id", "text"), model).collect() == []


def test_nothing_to_learn_and_one_label(spark):
    docs = make(spark, [(1, "hello there", None), (2, None, "en")])
    assert [r.lang_pred for r in langid.predict(docs.select("doc_id", "text"), langid.fit(docs)).collect()] == ["und", "und"]
    one = langid.fit(make(spark, [(i, "hello there", "en") for i in range(9)]))
    assert [(r.lang_pred, r.score) for r in langid.predict(docs.select("doc_id", "text"), one).collect()] == [("en", 1.0), ("und", 0.0)]


def test_held_out_rows_are_not_learned(spark):
    rows = [(i, "alpha beta" if zlib.crc32(str(i).encode()) % 4 != 2 else "gamma delta", "known" if zlib.crc32(str(i).encode()) % 4 != 2 else "secret") for i in range(60)]
    assert langid.fit_documents(make(spark, rows)).labels == ["known"]


def test_copies_use_no_quota_and_all_texts_have_frequencies(spark):
    words = {"aa": "haus baum fluss stein", "bb": "house tree river stone", "cc": "casa albero fiume pietra", "dd": "maja puu jogi kivi"}
    tail = lambda i: "".join(chr(97 + int(x)) for x in str(i))
    rows = [(i, f"{t} {tail(i)}", k) for k, t in words.items() for i in range(100)] + [(i, "zzz yyy xxx", "aa") for i in range(20_000)]
    docs = make(spark, rows)
    model = langid.fit(docs, max_rows=200)
    out = langid.predict(docs.where("text like 'haus%'").select("doc_id", "text"), model).collect()
    assert len(out) == 100 and np.mean([r.lang_pred == "aa" and r.score >= 0.5 for r in out]) > 0.95
    seen = {t: next(langid._vectors([t]))[0] for t in {t for _, t, _ in rows}}
    df = np.zeros(langid.DIM)
    for _, t, _ in rows:
        df[seen[t]] += 1
    np.testing.assert_allclose(model.idf, np.where(df > 0, 1 + np.log((1 + len(rows)) / (1 + df)), 0))
