"""The pipeline's stages against their brute-force versions, each on its predecessor's rows."""

import collections

import numpy as np

import corpus_pipeline
from riskweave.llm import packing

from ..conftest import SF_SMALL
from .test_decontam import brute as leaks
from .test_ngram_join import brute as groups
from .test_sharding_packing import check_packing


def repeats(texts, length=200):
    seen = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        out.append(np.frombuffer(t, np.uint8)[~gone].tobytes().decode("utf-8", "ignore"))
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    # an edge row each: no text, no letters, no id, an empty text
    extra = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "123 456", "en", "s", 7), (None, docs.where("lang = 'en'").first().text + " the and of", "en", None, 9), (9003, "", None, "s", 0)], docs.schema)
    docs, after = docs.unionByName(extra), []
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF_SMALL)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
            rows = docs.collect()
            docs = spark.createDataFrame(rows, docs.schema)
            after.append((name, rows))
    start = spark.read.parquet(f"{SF_SMALL}/documents.parquet").count() + 4
    lang, near, suffix, clean = (rows for _, rows in after)
    key = lambda rows: collections.Counter((r.doc_id, r.text) for r in rows)
    assert not {9001, 9002, 9003} & {r.doc_id for r in lang} and len(lang) >= 0.95 * start - 4
    comp = groups([(r.doc_id, r.text) for r in lang if r.doc_id is not None], 5, 80, 100)
    keep = {d for d, _, least in comp if d == least} | {None}
    assert key(near) == key(r for r in lang if r.doc_id in keep)
    texts = repeats([r.text.encode() for r in near])
    assert key(suffix) == collections.Counter((r.doc_id, t) for r, t in zip(near, texts))
    bench = [tuple(r)[:2] for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    bad = {d for d, _ in leaks([(r.doc_id, r.text) for r in suffix if r.doc_id is not None], bench)}
    assert key(clean) == key(r for r in suffix if r.doc_id not in bad)
    check_packing(docs.collect(), [(r.doc_id, r.text, r.source) for r in clean], packing.CAPACITY)


def test_run_on_an_empty_table(spark, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
