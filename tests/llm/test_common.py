"""Shared helpers: components, word and shingle hashing, text buffers."""

import random
import re

import numpy as np
import pyarrow as pa

from riskweave.llm import common as c

from ..conftest import SF_SMALL


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(150)] + [(5000, 6000 + i) for i in range(100)] + [(7, 7)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in c.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(find(n) == r for n, r in got.items())
    assert set(got) == {n for e in edges for n in e if find(n) != n}
    assert c.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_words_and_shingles_do_not_depend_on_place():
    texts = ["one two  three\tfour five", "", " ", "two three four", "x", "one two three four five", "é z two\nthree four"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    words, row = c.word_hashes(data, off)
    plain = [(w, i) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    assert row.tolist() == [i for _, i in plain]
    ids = {}
    assert [ids.setdefault(w, h) for (w, _), h in zip(plain, words.tolist())] == words.tolist() and len(set(ids.values())) == len(ids)
    h, r, at = c.shingles(words, row, len(texts), 3)
    want = []
    for i in range(len(texts)):
        w = [x for x, k in plain if k == i]
        want += [(i, tuple(w[j:j + 3])) for j in range(len(w) - 2)] or ([(i, tuple(w))] if w else [])
    assert r.tolist() == [i for i, _ in want]
    names = {}
    assert [names.setdefault(s, x) for (_, s), x in zip(want, h.tolist())] == h.tolist() and len(set(names.values())) == len(names)


def test_text_chunks_of_sliced_arrays_with_nulls():
    col = pa.array(["skip", "ab", None, "", "éé", "x" * 50, None, "end"]).slice(1)
    out = []
    for a, b, data, off in c.text_chunks(col, limit=5):
        out += [data[off[i]:off[i + 1]].tobytes().decode() for i in range(b - a)]
    assert out == ["ab", "", "", "éé", "x" * 50, "", "end"]


def test_staged_tables_go_when_discarded(spark):
    import os
    kept, gone = (c.stage(spark.range(n)) for n in (3, 4))
    paths = [df.inputFiles()[0].replace("file://", "") for df in (kept, gone)]
    c.discard(gone)
    assert [os.path.exists(p) for p in paths] == [True, False] and kept.count() == 3
    c.discard(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))          # no staged table: stays
    assert os.path.exists(f"{SF_SMALL}/documents.parquet")


def test_shuffles_of_a_staged_table_are_released(spark):
    """failed while the last query, held by Spark's listeners, kept its shuffle through the next stage."""
    import time
    shuffles = lambda: {k for k in spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().keys().mkString(",").split(",") if k}
    before = shuffles()
    c.stage(spark.range(1000).repartition(7, "id"))
    for _ in range(20):
        left = shuffles() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left


def test_texts_of_nodes_are_dealt_once(spark, monkeypatch):
    """failed with a second shuffle of the texts, by node."""
    from riskweave.llm import ngram_join
    monkeypatch.setattr(c, "stage", lambda df, old=c.stage: (plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString())), old(df))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    plans = []
    try:
        ngram_join.jaccard_components(spark.read.parquet(f"{SF_SMALL}/documents.parquet")).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = next(p for cols, p in plans if cols == ["node", "_text"])
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert dealt and not any("hashpartitioning(node" in x and x.index("Exchange") < 12 for x in dealt)
