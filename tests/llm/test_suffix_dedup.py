"""Op 3 against a table of all 200-byte strings."""

import collections
import hashlib
import random

import numpy as np
import pytest

from riskweave.llm import queries, suffix_dedup

from ..conftest import SF_ORACLE, SF_SMALL


def brute(rows, length=200):
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter()
    for t in texts:
        seen.update(t[i:i + length] for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i] += 1
                gone[min(i + length, len(t))] -= 1
        gone = np.cumsum(gone)[:len(t)] > 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_query(spark):
    for sf in (SF_SMALL, SF_ORACLE):
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
        assert sorted(map(tuple, queries.QUERIES["op3_suffix_array_dedup"](spark, sf).collect()), key=str) == brute(rows)


def got(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_bytes int, kept string").repartition(3)
    return sorted((tuple(r)[:5] for r in suffix_dedup.remove_repeats(df, **kw).collect()), key=str)


def test_small_lengths_and_edges(spark):
    rnd = random.Random(6)
    text = lambda k: "".join(rnd.choice("ab é") for _ in range(k))
    common = text(90)
    rows = [(i, text(rnd.randrange(60)) + common[rnd.randrange(60):] + text(rnd.randrange(60))) for i in range(40)]
    rows += [(41, None), (42, ""), (43, "x" * 500), (None, "y" * 33), (None, common), (44, common), (44, common), (44, "other " * 9)]
    for length in (8, 20, 33):
        assert got(spark, rows, length=length) == brute(rows, length)
    assert got(spark, [], length=20) == []


@pytest.mark.parametrize("hot", [20_000, 3])
def test_one_large_passage_and_runs(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_BLOCKS", hot)
    rnd = random.Random(7)
    word = lambda k: "".join(rnd.choice("etaoinshrdlu ") for _ in range(k))
    passage = word(450)
    rows = [(i, word(rnd.randrange(300)) + passage + word(rnd.randrange(300))) for i in range(60)]
    rows += [(100, "z" * 100_000), (101, "z" * 150), (102, word(300) * 3)]
    assert got(spark, rows) == brute(rows)


def test_columns_and_kept_bytes(spark):
    df = spark.createDataFrame([(1, "ab" * 20, "en"), (2, "nothing", None), (3, None, "x")], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in suffix_dedup.remove_repeats(df, length=10, columns=["doc_id", "lang"]).collect()}
    assert (bytes(rows[1].kept), bytes(rows[2].kept), rows[3].kept, rows[1].lang) == (b"", b"nothing", None, "en")


def test_bytes_of_every_value():
    a = bytes(range(256)) * 2
    assert [x.tolist() for x in suffix_dedup.repeated_windows([a, b"none"], 10)] == [[i for i in range(503) if i <= 246 or i >= 256], []]


def test_queues_go_to_disk(spark, monkeypatch):
    """The whole operator with queues of 2,000 bytes, which all go through files."""
    rnd = random.Random(12)
    text = lambda k: "".join(rnd.choice("etaoin shrdlu") for _ in range(k))
    common = [text(300) for _ in range(3)]
    rows = [(i, text(rnd.randrange(90)) + rnd.choice(common)[rnd.randrange(80):] + text(rnd.randrange(90))) for i in range(60)]
    assert got(spark, rows, memory=2000) == brute(rows)
