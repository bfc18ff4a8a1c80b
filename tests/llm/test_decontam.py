"""Op 2 against all windows of all documents, and the multi-index against all distances."""

import collections
import random
import re

import numpy as np

from riskweave.llm import decontam, queries

from ..conftest import SF_ORACLE, SF_SMALL

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def bag(words, k):
    return collections.Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def weighted(a, b):
    size = lambda s: sum(len(w.encode()) for w in s)
    both = sum(size(s) * n for s, n in (a & b).items())
    whole = sum(size(s) * n for s, n in (a | b).items())
    return both / whole if whole else 0.0


def brute(docs, items, threshold=.8):
    """Best window of each (document, item) by exact similarity alone, and those of equal rank."""
    out = {}
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        for i, x in items:
            q = WORD.findall((x or "").lower())
            k = min(5, len(q))
            if not k or not set(bag(q, k)) & set(bag(w, k)):
                continue
            best = max(((weighted(bag(w[s:s + len(q)], k), bag(q, k)), -s) for s in range(len(w) - len(q) + 1)), default=(0, 0))
            if best[0] >= threshold:
                out[d, i] = (round(best[0], 9), -best[1], len(q))
    return out


def got(df):
    return {(r[0], r[1]): (round(r.similarity, 9), r.start_word, r.n_words) for r in df.collect()}


def test_query(spark):
    for sf in (SF_SMALL, SF_ORACLE):
        read = lambda t: [tuple(r)[:2] for r in spark.read.parquet(f"{sf}/{t}.parquet").collect()]
        want = brute(read("documents"), read("benchmark"))
        assert want and got(queries.QUERIES["op2_benchmark_decontamination"](spark, sf)) == want


def test_multi_index_finds_all_within_the_radius():
    rnd = np.random.default_rng(3)
    words = ["".join(chr(97 + x) for x in rnd.integers(0, 26, 4)) for _ in range(400)]
    items = decontam.Items(list(range(150)), [" ".join(rnd.choice(words, 30)) for _ in range(150)])
    prints = np.concatenate([items.prints ^ np.uint64(sum(1 << int(b) for b in rnd.choice(64, k, replace=False))) for k in (0, 3, 17, 20, 21, 30)])
    w, i, d = items.within(prints)
    dist = np.bitwise_count(prints[:, None] ^ items.prints[None])
    assert set(zip(w.tolist(), i.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(dist <= decontam.RADIUS))))
    assert (d == dist[w, i]).all()


def test_edits_and_edges(spark, monkeypatch):
    rnd = random.Random(4)
    vocab = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(2000)]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, text(rnd.randrange(12, 60))) for i in range(30)] + [(50, None), (51, " . "), (52, "Tiny Text"), (53, "one"), (54, text(20)), (55, None)]
    items.append((56, items[34][1]))
    docs = []
    for i in range(30):
        w = items[i][1].split()
        if i % 3 == 1:
            w[rnd.randrange(len(w))] = "changed"
        if i % 3 == 2:
            w.insert(rnd.randrange(len(w)), "added")
        docs.append((i, f"{text(40)}. {'; '.join(w).upper()} -- {text(33)}"))
    docs += [(100, None), (101, ""), (102, "a TINY, text"), (102, "a TINY, text"), (None, items[0][1]), (103, items[3][1][:40]), (104, (items[34][1] + " ") * 3), (105, text(30_000))]
    make = lambda rows, *c: spark.createDataFrame([(*r, 1, "x") for r in rows], f"{c[0]} long, text string, key int, similarity string")
    d, b = make(docs, "doc_id").repartition(3), make(items, "item_id")
    want = brute([x for x in docs if x[0] is not None], items) | {(None, 0): (1.0, 0, len(items[0][1].split()))}
    out = decontam.contaminated(d, b)
    assert got(out) == want and out.where("doc_id = 102").count() == 2
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 7)
    assert got(decontam.contaminated(d, b)) == want
    assert decontam.contaminated(d.limit(0), b).count() == 0 and decontam.contaminated(d, b.limit(0)).count() == 0
    kept = {r.doc_id for r in decontam.decontaminate(d, b).collect()}
    assert kept == {x for x, _ in docs if x is None or not any(k == x for k, _ in want)}


def test_documents_shorter_than_an_item(spark):
    rnd = random.Random(9)
    vocab = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(2000)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(n))) for i, n in enumerate((38, 59, 15, 6, 38))] + [(9, "two words")]
    cut = lambda i, a, b: " ".join(items[i][1].split()[a:b])
    docs = [(0, cut(0, 0, -1)), (1, cut(0, 1, None)), (2, cut(1, 2, -3)), (3, cut(2, 0, -1)), (4, cut(0, 0, 20)), (5, cut(3, 0, 4)), (6, "two"),
            (7, cut(1, 0, 30) + " " + cut(1, 31, None)), (8, cut(4, 0, -1) + " other"), (9, cut(3, 0, -1))]
    want = {}
    for d, t in docs:
        for i, x in items:
            w, q = t.split(), x.split()
            k, n = min(5, len(q)), min(len(w), len(q))
            s, at = max(((weighted(bag(w[a:a + n], k), bag(q, k)), -a) for a in range(len(w) - n + 1)), default=(0, 0))
            if s >= .8:
                want[d, i] = (round(s, 9), -at, n)
    assert {(0, 0), (1, 0), (3, 2), (8, 4)} <= set(want) and not {d for d, _ in want} & {4, 5, 6}
    make = lambda rows, *c: spark.createDataFrame(rows, f"{c[0]} long, text string")
    assert got(decontam.contaminated(make(docs, "doc_id"), make(items, "item_id"))) == want
