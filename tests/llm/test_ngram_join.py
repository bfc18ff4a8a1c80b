"""Op 1 against brute force over all pairs."""

import random
import re

import pytest

from riskweave.llm import ngram_join, queries

from ..conftest import SF_SMALL, SF_ORACLE


def brute(rows, n=4, num=85, den=100):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * den >= num * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if least.get(r) is None else min(least[r], d) if d is not None else least[r]
    return sorted((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def got(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, key string")
    return sorted(map(tuple, ngram_join.jaccard_components(df, **kw).collect()))


@pytest.mark.parametrize("sf", [SF_SMALL, SF_ORACLE])
def test_query_matches_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op1_ngram_jaccard_join"](spark, sf).collect())) == brute(rows)


def test_near_copies_of_all_sizes(spark):
    rnd, rows = random.Random(5), []
    for size in (1, 2, 3, 4, 5, 6, 8, 12, 20, 35, 60, 150, 400):
        for _ in range(3):
            base = [f"w{rnd.randrange(300)}" for _ in range(size)]
            for edits in (0, 0, 1, 2, 3, max(1, size // 30)):
                t = list(base)
                for _ in range(edits):
                    t[rnd.randrange(len(t))] = f"W{rnd.randrange(300)}"
                rows.append((len(rows), " ".join(t[: len(t) - rnd.randrange(2)])))
    assert got(spark, rows) == brute(rows)


def test_common_passage_and_chain_of_copies(spark):
    rnd = random.Random(9)
    common = " ".join(f"c{i}" for i in range(60))
    rows = [(i, common + " " + " ".join(f"u{rnd.randrange(10**6)}" for _ in range(15))) for i in range(120)]
    text = [f"a{i}" for i in range(100)]
    for i in range(40):                                    # each like the next, the ends unlike
        text = text[1:] + [f"b{i}"]
        rows.append((1000 + i, " ".join(text)))
    assert got(spark, rows) == brute(rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (4, "one  TWO"), (5, "one two three"), (6, "É two"),
            (7, "é two"), (8, "x " * 5000), (9, "X\n" * 7000)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_null_ids_link(spark):
    base = [f"word{i}" for i in range(60)]
    near = base[:-1] + ["other"]
    rows = [(None, " ".join(base)), (1, " ".join(near)), (None, "some other text altogether here"), (None, None), (None, " ".join(base[:30])),
            (5, " ".join(base[:30])), (None, " ".join(["y"] * 3)), (None, " ".join(["y"] * 3))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in ngram_join.jaccard_components(df).collect()]
    assert sorted((d, x) for d, _, x in got if d is not None) == [(1, 1), (5, 5)]
    assert sorted((n, x) for d, n, x in got if d is None and x is not None) == [(27, 5), (57, 1)]


def test_many_copies_of_two_near_texts(spark):
    import time
    base = [f"word{i}" for i in range(200)]
    near = " ".join(base[:-1] + ["other"])
    df = spark.range(10_000).selectExpr("id AS doc_id", f"CASE WHEN id % 2 = 0 THEN '{' '.join(base)}' ELSE '{near}' END AS text")
    t0 = time.time()
    got = ngram_join.jaccard_components(df)
    assert got.where("component_id = 0").count() == 10_000
    assert time.time() - t0 < 60                                # not the square of the copies
