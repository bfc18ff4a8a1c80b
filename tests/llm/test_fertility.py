"""Op 4: measures against plain Python, and the verdict on clean and broken texts."""

import collections
import math
import random
import re

import public_tokenizers
import pytest
import sentencepiece

from riskweave.llm import fertility, queries

from ..conftest import SF_ORACLE

PATH = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    at = collections.defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i:i + 5])].append(i)
    repeat = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in text or ""), len(lines) - len(set(lines)), len(repeat))


def tokens(sp, text):
    ids = [i for x in sp.encode(WORD.findall(text or "")) for i in x]
    n = len(ids)
    bits = -sum(v / n * math.log2(v / n) for v in collections.Counter(ids).values()) if n else 0.0
    return n, sum(sp.is_byte(i) for i in ids) / max(n, 1), bits / math.log2(max(2, min(n, sp.get_piece_size())))


def test_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_ORACLE}/documents.parquet").collect()}
    out = {r.doc_id: r for r in queries.QUERIES["op4_fertility_rules"](spark, SF_ORACLE).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert set(out) == set(docs)
    for k, r in out.items():
        want = plain(docs[k].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)
        n, share, bits = tokens(sp, docs[k].text)
        assert r.n_tokens == n and r.byte_share == pytest.approx(share) and r.entropy == pytest.approx(bits)
    good = {r.doc_id for r in spark.read.parquet(f"{SF_ORACLE}/labels.parquet").where("quality = 1").collect()}
    passed = [out[k].kept for k in good if not out[k].base_failed]
    assert sum(passed) >= 0.99 * len(passed)
    noisy = [r for k, r in out.items() if not r.base_failed and r.n_symbols > 2 * r.n_words and r.n_words > 40]
    assert noisy and sum(not r.kept for r in noisy) >= 0.9 * len(noisy)


def test_edges(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice("the of and language model water house tree people".split()) + rnd.choice(["", "s", "ing"]) for _ in range(60)), "en") for i in range(80)]
    rows += [(100, None, "en"), (101, "", None), (102, "\n \n\n", "en"), (103, "a b\na b\n a b\n\nc", "en"), (104, "word " * 3000, "en"),
             (105, " ".join(chr(0x10300 + rnd.randrange(30)) * 4 for _ in range(60)), "en"), (106, " ".join("zqxjkvw"[rnd.randrange(7):] + "#*" * 9 for _ in range(60)), "en"),
             (None, rows[0][1], "en"), (107, " ".join(f"слово{i} дом" for i in range(30)), None)]
    df = spark.createDataFrame([(d, t, v, 1, "k") for d, t, v in rows], "doc_id long, text string, lang string, n_words int, key string").repartition(3)
    out = fertility.judge(df, PATH, columns=["doc_id", "key"])
    got = {r[0]: r for r in out.collect()}
    assert out.columns.count("key") == 2 and len(got) == len(rows)
    for d, t, _ in rows:
        assert tuple(got[d][3:8]) == plain(t), d
    assert all(got[d][-1] for d in [*range(80), None, 107]) and not any(got[d][-1] for d in (100, 101, 102, 103, 104, 105))
    assert fertility.judge(df.limit(0), PATH).collect() == []


def test_short_texts_are_judged(spark):
    rnd = random.Random(2)
    words = "the of and language model water house tree people under river light stone paper green early".split()
    clean = lambda n: " ".join(rnd.choice(words) + rnd.choice(["", "s", "ing"]) for _ in range(n))
    rows = [(i, clean(rnd.choice([12, 20, 40, 80, 300])), "en") for i in range(200)]
    rows += [(1000 + n, " ".join("".join(rnd.choice("#*$%&|<>{}[]^~") for _ in range(14)) for _ in range(n)), "en") for n in (11, 14, 18)]
    got = {r.doc_id: r for r in fertility.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PATH).collect()}
    junk = [got[d] for d in got if d >= 1000]
    assert not any(r.base_failed or r.kept for r in junk) and min(r.n_tokens for r in junk) < 150
    assert sum(got[d].kept for d in range(200)) >= 0.99 * sum(not got[d].base_failed for d in range(200))


def test_rare_languages_have_fences(spark):
    rnd = random.Random(3)
    words = "the of and language model water house tree people under river light stone paper green early".split()
    clean = lambda n: " ".join(rnd.choice(words) + rnd.choice(["", "s", "ing"]) for _ in range(n))
    junk = " ".join("".join(rnd.choice("bcdfgxzqjkvw#*$%&") for _ in range(12)) for _ in range(200))
    rows = [(i, clean(200), "en") for i in range(120)] + [(200 + i, clean(200), "xx") for i in range(9)] + [(300, junk, "xx")]
    got = {r.doc_id: r for r in fertility.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PATH).collect()}
    assert not got[300].base_failed and not got[300].kept
    assert all(r.kept for d, r in got.items() if d < 300 and not r.base_failed)
