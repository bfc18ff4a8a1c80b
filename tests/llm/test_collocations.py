"""Op 13 against a plain count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from riskweave.llm import collocations as cl
from riskweave.llm import common as c


def pieces(text):
    low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, least, top):
    by_lang = defaultdict(Counter)
    for text, lang in rows:
        f = by_lang["und" if lang is None else lang]
        for w in pieces(text):
            for m in range(1, 5):
                f.update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in by_lang.items():
        n = sum(v for k, v in f.items() if len(k) == 1)
        cand = {k: v for k, v in f.items() if len(k) > 1 and v >= least}
        drop = {k[i:i + m] for k, v in cand.items() for m in range(2, len(k)) for i in range(len(k) - m + 1) if 100 * v >= 80 * cand[k[i:i + m]]}
        rows_ = []
        for k, a in cand.items():
            if k not in drop:
                score, cut = min((2000000 * a // (f[k[:i]] + f[k[i:]]), i) for i in range(1, len(k)))
                rows_.append((-score, -a, " ".join(k).encode(), f[k[:cut]], f[k[cut:]]))
        for i, (s, a, p, l, r) in enumerate(sorted(rows_)[:top]):
            out.append((lang, i + 1, p.decode(), -a, l, r, n, -s))
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def some_rows(seed=1, n=150):
    rnd = random.Random(seed)
    words = ["New", "york", "é", "中文", "a-b", "(x)", "tokyo", "it's"] + [f"w{i}" for i in range(20)]
    text = lambda k: "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0b", "\xa0"]) for _ in range(k))
    rows = [(text(rnd.randrange(40)), rnd.choice(["en", "de", None, "und"])) for _ in range(n)]
    rows += [("one passage that very many texts repeat", "en")] * 300          # a heavy prefix
    rows += [(None, "en"), ("", None), (" \t\n", "fr"), ("!!", "fr"), (". x y", "de"), ("New York New York", "en")]
    return rows + [(text(3000) + ", ".join(["x" * 50] * 30) + " " * 200 + "y " * 300, "long")]


@pytest.mark.parametrize("limit,group", [(1 << 21, 1 << 20), (64, 64)])
def test_brute_force(spark, monkeypatch, limit, group):
    monkeypatch.setattr(cl, "GROUP", group)                                     # many groups, extended prefixes
    monkeypatch.setattr(cl, "HEAVY", group // 8)
    if limit == 64:
        plain = cl.word_table, cl.pair_table, cl.suffix_windows
        monkeypatch.setattr(cl, "word_table", lambda *a: plain[0](*a, limit))
        monkeypatch.setattr(cl, "pair_table", lambda *a: plain[1](*a, limit))
        monkeypatch.setattr(cl, "suffix_windows", lambda *a: plain[2](*a, limit))
    rows = some_rows()
    docs = spark.createDataFrame([(i, t, x, "a", "b") for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n string")
    for least, top in ((3, 2000), (2, 5)):
        assert result(cl.collocations(docs, least=least, top=top)) == brute(rows, least, top)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert cl.collocations(none).count() == 0
    rare = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    assert cl.collocations(rare).count() == 0


def test_parts_keep_words():
    rows = some_rows(seed=4, n=20)
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows]), pa.array([x or "und" for _, x in rows])], ["text", "lang"])
    for limit in (7, 100, c.CHUNK_BYTES):
        found = Counter()
        for w, data, langs, first, _ in cl._words([batch], limit):
            found.update((langs[first + r], data[a:b].tobytes().decode()) for a, b, r in zip(w.start, w.end, w.row))
        assert found == Counter(("und" if x is None else x, word) for t, x in rows for p in pieces(t) for word in p)


def test_bitmap_never_says_no(spark):
    h = np.arange(1, 3000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    df = spark.createDataFrame([(int(x),) for x in h.view(np.int64)], "h long")
    bits = cl.bitmap(df, "h", len(h))
    assert cl.has(bits, h).all() and cl.has(bits, c.mix64(h)).mean() < 0.1
