"""Op 11 against a plain form that spells every feature."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

from riskweave.llm import resample as rs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, rank string, score string"


def plain_words(text):
    return WORD.findall("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or ""))


def plain_features(text, n):
    w = plain_words(text)
    return [" ".join(w[i:i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, n, buckets, least_words, percent, seed):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(of(f) for _, t in rows for f in plain_features(t, n))
    t = Counter(of(f) for x in target for f in plain_features(x, n))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (S + buckets) / ((s[k] + 1) * (T + buckets))))
    out = []
    for d, text in rows:
        f = plain_features(text, n)
        weight = sum(gain(of(x)) for x in f) // len(f) if f else 0
        h = int(sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(text))])
    able = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = i + 1
    return sorted(map(tuple, out), key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank", "n_words").collect()), key=str)


ROWS = [(1, "The quick BROWN fox, the quick é-dog 42"), (2, None), (3, ""), (4, "...!"), (None, "fox fox fox"), (5, "ÄÖ straße 中文 fox-brown\x00x"),
        (7, "alpha beta gamma delta"), (7, "alpha beta gamma delta"), (8, "brown fox")] + [(10 + i, " ".join(f"w{(i * j) % 17}" for j in range(i))) for i in range(60)]


def test_brute_force(spark):
    docs = spark.createDataFrame([(d, t, "a", "b") for d, t in ROWS], SCHEMA)
    target = ["a quick brown fox", None, "w3 w6 w9 w12"]
    tdf = spark.createDataFrame([(x,) for x in target], "text string")
    for n, buckets, least, percent in ((2, 10_000, 3, 25), (3, 50, 1, 90), (1, 7, 0, 100)):
        got = rs.resample(docs, tdf, n=n, buckets=buckets, least_words=least, percent=percent)
        assert result(got) == brute(ROWS, target, n, buckets, least, percent, 7)
    picked = rs.drawn_rows(docs, got)
    assert picked.columns == docs.columns and picked.count() == len(ROWS)


def test_segments(monkeypatch):
    text = " ".join(f"Wörd{i % 97}" for i in range(5000)).encode()
    whole = [x for _, found in rs.features(text, 3) for x in found]
    monkeypatch.setattr(rs, "SEGMENT", 50)
    parts = list(rs.features(text, 3))
    assert len(parts) > 100 and sum(w for w, _ in parts) == 5000
    assert Counter(whole) == Counter(x for _, found in parts for x in found) == Counter(zlib.crc32(f.encode()) for f in plain_features(text.decode(), 3))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(d, t, "", "") for d, t in ROWS], SCHEMA)
    assert rs.resample(none, some.select("text")).count() == 0
    got = rs.resample(some, none.select("text"), least_words=3)
    assert result(got) == brute(ROWS, [], 2, 10_000, 3, 25, 7)
