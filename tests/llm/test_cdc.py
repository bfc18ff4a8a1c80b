"""Op 8 against a plain form of the gear hash and of the removal rule."""

import collections
import random

import numpy as np

from riskweave.llm import cdc, queries

from ..conftest import SF_ORACLE


def plain_chunks(text: bytes):
    """The classic loop: one byte at a time, the hash of the last 16 bytes."""
    out, start, end = [], 0, len(text)
    between = lambda p: p == end or text[p] & 0xC0 != 0x80
    while start < end:
        at = start + cdc.MIN
        while at < min(end, start + cdc.MAX):
            h = 0
            for b in text[max(0, at - cdc.WINDOW):at]:
                h = (h * 2 + int(cdc.GEAR[b])) & 0xFFFFFFFF
            if (h & 0xFFFF) >> (16 - cdc.BITS) == 0 and between(at):
                break
            at += 1
        at = min(at, end)
        if at == start + cdc.MAX:
            while at > start + cdc.MIN and not between(at):
                at -= 1
        out.append((start, at))
        start = at
    return out


def brute(rows):
    where, ids = collections.Counter(), collections.defaultdict(list)
    chunks = []
    for d, t in rows:
        t = (t or "").encode()
        chunks.append([(t[a:b], a, b) for a, b in plain_chunks(t)])
        for x, _, _ in chunks[-1]:
            where[x] += 1
            if d is not None:
                ids[x].append(d)
    out = []
    for (d, t), own in zip(rows, chunks):
        seen, kept, shared, cut = set(), [], [0, 0], [0, 0]
        for x, a, b in own:
            again = where[x] > 1
            shared = [shared[0] + again, shared[1] + again * len(x)]
            first = min(ids[x], default=None)
            if again and (d != first or x in seen):
                cut = [cut[0] + 1, cut[1] + len(x)]
            else:
                kept.append(x)
            seen.add(x)
        out.append((d, len((t or "").encode()), *shared, *cut, None if t is None else b"".join(kept).decode()))
    return sorted(out, key=str)


def test_chunks_and_shift():
    rnd = random.Random(3)
    text = "".join(rnd.choice("etaoin éshrdlu中") for _ in range(5000)).encode()
    data = np.frombuffer(b"xyz" + text + b"a" * 900, np.uint8)
    got = cdc.chunk_ends(data, np.array([0, 3, 3, 3 + len(text), len(data)]))
    assert got[0] == [3] and got[1] == []
    assert [e - 3 for e in got[2]] == [b for _, b in plain_chunks(text)]
    assert [e - 3 - len(text) for e in got[3]] == [b for _, b in plain_chunks(b"a" * 900)]
    longer = text[:1000] + b"one inserted sentence" + text[1000:]
    a, b = ({t[x:y] for x, y in plain_chunks(t)} for t in (text, longer))
    assert len(a - b) <= 4


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted(((*r[:6], None) for r in brute(rows)), key=str)
    got = queries.QUERIES["op8_substring_dedup"](spark, SF_ORACLE)
    assert sorted(((r.doc_id, r.n_bytes, r.n_shared, r.shared_bytes, r.n_cut, r.n_removed, None) for r in got.collect()), key=str) == want


def test_edges(spark):
    rnd = random.Random(2)
    passage = "".join(rnd.choice("etaoin éshrdlu") for _ in range(400))
    rows = [(i, f"{rnd.random()} intro " + passage + f" tail {rnd.random()}") for i in range(20)] + [
        (30, None), (31, ""), (None, passage), (None, passage + " x"), (33, passage * 3), (33, passage * 3), (33, "version " + passage), (34, "é" * 700)]
    df = spark.createDataFrame([(d, t, 1, "q") for d, t in rows], "doc_id long, text string, n_bytes int, at string").repartition(3)
    assert sorted(map(tuple, cdc.dedup_chunks(df).collect()), key=str) == brute(rows)
    assert cdc.dedup_chunks(df.limit(0)).collect() == []
    assert all(r.n_removed > 200 for r in cdc.dedup_chunks(df).where("doc_id between 1 and 19").collect())
