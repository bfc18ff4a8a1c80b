"""Benchmark decontamination by SimHash windows of each item's size.

Texts are lower-cased words of letters and digits. Every benchmark item has a 64-bit SimHash of
its weighted word shingles. A document's windows of an item's word count are fingerprinted in the
same way wherever the document shares a shingle with an item (windows that share none cannot be
similar); a document of fewer words than the item is one window. A window's candidates are all items whose fingerprint is within ``RADIUS`` bits: the
fingerprint is cut into blocks, of which one must be within ``RADIUS // blocks`` bits of the
item's (pigeonhole), and each block's table lists the items by every value that near. Candidates
are verified by the exact weighted Jaccard similarity of the shingle multisets; a shingle's
weight is its number of bytes.

The benchmark is the query set: it is read in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm import common as c

SHINGLE, RADIUS, BLOCKS = 5, 20, 8
BLOCK_ITEMS, BLOCK_BYTES = 4_000, 8 << 20
U64 = np.uint64
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True


def words_of(data: np.ndarray, offsets: np.ndarray):
    """(hash, bytes, row) of every word of lower-cased rows."""
    if not len(data):
        e = np.empty(0, np.int64)
        return e.astype(U64), e, e
    clean = np.where(_WORD[data], data, np.uint8(32))
    start, end, row = c.word_spans(clean, offsets)
    return c.span_hash(c.prefix_hash(clean), start, end), end - start, row


def _sign_bits(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each hash."""
    return np.unpackbits(c.mix64(h + U64(0x2545F4914F6CDD1D)).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """64-bit fingerprints from bit sums."""
    return np.packbits(sums > 0, axis=1).view(U64).ravel()


class Items:
    """The items of one block: shingles, fingerprints and the multi-index over them."""

    def __init__(self, keys: list[int], texts: list[str]):
        data = [t.encode("utf-8", "replace") for t in texts]
        off = np.concatenate(([0], np.cumsum([len(b) for b in data])))
        h, size, row = words_of(np.frombuffer(b"".join(data), np.uint8), off)
        count = np.bincount(row, minlength=len(texts))
        first = np.concatenate(([0], np.cumsum(count)))
        self.keys, self.words = np.array(keys, np.int64), count
        self.bags, prints, gate = [], [], {}
        for i, n in enumerate(count.tolist()):
            k = min(SHINGLE, n)
            if not k:
                self.bags.append(({}, 0))
                prints.append(0)
                continue
            hs, ws = bag_of(h[first[i]:first[i + 1]], size[first[i]:first[i + 1]], k)
            bag: dict[int, list[int]] = {}
            for x, w in zip(hs.tolist(), ws.tolist()):
                bag.setdefault(x, [0, w])[0] += 1
            self.bags.append((bag, int(ws.sum())))
            prints.append(int(fingerprints((_sign_bits(hs) * ws[:, None]).sum(axis=0)[None])[0]))
            for x in bag:
                gate.setdefault(k, {}).setdefault(x, []).append(n)
        self.prints = np.array(prints, U64)
        # shingles by the number of their words: sorted hashes, and the window lengths to look at
        self.gates = {}
        for k, by in gate.items():
            known = np.array(sorted(by), U64)
            table = np.zeros(1 << 16, bool)
            table[(known & U64(0xFFFF)).astype(np.int64)] = True
            self.gates[k] = (known, [sorted(set(by[x])) for x in known.tolist()], table)
        # each block's values near an item's
        self.bits = [64 * (b + 1) // BLOCKS - 64 * b // BLOCKS for b in range(BLOCKS)]
        self.shift = [64 * b // BLOCKS for b in range(BLOCKS)]
        near = RADIUS // BLOCKS
        self.tables = []
        used = np.flatnonzero(count)
        for b in range(BLOCKS):
            masks = np.array([sum(1 << x for x in xs) for r in range(near + 1) for xs in combinations(range(self.bits[b]), r)], np.int64)
            own = self.block(self.prints[used], b)
            value = (own[:, None] ^ masks[None]).ravel()
            item = np.repeat(used, len(masks))
            order = np.argsort(value, kind="stable")
            self.tables.append((np.searchsorted(value[order], np.arange((1 << self.bits[b]) + 1)), item[order]))

    def block(self, prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> U64(self.shift[b])) & U64((1 << self.bits[b]) - 1)).astype(np.int64)

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (window, item, distance) with a Hamming distance of ``RADIUS`` or less."""
        found = []
        for b, (start, item) in enumerate(self.tables):
            v = self.block(prints, b)
            n = start[v + 1] - start[v]
            w = np.repeat(np.arange(len(prints)), n)
            at = np.repeat(start[v] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            found.append(w * len(self.keys) + item[at])
        pair = np.unique(np.concatenate(found))
        w, i = pair // len(self.keys), pair % len(self.keys)
        dist = np.bitwise_count(prints[w] ^ self.prints[i])
        ok = dist <= RADIUS
        return w[ok], i[ok], dist[ok]

    def similarity(self, hs: np.ndarray, ws: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of a window's shingle multiset with an item's."""
        bag, total = self.bags[item]
        both, left = 0, {}
        for x, w in zip(hs.tolist(), ws.tolist()):
            n = left.get(x)
            if n is None:
                n = bag[x][0] if x in bag else 0
            if n:
                both += w
                n -= 1
            left[x] = n
        whole = total + int(ws.sum()) - both
        return both / whole if whole else 0.0


def bag_of(h: np.ndarray, size: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, weight) of the k-word shingles of one run of words."""
    acc, weight = np.zeros(len(h) - k + 1, U64), np.zeros(len(h) - k + 1, np.int64)
    for j in range(k):
        acc = c.mix64(acc * U64(0x9E3779B97F4A7C15) + h[j:len(h) - k + 1 + j] + U64(k))
        weight += size[j:len(h) - k + 1 + j]
    return acc, weight


def matches(items: Items, h: np.ndarray, size: np.ndarray, threshold: float):
    """Best window of one document (its words' hashes and sizes) for each similar item:
    {item: (similarity, first word, words, distance)}."""
    best: dict[int, tuple] = {}
    for k, (known, lengths, table) in items.gates.items():
        if len(h) < k:
            continue
        hs, ws = bag_of(h, size, k)
        maybe = np.flatnonzero(table[(hs & U64(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(known, hs[maybe])
        ok = known[np.minimum(at, len(known) - 1)] == hs[maybe]
        hits, which = maybe[ok], at[ok]
        if not len(hits):
            continue
        by_length: dict[int, list[int]] = {}
        for p, g in zip(hits.tolist(), which.tolist()):
            for n in lengths[g]:
                by_length.setdefault(min(n, len(h)), []).append(p)   # a shorter document is one window
        for n, places in by_length.items():
            # windows of n words that hold a shared shingle, in runs of neighbouring starts
            lo = np.maximum(np.array(places) - (n - k), 0)
            hi = np.minimum(np.array(places), len(h) - n)
            last = -1
            for a, b in zip(lo.tolist(), hi.tolist()):
                a = max(a, last + 1)
                if a > b:
                    continue
                last = b
                m = n - k + 1                                 # shingles of a window
                part, weight = hs[a:b + m], ws[a:b + m]
                total = np.concatenate((np.zeros((1, 64), np.int64), np.cumsum(_sign_bits(part) * weight[:, None], axis=0)))
                w, item, dist = items.within(fingerprints(total[m:] - total[:-m]))
                for x, i, d in zip(w.tolist(), item.tolist(), dist.tolist()):
                    if items.words[i] < SHINGLE and min(SHINGLE, items.words[i]) != k or items.words[i] >= SHINGLE and k != SHINGLE:
                        continue
                    s = items.similarity(part[x:x + m], weight[x:x + m], i)
                    if s >= threshold and (i not in best or (s, -(a + x)) > (best[i][0], -best[i][1])):
                        best[i] = (s, a + x, n, d)
    return best


def _search(shared, threshold):
    def run(batches):
        items = shared.value
        gates = items.gates
        for batch in batches:
            ids, keys, rows = [], [], []
            for a, b, data, offsets in c.text_chunks(batch.column(1)):
                h, size, row = words_of(data, offsets)
                hit = np.zeros(b - a, bool)
                for k, (known, _, table) in gates.items():    # rows that share a shingle with an item
                    if len(h) < k:
                        continue
                    hs, _ = bag_of(h, size, k)
                    maybe = np.flatnonzero(table[(hs & U64(0xFFFF)).astype(np.int64)] & (row[:len(hs)] == row[k - 1:]))
                    at = np.searchsorted(known, hs[maybe])
                    hit[row[maybe[known[np.minimum(at, len(known) - 1)] == hs[maybe]]]] = True
                first = np.searchsorted(row, np.arange(b - a + 1))
                for i in np.flatnonzero(hit).tolist():
                    part = slice(first[i], first[i + 1])
                    for item, m in sorted(matches(items, h[part], size[part], threshold).items()):
                        ids.append(a + i)
                        keys.append(int(items.keys[item]))
                        rows.append(m)
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(keys, pa.int64()), pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["_id", "key", "similarity", "start_word", "n_words", "distance"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """A row per input row and benchmark item that a window of it repeats: ``id_col``, ``item_col``,
    ``similarity`` (weighted Jaccard, ``threshold`` or more), ``start_word``, ``n_words`` and
    ``distance`` (Hamming) of the best, first such window. A window has as many words as the item,
    or all of a document that has fewer.

    Items and texts that are null or without a word match nothing; items of equal text match
    alike; items shorter than a shingle match their whole word sequence; repeated rows each get
    their rows; other columns are not read; empty tables give no rows."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("_item"), F.lower(item_text_col).alias("_text")).where("_text is not null")
    items = c.stage(items.withColumn("key", F.xxhash64("_text")))
    texts = items.groupBy("key").agg(F.first("_text").alias("_text"))
    n, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {id_type}, key long, similarity double, start_word long, n_words long, distance long"
    rows = docs.select(F.col(id_col).alias("_id"), F.lower(text_col).alias("_text"))
    blocks, found = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES)), None
    for b in range(blocks):
        block = texts.where(F.pmod("key", F.lit(blocks)) == b).orderBy("key").collect()     # of bounded size
        shared = spark.sparkContext.broadcast(Items([r.key for r in block], [r["_text"] for r in block]))
        part = rows.mapInArrow(_search(shared, threshold), schema)
        part = c.stage(part) if blocks > 1 else part
        found = part if found is None else found.unionByName(part)
    return found.join(items.select("key", "_item"), "key").select(
        F.col("_id").alias(id_col), F.col("_item").alias(item_col), "similarity", "start_word", "n_words", "distance")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` without the rows whose id repeats a benchmark item; rows with a null id stay."""
    bad = contaminated(docs, benchmark, id_col, text_col, **kw).select(F.col(id_col).alias("_bad")).distinct()
    return docs.join(bad, docs[id_col] == F.col("_bad"), "left_anti")
