"""Phrase collocation mining by vertical partitioning of the word suffixes.

Every word of a text starts a suffix, truncated to ``DEPTH`` words and to its piece (texts are split
into pieces at punctuation and line ends). The counts of all phrases are those of the nodes of the
truncated suffix tree, which is never built as a whole:

1. One-word prefixes are counted (``word_table``); what begins with a rare word is left out.
2. Two-word prefixes of frequent words are counted; rare ones are left out again.
3. Prefixes are dealt into groups so that a group's suffixes fit a memory budget (``GROUP``). A
   prefix too heavy for a group is extended to whole truncated suffixes, which are dealt singly.
4. Each group's suffixes are sorted, which lays out its subtree, and every node's count is the sum
   of the leaves below it. The shares of an extended prefix are added up afterwards.

Words are known by 64-bit hashes of (language, word) until the end, and windows are combined within
a task by a 64-bit hash, so wrong counts need a collision. "Is this word (pair) frequent" is asked of
a bitmap of at most 2**28 bits: a false yes only carries rows that the exact counts drop later.
Texts are read in parts of a few megabytes, cut between words, the last words carried over.

Cases: a null text has no words; a null language counts as ``und``. Equal rows count each. Empty
tables give no rows. Columns but the text and language are not read. A piece may be of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm import common as c

DEPTH = 4
#: Suffixes of a group (about 50 bytes each), and windows that a task combines at once.
GROUP, HELD = 1 << 20, 1 << 20
#: Prefixes beyond this share of a group are extended.
HEAVY = GROUP // 8
#: Bits of a bitmap: at least this many per entry, and at most so many in all.
BITS_PER_ENTRY, MAX_BITS = 32, 1 << 28
UND = "und"

_KIND = np.zeros(256, np.uint8)                      # 1 parts words, 2 parts pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
U = c.U64


def _parts(col, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(first row, lower-cased bytes, offsets, goes on): runs of whole rows, or one longer text in
    parts that end at a separator."""
    for first, _, data, offsets in c.text_chunks(col, limit):
        data = c.lower_ascii(data)
        if len(data) <= limit:
            yield first, data, offsets, False
            continue
        for row in range(len(offsets) - 1):
            at, end = int(offsets[row]), int(offsets[row + 1])
            while True:
                cut = min(at + limit, end)
                while cut < end:
                    seps = np.flatnonzero(_KIND[data[cut:cut + limit]])
                    cut = cut + int(seps[0]) if len(seps) else min(cut + limit, end)
                    if len(seps):
                        break
                yield first + row, data[at:cut], np.array([0, cut - at]), cut < end
                at = cut
                if at >= end:
                    break


class Words:
    """The words of a part, with the last words of the part before where its text goes on:
    ``h`` hashes, ``gap`` (a piece ends before the word), ``new`` (number of carried words)."""

    def __init__(self, data, offsets, lang_hash, first, before):
        starts = np.flatnonzero((_KIND[data] == 0) & np.concatenate(([True], _KIND[data[:-1]] != 0))) if len(data) else np.empty(0, np.int64)
        edges = offsets[1:-1]
        edges = np.unique(edges[edges < len(data)])
        edges = edges[_KIND[data[edges]] == 0]
        self.start = np.union1d(starts, edges)
        last = (_KIND[data] == 0) & np.concatenate((_KIND[data[1:]] != 0, [True])) if len(data) else np.empty(0, bool)
        ends = np.flatnonzero(last) + 1
        inner = edges[edges > 0]
        self.end = np.union1d(ends, inner[_KIND[data[inner - 1]] == 0])
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        h = c.span_hash(c.prefix_hash(data), self.start, self.end)
        h = c.mix64(h ^ lang_hash[first + self.row])
        h[h == 0] = U(1)
        breaks = np.cumsum(_KIND[data] == 2)
        at = breaks[self.start] if len(data) else np.empty(0, np.int64)
        gap = np.ones(len(h), bool)
        if len(h) > 1:
            gap[1:] = (at[1:] != at[:-1]) | (self.row[1:] != self.row[:-1])
        self.new = 0
        tail = bool(len(data) and breaks[-1] > (at[-1] if len(h) else 0))
        if before is not None:
            if len(h):
                gap[0] = before[2] or at[0] > 0
            h, gap, self.new = np.concatenate((before[0], h)), np.concatenate((before[1], gap)), len(before[0])
            tail = tail or (before[2] and self.new == len(h))
        self.h, self.gap, self.tail = h, gap, tail

    def carried(self):
        keep = DEPTH - 1
        return self.h[-keep:], self.gap[-keep:], self.tail


def _words(batches, limit: int) -> Iterator[tuple[Words, np.ndarray, list, int, bool]]:
    for batch in batches:
        langs = batch.column(1).to_pylist()
        known = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(langs)}
        lang_hash = np.array([known[x] for x in langs], U)
        before = None
        for first, data, offsets, goes_on in _parts(batch.column(0), limit):
            w = Words(data, offsets, lang_hash, first, before)
            yield w, data, langs, first, goes_on
            before = w.carried() if goes_on else None


def _input(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UND)).alias("lang"))


def word_table(texts: DataFrame, limit: int = c.CHUNK_BYTES) -> DataFrame:
    """lang, word, h, f of every distinct word."""
    def run(batches):
        for w, data, langs, first, _ in _words(batches, limit):
            h, at, n = np.unique(w.h[w.new:], return_index=True, return_counts=True)
            raw = data.tobytes()
            words = [raw[a:b] for a, b in zip(w.start[at].tolist(), w.end[at].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([langs[first + r] for r in w.row[at].tolist()], pa.string()), pa.array(words, pa.binary()).cast(pa.string()),
                 pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["lang", "word", "h", "n"])

    return (texts.mapInArrow(run, "lang string, word string, h long, n long")
            .groupBy("lang", "word").agg(F.sum("n").alias("f"), F.min("h").alias("h")))


def bitmap(keys: DataFrame, col: str, count: int) -> np.ndarray:
    """A bitmap of the hashes in ``col``; its size follows from their number up to ``MAX_BITS``."""
    bits = 1 << 16
    while bits < min(BITS_PER_ENTRY * count, MAX_BITS):
        bits *= 2
    at = F.col(col).bitwiseAND(F.lit(bits - 1))
    got = (keys.groupBy(F.shiftright(at, 6).cast("int").alias("i"))
           .agg(F.bit_or(F.expr(f"shiftleft(1L, CAST({col} & 63 AS INT))")).alias("w")).toArrow())
    out = np.zeros(bits >> 6, U)
    out[got["i"].to_numpy()] = got["w"].to_numpy().view(U)
    return out


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & U(len(bits) * 64 - 1)
    return (bits[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) == 1


def _chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return c.mix64(a * U(0x9E3779B97F4A7C15) + b)


def _pair_hashes(w: Words, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word but the last: the hash of it and the next; whether they are one phrase of frequent words."""
    if len(w.h) < 2:
        return np.empty(0, U), np.empty(0, bool)
    often = has(frequent, w.h)
    return _chain(w.h[:-1], w.h[1:]), often[:-1] & often[1:] & ~w.gap[1:]


def pair_table(texts: DataFrame, frequent, limit: int = c.CHUNK_BYTES) -> DataFrame:
    """p, f: counts of the two-word prefixes whose words are frequent."""
    def run(batches):
        def out(held):
            p, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(n, pa.int64())], ["p", "n"])

        held, size = [np.empty(0, U)], 0
        for w, _, _, _, _ in _words(batches, limit):
            p, ok = _pair_hashes(w, frequent.value)
            ok[:max(0, w.new - 1)] = False                   # pairs of carried words are counted already
            held.append(p[ok])
            size += len(held[-1])
            if size > HELD:
                yield out(held)
                held, size = [np.empty(0, U)], 0
        yield out(held)

    return texts.mapInArrow(run, "p long, n long").groupBy("p").agg(F.sum("n").alias("f"))


def suffix_windows(texts: DataFrame, frequent, pairs, heavy, groups: int, limit: int = c.CHUNK_BYTES) -> DataFrame:
    """Truncated suffixes with counts, combined within a task, and the group of their prefix:
    g, split (the prefix is extended), w1..w4 (0 beyond the end), n."""
    def run(batches):
        def out(held):
            cols = [np.concatenate(x) for x in zip(*held)]
            key = cols[0]
            for x in cols[1:]:
                key = _chain(key, x)
            key, at, n = np.unique(key, return_index=True, return_counts=True)
            cols = [x[at] for x in cols]
            prefix = _chain(cols[0], cols[1])
            split = has(heavy.value, prefix)
            g = (c.mix64(np.where(split, key, prefix)) % U(groups)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(g), pa.array(split), *(pa.array(x.view(np.int64)) for x in cols), pa.array(n, pa.int64())],
                                              ["g", "split", *COLS, "n"])

        held, size = [], 0
        for w, _, _, _, goes_on in _words(batches, limit):
            p, ok = _pair_hashes(w, frequent.value)
            ok &= has(pairs.value, p)
            ok = np.concatenate((ok, np.zeros(DEPTH, bool)))
            h = np.concatenate((w.h, np.zeros(DEPTH, U)))
            # the last words wait for the next part of their text; those carried here were not begun before
            begin = np.flatnonzero(ok[:max(0, len(w.h) - (DEPTH - 1) if goes_on else len(w.h))])
            cols, on = [h[begin], h[begin + 1]], np.ones(len(begin), bool)
            for k in range(2, DEPTH):
                on = on & ok[begin + k - 1]
                cols.append(np.where(on, h[begin + k], U(0)))
            held.append(cols)
            size += len(begin)
            if size > HELD:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    schema = "g long, split boolean, " + ", ".join(f"{x} long" for x in COLS) + ", n long"
    return texts.mapInArrow(run, schema)


COLS = [f"w{k + 1}" for k in range(DEPTH)]


def subtree(least: int):
    """The counts of a group's nodes, from the totals of the leaves below them."""
    def run(table: pa.Table) -> pa.Table:
        w = [table[x].to_numpy() for x in COLS]
        order = np.lexsort(w[::-1])
        w = [x[order] for x in w]
        n, split = table["n"].to_numpy()[order], table["split"].to_numpy()[order]
        starts = np.zeros(len(n), bool)
        starts[:1] = True
        out = []
        for d in range(DEPTH):
            starts[1:] |= w[d][1:] != w[d][:-1]
            if d == 0:
                continue
            at = np.flatnonzero(starts)
            total = np.add.reduceat(n, at)
            keep = (w[d][at] != 0) & ((total >= least) | (split[at] & (d + 1 < DEPTH)))
            at, total = at[keep], total[keep]
            out.append([np.full(len(at), d + 1, np.int32), *(x[at] if k <= d else np.zeros(len(at), np.int64) for k, x in enumerate(w)), total])
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out)], names=["m", *COLS, "a"])
    return run


def phrase_counts(texts: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """key (word hashes), m, f of all phrases of 1 to ``DEPTH`` words found ``least`` times or more."""
    spark = texts.sparkSession
    bc = spark.sparkContext.broadcast
    often = words.where(F.col("f") >= least)
    frequent = bc(bitmap(often, "h", often.count()))
    pairs = c.stage(pair_table(texts, frequent).where(F.col("f") >= least))
    count, total = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum("f"), F.lit(0))).first()
    heavy = pairs.where(F.col("f") > HEAVY)
    groups = 2 * (total // GROUP) + 1
    suffixes = suffix_windows(texts, frequent, bc(bitmap(pairs, "p", count)), bc(bitmap(heavy, "p", heavy.count())), groups)
    nodes = suffixes.groupBy("g").applyInArrow(subtree(least), "m int, " + ", ".join(f"{x} long" for x in COLS) + ", a long")
    nodes = nodes.groupBy("m", *COLS).agg(F.sum("a").alias("f")).where(F.col("f") >= least)
    return nodes.select(F.slice(F.array(*COLS), F.lit(1), F.col("m")).alias("key"), "m", "f").unionByName(
        often.select(F.array("h").alias("key"), F.lit(1).alias("m"), "f"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, top: int = 2000,
                 inside: tuple[int, int] = (80, 100)) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score. A phrase goes where a
    longer candidate around it has ``inside[0] / inside[1]`` of its count or more."""
    texts = _input(docs, text_col, lang_col)
    words = c.stage(word_table(texts))
    phrases = c.stage(phrase_counts(texts, words, least))
    cand = phrases.where("m > 1").withColumnRenamed("f", "a")
    exact = "DECIMAL(20,0)"

    # the cut with the lowest score (ties: the first)
    cuts = cand.select("key", "m", "a", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k")).select(
        "key", "m", "a", "k", F.slice("key", F.lit(1), F.col("k")).alias("head"), F.slice("key", F.col("k") + 1, F.col("m") - F.col("k")).alias("rest"))
    part = phrases.select("key", "f")
    cuts = (cuts.join(part.select(F.col("key").alias("head"), F.col("f").alias("l")), "head")
            .join(part.select(F.col("key").alias("rest"), F.col("f").alias("r")), "rest")
            .withColumn("score", F.expr(f"CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS {exact}) DIV (CAST(l AS {exact}) + CAST(r AS {exact}))").cast("long")))
    scored = (cuts.groupBy("key", "m", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
              .select("key", "m", "a", "b.score", "b.l", "b.r"))

    # the highest count of a longer candidate around each phrase
    longer = cand.where("m > 2").select("key", "m", "a", F.explode(F.sequence(F.lit(2), F.col("m") - 1)).alias("len"))
    longer = longer.select("key", "a", "len", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("len") + 1)).alias("at"))
    around = longer.groupBy(F.slice("key", F.col("at"), F.col("len")).alias("key")).agg(F.max("a").alias("around"))
    kept = scored.join(around, "key", "left").where(
        F.expr(f"around IS NULL OR {int(inside[1])} * CAST(around AS {exact}) < {int(inside[0])} * CAST(a AS {exact})")).drop("around")

    # words back from their hashes
    spelled = kept
    names = words.where(F.col("f") >= least).select("h", "lang", "word")
    for k in range(DEPTH):
        name = names.select(F.col("h").alias(f"h{k}"), F.col("word").alias(f"word{k}"), *([F.col("lang")] if k == 0 else []))
        spelled = spelled.join(name, F.get("key", F.lit(k)) == F.col(f"h{k}"), "inner" if k == 0 else "left").drop(f"h{k}")
    spelled = spelled.select("lang", F.concat_ws(" ", *[f"word{k}" for k in range(DEPTH)]).alias("phrase"), "a", "l", "r", "score")

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = spelled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
