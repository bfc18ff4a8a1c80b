"""Importance resampling towards a target distribution, on hashed word n-grams.

A text's bytes are translated by a 256-byte table that lower-cases A-Z and blanks everything else
that is no word byte (``0-9``, ``a-z`` and all bytes of non-ASCII characters); ``split`` gives the
words. A feature is a run of 1 to ``n`` words; the crc32 of a longer run is that of the shorter one
carried on over a blank and the next word, so no run is ever spelled out. Counters reduce the
features of a task, a map-side combined sum those of all tasks.

A feature's bucket is its crc32 modulo ``buckets``. A bucket's gain is its smoothed log ratio in the
target against the documents, a document's weight the floored mean of its features' gains, and its
score the weight plus seeded Gumbel noise: the highest scores are a sample without replacement.

Scale: the documents are scanned twice and only numbers are shuffled. The table of gains has
``buckets`` entries however many rows there are. The draw needs no global sort: totals per score
(whole numbers from a fixed range) give each score's first rank, and rows are numbered within
their score.

Cases: a null text has no words, no features and weight 0; a null id counts as the text ``''`` in
the noise and sorts first among ties. Equal rows are rows of their own. An empty target or empty
documents are smoothed like any counts. Columns but the id and text are not read, so their names
cannot clash. Long texts are split ``SEGMENT`` bytes at a time, the last words carried over.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm import common as c
from riskweave.operators.rank import running_totals

#: Bytes that belong to words, lower-cased; all others become blanks.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
              for b in range(256))
SEGMENT = 1 << 20
#: Distinct features that a task's Counter holds before they are folded into buckets.
HELD = 1 << 18


def features(text: bytes, n: int) -> Iterator[tuple[int, list[int]]]:
    """(new words, crc32 of the 1- to ``n``-word runs that end in them), a segment at a time."""
    clean, at, before = text.translate(TABLE), 0, []
    while at < len(clean):
        end = clean.find(b" ", at + SEGMENT)
        end = len(clean) if end < 0 else end
        words, old = before + clean[at:end].split(), len(before)
        run = list(map(crc32, words))
        out = run[old:]
        spaced = [b" " + w for w in words[1:]]
        for k in range(2, n + 1):
            run = list(map(crc32, spaced[k - 2:], run))      # the run from i, carried on over word i + k - 1
            out += run[max(0, old - k + 1):]
        yield len(words) - old, out
        before, at = words[-(n - 1):] if n > 1 else [], end


def _texts(col) -> Iterator[bytes]:
    raw, offsets = c.text_buffers(col)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield raw[a:b].tobytes()


def bucket_counts(df: DataFrame, text_col: str = "text", n: int = 2, buckets: int = 10_000) -> np.ndarray:
    """How many features of all texts fall in each bucket."""
    def run(batches):
        total, held = np.zeros(buckets, np.int64), Counter()

        def fold():
            at = np.fromiter(held.keys(), np.int64, len(held)) % buckets
            np.add.at(total, at, np.fromiter(held.values(), np.int64, len(held)))
            held.clear()

        for batch in batches:
            for text in _texts(batch.column(0)):
                for _, found in features(text, n):
                    held.update(found)
                    if len(held) > HELD:
                        fold()
        fold()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    rows = (df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())        # at most ``buckets`` rows
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), in doubles."""
    size, s_all, t_all = len(docs), int(docs.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + size)) / float((s + 1) * (t_all + size))))
                     for t, s in zip(target.tolist(), docs.tolist())], np.int64)


def weigh(docs: DataFrame, table: np.ndarray, id_col: str = "doc_id", text_col: str = "text", n: int = 2) -> DataFrame:
    """id, n_words, n_features and weight (floored mean gain) of every row."""
    held, buckets = docs.sparkSession.sparkContext.broadcast(table), len(table)

    def run(batches):
        gain = held.value
        for batch in batches:
            words, counts, weights = [], [], []
            for text in _texts(batch.column(1)):
                w = f = s = 0
                for new, found in features(text, n):
                    w, f = w + new, f + len(found)
                    s += int(gain[np.fromiter(found, np.int64, len(found)) % buckets].sum())
                words.append(w)
                counts.append(f)
                weights.append(s // f if f else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, counts, weights))],
                                             [id_col, "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, n_words long, n_features long, weight long")


def gumbel(id_col: str, seed: int):
    """Whole-numbered Gumbel noise from the first 8 hex digits of sha256('<seed>:<id>')."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, id_col: str, least_words: int, percent: int) -> DataFrame:
    """Adds ``rank``: of the rows with ``least_words`` the floor(percent * N / 100) highest scores
    have 1, 2, ... (ties to the smaller id), all others null."""
    able = F.col("n_words") >= least_words
    per_score = scored.where(able).groupBy((-F.col("score")).alias("_down")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per distinct score: its places come from two levels of sums, and no row is sorted globally
    first = running_totals(per_score, [], ["_down"], ["_n"], bucket=F.floor(F.col("_down") / F.lit(256)).cast("long"),
                           prefix="_before", inclusive=False)
    drawn = (first.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0] * percent) // 100
    first = first.where(F.col("_before_n") < drawn).select((-F.col("_down")).alias("score"), F.col("_before_n").alias("_before"))
    placed = scored.join(first, "score", "left").select(*scored.columns, F.when(able, F.col("_before")).alias("_before"))
    within = Window.partitionBy("score").orderBy(F.col(id_col).asc_nulls_first())
    top = placed.where("_before IS NOT NULL").withColumn("rank", F.col("_before") + F.row_number().over(within))
    top = top.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    rest = placed.where("_before IS NULL").withColumn("rank", F.lit(None).cast("long"))
    return top.unionByName(rest).drop("_before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
             n: int = 2, buckets: int = 10_000, least_words: int = 20, percent: int = 25, seed: int = 7) -> DataFrame:
    """Every row's id, n_words, n_features, weight, score and rank (null where it is not drawn)."""
    table = gains(bucket_counts(target, target_text, n, buckets), bucket_counts(docs, text_col, n, buckets))
    weighed = weigh(docs, table, id_col, text_col, n)
    return ranked(c.stage(weighed.withColumn("score", F.col("weight") + gumbel(id_col, seed))), id_col, least_words, percent)


def drawn_rows(docs: DataFrame, ranks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The drawn documents with all their columns."""
    keep = ranks.where("rank IS NOT NULL").select(F.col(id_col).alias("_drawn"))
    return docs.join(keep, docs[id_col].eqNullSafe(keep["_drawn"]), "left_semi")
