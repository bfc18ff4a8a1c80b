"""Substring dedup by content-defined chunks.

A gear hash rolls over each text's bytes; a chunk ends where its top bits are zero, not before
``MIN`` and not after ``MAX`` bytes, and only between characters. Cuts depend on the bytes just
before them, so an insertion moves only the chunks around it. Chunks are known by a 128-bit
BLAKE2b digest. Of equal chunks that in the document with the smallest id stays (in one
document, the first); the others are removed.

A digest's count and smallest id come from map-side combined sums, and rows of repeated digests
only are joined back, so a chunk held by a third of all documents is one partial sum per task and
a join side that Spark can split.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm import common as c

WINDOW = 16
MIN, MAX, BITS = 24, 256, 5
#: One random number per byte value, from a rule.
GEAR = (c.mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x6A09E667F3BCC909)) >> np.uint64(32)).astype(np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte, over the ``WINDOW`` bytes up to it (h = 2 h + GEAR[b]), whose top
    bits are those of the classic rolling form; summed by doubling."""
    h, span = GEAR[data], 1
    while span < WINDOW:
        more = np.zeros_like(h)
        more[span:] = h[:-span] << np.uint32(span)
        h = h + more
        span *= 2
    return h << np.uint32(32 - WINDOW)


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """The ends of each row's chunks (places in ``data``)."""
    n = len(data)
    between = np.ones(n + 1, bool)                            # places where a character may end
    between[:n] = (data & 0xC0) != 0x80
    cut = np.flatnonzero((gear_hash(data) >> np.uint32(32 - BITS)) == 0) + 1
    cut = cut[between[cut]]
    bounds = np.searchsorted(cut, offsets)
    cut = cut.tolist()
    out = []
    for start, end, i, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
        ends = []
        while start < end:
            least = start + MIN
            while i < stop and cut[i] < least:
                i += 1
            at = cut[i] if i < stop else end
            if at - start > MAX:
                at = start + MAX
                while at > least and not between[at]:         # not within a character
                    at -= 1
            if at > end:
                at = end
            ends.append(at)
            start = at
        out.append(ends)
    return out


def _chunks(batches):
    """A row per chunk: its digest as two numbers, its document, its place."""
    blake = hashlib.blake2b
    for batch in batches:
        for a, b, data, offsets in c.text_chunks(batch.column(2)):
            raw = memoryview(data.tobytes())
            ends = chunk_ends(data, offsets)
            count = np.array([len(e) for e in ends], np.int64)
            end = np.array([x for e in ends for x in e], np.int64)
            if not len(end):
                continue
            row = np.repeat(np.arange(b - a), count)
            start = np.concatenate(([0], end[:-1]))
            start = np.where(np.concatenate(([True], row[1:] != row[:-1])), offsets[row], start)
            digest = np.frombuffer(b"".join([blake(raw[x:y], digest_size=16).digest() for x, y in zip(start.tolist(), end.tolist())]), np.int64)
            at = pa.array(a + row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(digest[::2]), pa.array(digest[1::2]), batch.column(0).take(at), batch.column(1).take(at),
                 pa.array((start - offsets[row]) * 1024 + (end - start))], names=["d1", "d2", "_id", "_th", "at"])


def _remove(batches):
    """Cut the chunks that repeat: rows (row, text, spans) with spans (at, d1, own)."""
    for batch in batches:
        raw, off = c.text_buffers(batch.column(1))
        rows = []
        for i, spans in enumerate(batch.column(2).to_pylist()):
            text, seen, cut, dup = raw[off[i]:off[i + 1]].tobytes(), set(), [], 0
            for at, d1, own in sorted((s["at"], s["d1"], s["own"]) for s in spans):
                dup += at % 1024
                if own and d1 not in seen:
                    seen.add(d1)
                else:
                    cut.append((at // 1024, at // 1024 + at % 1024))
            kept, last = [], 0
            for x, y in cut:
                kept.append(text[last:x])
                last = y
            kept = b"".join([*kept, text[last:]]).decode("utf-8", "replace")
            rows.append((len(text), len(spans), dup, len(cut), sum(y - x for x, y in cut), kept))
        cols = list(zip(*rows)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, pa.int64()) for v in cols[:5]], pa.array(cols[5], pa.string())],
                                         names=["_row", "n_bytes", "n_shared", "shared_bytes", "n_cut", "n_removed", "text"])


def dedup_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """Per input row its ``columns`` (default: the id), ``n_bytes``, ``n_shared`` and
    ``shared_bytes`` (chunks that also occur elsewhere, and their bytes), ``n_cut`` and
    ``n_removed`` (those removed), and ``kept_text``.

    Rows with one id are versions of one document: each keeps its own first copy of a chunk that
    the document holds by its id. A row without an id keeps chunks that occur in no row with an
    id. Null texts count as empty (``kept_text`` is null); other columns are not read; an empty
    table gives no rows."""
    columns = [id_col] if columns is None else columns
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.hash(text_col).alias("_th"), F.col(text_col).alias("_text"),
                       F.struct(*[docs[x].alias(f"c{k}") for k, x in enumerate(columns)]).alias("_row"))
    chunks = rows.select("_id", "_th", "_text").mapInArrow(_chunks, f"d1 long, d2 long, _id {id_type}, _th int, at long")
    again = (chunks.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min("_id").alias("first"))
             .where("n > 1").select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), "first"))
    shared = chunks.join(again, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")))
    spans = shared.groupBy("_id", "_th").agg(
        F.collect_set(F.struct("at", "d1", F.col("_id").eqNullSafe(F.col("first")).alias("own"))).alias("spans"))
    spans = spans.select(F.col("_id").alias("s_id"), F.col("_th").alias("s_th"), "spans")
    row_type = rows.schema["_row"].dataType.simpleString()
    out = rows.join(spans, F.col("_id").eqNullSafe(F.col("s_id")) & (F.col("_th") == F.col("s_th")), "left").select(
        "_row", "_text", F.coalesce("spans", F.array().cast("array<struct<at:bigint,d1:bigint,own:boolean>>")).alias("spans"), F.col("_text").isNull().alias("none"))
    out = out.select(F.struct("_row", "none").alias("_row"), "_text", "spans").mapInArrow(
        _remove, f"_row struct<_row:{row_type},none:boolean>, n_bytes long, n_shared long, shared_bytes long, n_cut long, n_removed long, text string")
    return out.select(*[F.col(f"_row._row.c{k}").alias(x) for k, x in enumerate(columns)], "n_bytes", "n_shared", "shared_bytes", "n_cut", "n_removed",
                      F.when(~F.col("_row.none"), F.col("text")).alias("kept_text"))
