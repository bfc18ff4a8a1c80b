"""Helpers shared by the training-data operators: staged tables, Arrow text access, word hashing,
connected components.

Python code here runs inside Spark tasks on Arrow batches, a few megabytes of text at a time.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.session import ensure_checkpoint_dir

U64 = np.uint64
CHUNK_BYTES = 1 << 21


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---------------------------------------------------------------- staged tables

def stage_root(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder; Hadoop removes it when the driver ends."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return root


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back. This cuts
    the lineage (later passes survive lost executors without recomputing) and lets the shuffle
    files behind it be removed."""
    spark, path = df.sparkSession, stage_root(df.sparkSession)
    df.write.parquet(path)
    schema = df.schema
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; what is not in a staging folder stays."""
    for df in tables:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if root.rsplit("/", 1)[-1].startswith("llm-"):
                path = jvm.org.apache.hadoop.fs.Path(root)
                path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's context cleaner remove shuffle files of DataFrames that are out of scope (on a
    driver with little garbage that would otherwise wait for its half-hourly collection)."""
    gc.collect()
    spark.range(1).collect()            # listeners hold the last query, and with it its shuffles, until the next
    spark.sparkContext._jvm.System.gc()


# ---------------------------------------------------------------- Arrow text access

def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array; a null has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    if col.null_count:
        ok = col.is_valid().to_numpy(zero_copy_only=False)
        if (np.diff(offsets)[~ok] > 0).any():
            return text_buffers(col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b""))
    return raw, offsets.astype(np.int64)


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; between them the allocators give back what the last one needed. Python workers
    serve one stage after another, and would else hold on to the most that any has used."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        if trim is not None:
            trim(0)


def text_chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``limit`` bytes (one longer text makes its own run):
    (first row, last row + 1, bytes, offsets from 0)."""
    raw, offsets = text_buffers(col)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, n)
        yield at, end, raw[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


# ---------------------------------------------------------------- hashing

def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, vectorised."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = {"n": 0}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2**64."""
    if _POWERS["n"] < n + 1:
        size = max(n + 1, 1 << 16)
        inv = pow(_BASE, -1, 1 << 64)
        for key, base in (("p", _BASE), ("i", inv)):
            arr = np.full(size, base, U64)
            arr[0] = 1
            _POWERS[key] = np.multiply.accumulate(arr)
        _POWERS["n"] = size
    return _POWERS["p"][:n + 1], _POWERS["i"][:n + 1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] the (shifted) polynomial hash of data[i:j], modulo 2**64."""
    p, _ = powers(len(data))
    s = np.empty(len(data) + 1, U64)
    s[0] = 0
    np.cumsum((data.astype(U64) + U64(1)) * p[:len(data)], out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every data[start:end], the same wherever those bytes stand."""
    _, inv = powers(len(s) - 1)
    return mix64((s[end] - s[start]) * inv[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


# ---------------------------------------------------------------- words

_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word ``[^\\x20\\x09-\\x0D]+``; no word crosses a row."""
    if not len(data):
        e = np.empty(0, np.int64)
        return e, e, e
    w = ~_SEP[data]
    before = np.empty_like(w)
    before[0] = False
    before[1:] = w[:-1]
    after = np.empty_like(w)
    after[-1] = False
    after[:-1] = w[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after[edges - 1] = False
    start = np.flatnonzero(w & ~before)
    end = np.flatnonzero(w & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word."""
    start, end, row = word_spans(data, offsets)
    return span_hash(prefix_hash(data), start, end), row


def shingles(words: np.ndarray, row: np.ndarray, n_rows: int, n: int,
             short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles in text order: (hash, row, index of its first word). With
    ``short``, a row of 1 to n-1 words has its whole sequence as its one shingle."""
    count = np.bincount(row, minlength=n_rows) if len(row) else np.zeros(n_rows, np.int64)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    acc = np.zeros(max(0, len(words) - n + 1), U64)
    for k in range(n):
        acc = mix64(acc * U64(0x9E3779B97F4A7C15) + words[k:len(words) - n + 1 + k] + U64(n))
    ok = row[:len(acc)] == row[n - 1:n - 1 + len(acc)] if len(acc) else np.empty(0, bool)
    at = np.flatnonzero(ok)
    h, r = acc[at], row[at]
    if short:
        few = np.flatnonzero((count > 0) & (count < n))
        if len(few):
            out = np.zeros(len(few), U64)
            for k in range(n - 1):
                has = count[few] > k
                w = words[np.minimum(first[few] + k, len(words) - 1)]
                out = np.where(has, mix64(out * U64(0x9E3779B97F4A7C15) + w + count[few].astype(U64)), out)
            h, r, at = np.concatenate((h, out)), np.concatenate((r, few)), np.concatenate((at, first[few]))
            order = np.argsort(r, kind="stable")
            h, r, at = h[order], r[order], at[order]
    return h, r, at


def distinct_per_row(h: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes in ascending order: (hashes, offsets). ``row`` is ascending."""
    h = h.copy()
    ends = np.searchsorted(row, np.arange(n_rows + 1))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a > 1:
            h[a:b].sort()
    keep = np.ones(len(h), bool)
    if len(h):
        keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], np.concatenate(([0], np.cumsum(np.bincount(row[keep], minlength=n_rows)))) if len(h) else np.zeros(n_rows + 1, np.int64)


def run_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of the runs of ``values`` that begin at ``starts``."""
    return np.add.reduceat(values, starts) if len(starts) else np.empty(0, U64)


# ---------------------------------------------------------------- connected components

EDGES_PER_FILE = 200_000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: (node, root), root the smallest node reached.

    Alternating large-star and small-star steps; each is a map-side combined minimum and a join
    back, so a node with very many links is one partial sum per task and a splittable join.
    Every round is written to the shared folder. Raises if ``max_rounds`` do not suffice (the
    number needed grows with the logarithm of the longest path)."""
    e = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
              .where("u != v").distinct())
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u != v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        out = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        # few links left need few files: their number hardly grows from one round to the next
        before, e = e, stage(out.coalesce(seen[0] // EDGES_PER_FILE + 1) if seen else out)
        discard(before)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
