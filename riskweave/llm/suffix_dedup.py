"""Removal of byte strings of ``length`` bytes that also start anywhere else, exact.

1. **Shards.** Each window of ``length`` bytes is assigned to its anchor: the ``KMER``-byte string
   in it with the least hash (the first of equals). Equal windows have equal anchors at equal
   places, so all copies of a window meet in their anchor's group. One row stands for the run of
   windows of one anchor occurrence: its *block*, the bytes these windows cover.
2. **Equal blocks.** Where a group has one block twice, all its windows repeat; nothing more has to
   be read for them. Anchors that occur once are done, too: nothing in them repeats.
3. **Induced sorting.** The other blocks (around the edges of passages, and edits in near copies)
   are fetched and the suffixes of each shard's blocks sorted by :mod:`induced_sort`, whose LCP
   values tell which windows start elsewhere as well.
   A group with very many blocks (a passage in very many surroundings) is split instead: its
   windows are counted by hash, with map-side combined sums.
4. **Removal.** The spans found are merged per text and cut.

Texts never leave Spark's partitions whole but for two joins on the row's key.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm import common as c
from riskweave.llm.induced_sort import MEMORY, repeated

U64 = np.uint64
KMER = 48
HOT_BLOCKS = 20_000            # blocks of a group beyond which its windows are counted by hash
RUN_BYTES = 4 << 20            # text sorted at once; whole groups, so a larger group makes its own run


def anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """The blocks of all windows: (anchor hash, block hash, row, first window, last window, anchor
    place); places count from the row's first byte."""
    n, k = len(data), min(KMER, max(1, length // 2))
    w = length - k + 1
    if n < length:
        e = np.empty(0, np.int64)
        return e.astype(U64), e.astype(U64), e, e, e, e
    s = c.prefix_hash(data)
    _, inv = c.powers(n)
    kmer = c.mix64((s[k:] - s[:-k]) * inv[:n - k + 1])
    low = ((kmer >> U64(32)) << U64(32)) | np.arange(len(kmer), dtype=U64)
    span = 1
    while span * 2 <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < w:
        low = np.minimum(low[:-(w - span)], low[w - span:])
    place = (low & U64(0xFFFFFFFF)).astype(np.int64)          # anchor of the window that starts here
    size = np.diff(offsets)
    some = np.flatnonzero(size >= length)
    count = size[some] - length + 1
    starts = np.repeat(offsets[:-1][some] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    row = np.repeat(some, count)
    p = place[starts]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    last = np.concatenate((at[1:] - 1, [len(p) - 1])) if len(p) else at
    q1, q2, p, row = starts[at], starts[last], p[at], row[at]
    block = c.mix64(c.span_hash(s, q1, q2 + length) + (p - q1).astype(U64) * U64(1 << 20) + (q2 - q1).astype(U64))
    base = offsets[:-1][row]
    return kmer[p], block, row, q1 - base, q2 - base, p - base


def _anchor_rows(length):
    """Rows (text, a, f, at, m). Equal blocks of one batch are combined: the first has their number
    as ``m``; the others are known to repeat and come as spans (at, -m bytes), joined where they
    touch, under a key of their own. So a block that is everywhere sends a row per batch."""
    def run(batches):
        for batch in c.tidy(batches):
            for a, b, data, offsets in c.text_chunks(batch.column(2)):
                key, block, row, q1, q2, _ = anchors(data, offsets, length)
                _, first, back, count = np.unique(block, return_index=True, return_inverse=True, return_counts=True)
                lead = np.zeros(len(block), bool)
                lead[first] = True
                rest = ~lead
                begin = rest.copy()
                begin[1:] &= lead[:-1] | (row[1:] != row[:-1])
                start = np.flatnonzero(begin)
                group = np.cumsum(begin)[rest] - 1
                stop = np.zeros(len(start), np.int64)
                stop[group] = q2[rest] + length                # the last of each run stays
                rows = np.concatenate((row[lead], row[start]))
                at = np.concatenate((q1[lead] * 1024 + (q2 - q1)[lead], q1[start]))
                m = np.concatenate((count[back[lead]], q1[start] - stop))
                own = c.mix64(block[start] + q1[start].astype(U64) + (row[start].astype(U64) << U64(32)))
                take = pa.array(a + rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate((key[lead], own)).view(np.int64)),
                     pa.array(np.concatenate((block[lead], own)).view(np.int64)), pa.array(at), pa.array(m)], names=["_id", "_th", "a", "f", "at", "m"])

    return run


def _fetch(length):
    """Bytes of the blocks asked for: rows (text, list of (a, f, n, at))."""
    def run(batches):
        for batch in c.tidy(batches):
            raw, off = c.text_buffers(batch.column(2))
            asked = batch.column(3)
            flat = asked.flatten()
            own = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
            at = flat.field("at").to_numpy()
            start = off[own] + at // 1024
            end = start + at % 1024 + length
            for lo in range(0, len(own), 4096):
                part = slice(lo, lo + 4096)
                a, b = start[part], end[part]
                ok = b <= off[own[part] + 1]
                blob = b"".join([raw[x:y].tobytes() if k else b"" for x, y, k in zip(a.tolist(), b.tolist(), ok.tolist())])
                lens = np.where(ok, b - a, 0)
                content = pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(lens))).astype(np.int32)), pa.py_buffer(blob)])
                rows = pa.array(own[part])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), *[flat.field(k).slice(lo, 4096) for k in ("a", "f", "n", "at")], content],
                    names=["_id", "_th", "a", "f", "n", "at", "block"])

    return run


def repeated_windows(blocks: list[bytes], length: int, memory: int = MEMORY) -> list[np.ndarray]:
    """For each block the places whose window starts elsewhere in the blocks, too."""
    lens = np.array([len(b) for b in blocks], np.int64)
    raw = np.frombuffer(b"".join(blocks), np.uint8)
    used = np.flatnonzero(np.bincount(raw, minlength=256))
    if len(used) > 255:                                        # not UTF-8: no byte value is left to end strings with
        seen: dict[bytes, int] = {}
        for b in blocks:
            for i in range(len(b) - length + 1):
                seen[b[i:i + length]] = seen.get(b[i:i + length], 0) + 1
        return [np.array([i for i in range(len(b) - length + 1) if seen[b[i:i + length]] > 1], np.int64) for b in blocks]
    code = np.zeros(256, np.uint8)
    code[used] = np.arange(1, len(used) + 1)
    stop = np.cumsum(lens + 1) - 1
    T = np.zeros(int(lens.sum()) + len(blocks) + 8, np.uint8)
    inside = np.ones(len(T) - 8, bool)
    inside[stop] = False
    T[:-8][inside] = code[raw]
    hit = repeated(T, np.repeat(stop, lens + 1).astype(np.int32), length, memory)
    places = np.flatnonzero(hit)
    owner = np.searchsorted(stop, places)
    first = np.concatenate(([0], stop[:-1] + 1))
    cut = np.searchsorted(owner, np.arange(len(blocks) + 1))
    places = places - first[owner]
    return [places[x:y] for x, y in zip(cut[:-1], cut[1:])]


def _sort_shards(length, memory=MEMORY):
    """Rows in the order of their group (a, f): repeated spans of the blocks that occur once."""
    def spans(rows):
        got = repeated_windows([r[5] for r in rows], length, memory)
        out = []
        for (rid, th, _, n, at, _), hits in zip(rows, got):
            if n > 1 or not len(hits):
                continue
            q1, more = divmod(at, 1024)
            hits = hits[hits <= more]
            cut = np.flatnonzero(np.diff(hits) > length) + 1
            for run in np.split(hits, cut) if len(hits) else ():
                out.append((rid, th, q1 + int(run[0]), q1 + int(run[-1]) + length))
        return out

    def flush(rows, id_type):
        out = spans(rows)
        cols = list(zip(*out)) if out else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
                                          names=["_id", "_th", "start", "end"])

    def run(batches):
        held, size, group, seen, id_type = [], 0, None, None, None
        for batch in c.tidy(batches):
            id_type = batch.schema.field(0).type
            rid, th, a, f, n, at, block = (batch.column(k) for k in range(7))
            a, f, n, at, th = (x.to_numpy() for x in (a, f, n, at, th))
            for i in range(batch.num_rows):
                if a[i] != group:
                    if size >= RUN_BYTES:
                        yield flush(held, id_type)
                        held, size = [], 0
                    group, seen = a[i], None
                if f[i] == seen:                               # a block that occurs more than once: one stands for all
                    continue
                seen = f[i]
                data = block[i].as_py()
                held.append((rid[i].as_py(), int(th[i]), int(a[i]), int(n[i]), int(at[i]), data))
                size += len(data)
        if held:
            yield flush(held, id_type)

    return run


def _windows(length):
    """Rows (a, h, f, n, offset, text, start) of all windows of blocks."""
    def run(batches):
        for batch in c.tidy(batches):
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                data, off = c.text_buffers(part.column(6))
                s = c.prefix_hash(data[off[0]:off[-1]])
                off = off - off[0]
                at = part.column(5).to_numpy()
                count = np.where(off[1:] > off[:-1], at % 1024 + 1, 0)
                own = np.repeat(np.arange(part.num_rows), count)
                offset = np.arange(len(own)) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count)
                start = off[own] + offset
                h = c.span_hash(s, start, start + length)
                take = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [part.column(2).take(take), pa.array(h.view(np.int64)), part.column(3).take(take), part.column(4).take(take), pa.array(offset),
                     part.column(0).take(take), part.column(1).take(take), pa.array((at // 1024)[own] + offset)],
                    names=["a", "h", "f", "n", "offset", "_id", "_th", "start"])

    return run


def _count_windows(blocks: DataFrame, length: int, id_type: str) -> DataFrame:
    """Repeated windows of blocks that occur once, by counting: a window repeats when it stands in
    another block, in a block that occurs again, or at another place of its block."""
    w = blocks.mapInArrow(_windows(length), f"a long, h long, f long, n long, offset long, _id {id_type}, _th int, start long")
    again = w.groupBy("a", "h").agg(F.min("f").alias("f0"), F.max("f").alias("f1"), F.max("n").alias("most"), F.min("offset").alias("o0"), F.max("offset").alias("o1")).where(
        "f0 != f1 or most > 1 or o0 != o1").select("a", "h")
    return w.where("n = 1").join(again, ["a", "h"]).select("_id", "_th", "start", (F.col("start") + length).alias("end"))


def merge(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of (start, end) spans; touching spans are one run."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    at = np.flatnonzero(new)
    return np.stack([spans[at, 0], reach[np.concatenate((at[1:] - 1, [len(spans) - 1]))]], axis=1)


def _cut(what):
    def run(batches):
        for batch in c.tidy(batches):
            raw, off = c.text_buffers(batch.column(1))
            found = batch.column(2)
            flat = found.flatten()
            at = np.concatenate(([0], np.cumsum(np.diff(found.offsets.to_numpy()) if found.null_count == 0 else [len(x) if x.is_valid else 0 for x in found])))
            se = np.stack([flat.field("start").to_numpy(), flat.field("end").to_numpy()], axis=1).astype(np.int64)
            valid = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            rows = []
            for i in range(batch.num_rows):
                text = raw[off[i]:off[i + 1]].tobytes()
                runs = merge(se[at[i]:at[i + 1]])
                kept, last = [], 0
                for x, y in runs.tolist():
                    kept.append(text[last:x])
                    last = y
                kept.append(text[last:])
                kept = b"".join(kept)
                rows.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(),
                             None if not valid[i] or what is None else kept if what == "bytes" else kept.decode("utf-8", "ignore")))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary() if what == "bytes" else pa.string()))]],
                                             names=["_row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200,
                   columns: list[str] | None = None, kept: str | None = "bytes", memory: int = MEMORY) -> DataFrame:
    """Per input row its ``columns`` (default: the id), ``n_bytes``, ``n_removed``, ``n_spans``,
    ``kept_sha256`` and ``kept``: the bytes left, or with ``kept="text"`` the text they make without
    the rests of characters that were cut through (not with ``kept=None``).

    Removed is each byte covered by a string of ``length`` bytes that also starts elsewhere, in
    the same row or another; repeated rows so remove one another, an id that comes with several
    texts is several rows, and null ids are ids like others. Null texts count as empty (``kept``
    is null). Other columns are not read; an empty table gives no rows. A text may be as long as
    an Arrow batch may be (2 GB): it is read in one piece, at up to about 60 bytes per byte.

    A sort's queues go to disk beyond ``memory`` bytes."""
    if not 8 <= length <= 800:
        raise ValueError("length must be from 8 to 800")
    columns = [id_col] if columns is None else columns
    id_type = docs.schema[id_col].dataType.simpleString()
    row = F.struct(*[docs[x].alias(f"c{k}") for k, x in enumerate(columns)])
    rows = docs.select(F.col(id_col).alias("_id"), F.hash(text_col).alias("_th"), F.col(text_col).alias("_text"), row.alias("_row"))
    found = rows.select("_id", "_th", "_text").where(F.octet_length("_text") >= length).mapInArrow(
        _anchor_rows(length), f"_id {id_type}, _th int, a long, f long, at long, m long")
    same = Window.partitionBy("a", "f")
    group = Window.partitionBy("a")
    found = c.stage(found.repartition("a").select("*", F.sum("m").over(same).alias("n"))
                    .select("*", (F.min("f").over(group) != F.max("f").over(group)).alias("open"), (F.count("*").over(group) > HOT_BLOCKS).alias("hot"))
                    .where("n > 1 or open or m < 0").select("_id", "_th", "a", "f", "at", "m", "n", "open", "hot"))
    first = F.when(F.col("m") < 0, F.col("at")).otherwise(F.floor(F.col("at") / 1024))
    size = F.when(F.col("m") < 0, -F.col("m")).otherwise(F.col("at") % 1024 + length)
    settled = found.where("n > 1 or m < 0").select("_id", "_th", first.alias("start"), (first + size).alias("end"))
    on = lambda x, y: x["_id"].eqNullSafe(y["_id"]) & (x["_th"] == y["_th"])

    def blocks(which: str) -> DataFrame:
        """The blocks to compare. The joins here and below take the same columns of the texts, so
        they share one shuffle."""
        asked = found.where(f"open and m > 0 and {which}").groupBy("_id", "_th").agg(F.collect_list(F.struct("a", "f", "n", "at")).alias("asked"))
        return rows.join(asked, on(rows, asked)).select(rows["_id"], rows["_th"], "_text", "asked", "_row").mapInArrow(
            _fetch(length), f"_id {id_type}, _th int, a long, f long, n long, at long, block binary")

    shards = blocks("not hot").repartition("a").sortWithinPartitions("a", "f")
    spans = settled.unionByName(shards.mapInArrow(_sort_shards(length, memory), f"_id {id_type}, _th int, start long, end long"))
    if found.where("hot and open").limit(1).count():
        spans = spans.unionByName(_count_windows(blocks("hot"), length, id_type))
    spans = spans.groupBy("_id", "_th").agg(F.collect_set(F.struct("start", "end")).alias("_spans"))
    row_type = rows.schema["_row"].dataType.simpleString()
    out = rows.join(spans, on(rows, spans), "left").select("_row", "_text", F.coalesce("_spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("_spans")).mapInArrow(
        _cut(kept), f"_row {row_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept {'binary' if kept == 'bytes' else 'string'}")
    return out.select(*[F.col(f"_row.c{k}").alias(x) for k, x in enumerate(columns)], "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if kept else []))
