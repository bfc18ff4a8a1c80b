"""Counts and exact ranks of many candidate blends over one table, without a row per row and candidate.

A task reads its rows in chunks, scores a chunk with one candidate after another in NumPy and sends
on either counts per step of [0, 1] (``step_counts``) or the candidate's sorted scores of the two
classes, cut into ranges and packed (``ranked_pairs``), shuffled once: less than a double a score,
where there was a row of candidate, score and counts, shuffled twice. Candidate, group and range are a key,
so each range is ranked by itself and small totals per range give the AUC.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows scored at once in a task, and rows of a candidate's range that are ranked at once.
CHUNK_ROWS, RANGE_ROWS = 1 << 18, 1 << 19
#: Rows of the sample that ranges of a candidate are cut by, a range; results do not depend on it.
SAMPLE_PER_RANGE = 200
#: Groups whose step counts a task holds before it sends them on.
HELD_GROUPS = 64


def row_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= CHUNK_ROWS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def by_group(t: pa.Table, group_cols: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(key as a table of one row, its rows)."""
    if not group_cols:
        yield t.select([]), np.arange(t.num_rows)
        return
    rows = t.select(group_cols).append_column("_row", pa.array(np.arange(t.num_rows)))
    g = rows.group_by(group_cols, use_threads=False).aggregate([("_row", "list")])
    for i in range(g.num_rows):
        yield g.select(group_cols).slice(i, 1), np.asarray(g["_row_list"][i].values)


def member_matrix(t: pa.Table, models: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Scores of every member and the rows that lack one."""
    cols = [t[m].combine_chunks() for m in models]
    lacks = np.zeros(t.num_rows, bool)
    for c in cols:
        if c.null_count:
            lacks |= np.asarray(c.is_null())
    return [np.asarray(c.to_numpy(zero_copy_only=False), float) for c in cols], lacks


def blended(cols: list[np.ndarray], weights: Sequence[float]) -> np.ndarray:
    """The same sums in the same order as the column expression of a blend (0.0 for -0.0)."""
    s = cols[0] * weights[0]
    for c, w in zip(cols[1:], weights[1:]):
        s = s + c * w
    return s + 0.0


def keyed(keys: list[pa.Table], at: list[int], names: list[str], **cols: pa.Array) -> pa.RecordBatch:
    """Output rows: row i has the key ``keys[at[i]]``."""
    arrays = [pa.concat_tables(keys)[c].combine_chunks().take(pa.array(at, pa.int64())) for c in names] if names else []
    return pa.RecordBatch.from_arrays([*arrays, *cols.values()], names=[*names, *cols])


# ---------------------------------------------------------------- counts per step

def step_counts(rows: DataFrame, models: Sequence[str], weights: list[list[float]], group_cols: Sequence[str], steps: int) -> DataFrame:
    """group..., candidate, _step, pos, neg of every task: a score's step of [0, 1], scores outside in
    the end steps, a missing one in the first."""
    groups, models = list(group_cols), list(models)

    def out(held):
        keys = [k for k, _ in held.values()]
        for i, (_, n) in enumerate(held.values()):
            for lo in range(0, len(weights), 16):
                c, s = np.nonzero(n[lo:lo + 16].sum(axis=2))
                yield keyed(keys, [i] * len(c), groups, candidate=pa.array(c + lo, pa.int32()), _step=pa.array(s, pa.int32()),
                            pos=pa.array(n[c + lo, s, 1]), neg=pa.array(n[c + lo, s, 0]))

    def count(batches):
        held: dict = {}
        for t in row_chunks(batches):
            cols, lacks = member_matrix(t, models)
            y = t["_y"].to_numpy()
            for key, at in by_group(t, groups):
                name = tuple(key.to_pylist()[0].values()) if groups else ()
                if name not in held:
                    held[name] = (key, np.zeros((len(weights), steps + 1, 2), np.int64))
                n, mine, gap, label = held[name][1], [c[at] for c in cols], lacks[at], y[at]
                for i, w in enumerate(weights):
                    s = blended(mine, w)
                    s = np.where(gap, 0.0, np.where(np.isnan(s), 1.0, np.clip(s, 0.0, 1.0)))
                    n[i] += np.bincount(np.floor(s * steps).astype(np.int64) * 2 + label, minlength=2 * steps + 2).reshape(-1, 2)
            if len(held) >= HELD_GROUPS:
                yield from out(held)
                held = {}
        yield from out(held)

    return _map(rows, models, groups, count, "candidate int, _step int, pos long, neg long")


def _map(rows: DataFrame, models: list[str], groups: list[str], fn, schema: str) -> DataFrame:
    # pickled by value, as in treeshap: executors need no copy of this library
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    y = F.col("target").cast("long")
    src = rows.where(y.isNotNull()).select(*groups, y.alias("_y"), *[F.col(m).cast("double").alias(m) for m in models])
    keys = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in groups)
    return src.mapInArrow(fn, keys + schema)


# ---------------------------------------------------------------- exact ranks

def pack(v: np.ndarray) -> bytes:
    """Sorted doubles as differences of their ordered bit patterns, byte by byte, so that the
    shuffle's compression finds the leading zeros."""
    u = v.view(np.uint64)
    top = np.uint64(1 << 63)
    u = np.where(u & top, ~u, u | top)
    d = np.diff(u, prepend=np.uint64(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(b: bytes) -> np.ndarray:
    d = np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    u, top = np.cumsum(d, dtype=np.uint64), np.uint64(1 << 63)
    return np.where(u & top, u ^ top, ~u).view(np.float64)


def runs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each occurs."""
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
    return v[first], np.diff(first, append=len(v)).astype(np.int32)


def cuts_of(rows: DataFrame, models: Sequence[str], weights: list[list[float]], n: int) -> list[np.ndarray]:
    """Per candidate the scores between its ranges of about ``RANGE_ROWS`` rows, from a small sample as
    range partitioning takes one: only the balance of tasks depends on it."""
    ranges = min(4096, -(-n // RANGE_ROWS))
    if ranges <= 1:
        return [np.zeros(0)] * len(weights)
    part = rows.select(*[F.col(m).cast("double").alias(m) for m in models]).dropna()
    t = part.sample(min(1.0, ranges * SAMPLE_PER_RANGE / n), seed=11).toPandas()
    cols = [t[m].to_numpy() for m in models]
    at = np.arange(1, ranges) / ranges
    return [np.unique(np.quantile(blended(cols, w), at, method="lower")) if len(t) else np.zeros(0) for w in weights]


def ranked_pairs(rows: DataFrame, models: Sequence[str], weights: list[list[float]], group_cols: Sequence[str] = ()) -> DataFrame:
    """group..., candidate, _range, pos, neg, ranked, twice: per range of a candidate's scores its rows of
    each class, the positives with a score, and twice the pairs in it that are in order (equal
    scores count half). Rows without a score are range -1. ``rows`` is read three times."""
    groups, models = list(group_cols), list(models)
    cuts = cuts_of(rows, models, weights, rows.count())

    def split(batches):
        for t in row_chunks(batches):
            cols, lacks = member_matrix(t, models)
            y = t["_y"].to_numpy()
            some = bool(lacks.any())
            found = list(by_group(t, groups))
            keys = [k for k, _ in found]
            for g, (_, at) in enumerate(found):
                gap, label = lacks[at], y[at]
                sides = [at[(label == c) & ~gap] if some else at[label == c] for c in (1, 0)]
                sides = [[c[s] for c in cols] for s in sides]
                unscored = (int((label[gap] == 1).sum()), int((label[gap] == 0).sum())) if some else (0, 0)
                out: list[tuple] = []
                for i, w in enumerate(weights):
                    if some and sum(unscored):
                        out.append((i, -1, b"", b"", b"", b"", *unscored))
                    cells = []
                    for mine in sides:
                        v, n = runs(np.sort(blended(mine, w)))
                        ends = [0, *np.searchsorted(v, cuts[i], side="right").tolist(), len(v)]
                        cells.append((v, n, ends))
                    (pv, pn, pe), (nv, nn, ne) = cells
                    for r in range(len(cuts[i]) + 1):
                        a, b, c, d = pe[r], pe[r + 1], ne[r], ne[r + 1]
                        if a < b or c < d:
                            out.append((i, r, pack(pv[a:b]), pn[a:b].tobytes(), pack(nv[c:d]), nn[c:d].tobytes(), 0, 0))
                    if len(out) and (i % 8 == 7 or i + 1 == len(weights)):
                        x = list(zip(*out))
                        yield keyed(keys, [g] * len(out), groups, candidate=pa.array(x[0], pa.int32()), _range=pa.array(x[1], pa.int32()),
                                    pv=pa.array(x[2], pa.binary()), pn=pa.array(x[3], pa.binary()), nv=pa.array(x[4], pa.binary()),
                                    nn=pa.array(x[5], pa.binary()), p0=pa.array(x[6], pa.int64()), n0=pa.array(x[7], pa.int64()))
                        out = []

    packed = _map(rows, models, groups, split, "candidate int, _range int, pv binary, pn binary, nv binary, nn binary, p0 long, n0 long")
    names = [*groups, "candidate", "_range"]

    def rank(t: pa.Table) -> pa.Table:
        blob = lambda c: [b.as_py() for b in t[c]]
        nv = [unpack(b) for b in blob("nv")]
        nn = [np.frombuffer(b, np.int32) for b in blob("nn")]
        v, n = np.concatenate(nv), np.concatenate(nn).astype(np.int64)
        if len(n) and n.max() > 1:
            order = np.argsort(v, kind="stable")
            v, n = v[order], n[order]
        else:
            v.sort()
        below = np.concatenate([[0], np.cumsum(n)])
        twice, ranked = 0, 0
        for p, c in zip(blob("pv"), blob("pn")):
            p, c = unpack(p), np.frombuffer(c, np.int32).astype(np.int64)
            twice += int((c * (below[np.searchsorted(v, p, "left")] + below[np.searchsorted(v, p, "right")])).sum())
            ranked += int(c.sum())
        pos, neg = ranked + sum(t["p0"].to_pylist()), int(below[-1]) + sum(t["n0"].to_pylist())
        one = t.select(names).slice(0, 1)
        for name, x in (("pos", pos), ("neg", neg), ("ranked", ranked), ("twice", twice)):
            one = one.append_column(name, pa.array([x], pa.int64()))
        return one

    schema = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in groups)
    return packed.groupBy(*names).applyInArrow(rank, schema + "candidate int, _range int, pos long, neg long, ranked long, twice long")
