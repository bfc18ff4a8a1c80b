"""Sparse entries and ML vectors from arrays of cells and hashed pairs, an Arrow batch at a time.

The cells of a row (one per input column) are an array built by compiled column expressions, its
(bucket, sign) pairs come from the distinct values of a batch's text columns; here a batch of them is filtered, summed per bucket and merged with NumPy, whatever
the number of categories and buckets. Vectors leave as the struct that Spark ML stores them in.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.functions.hashing import MISSING_TOKEN


def flat(a: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """The row of every element of a list array (null rows have none), and the elements."""
    lengths = np.asarray(a.value_lengths().fill_null(0))
    return np.repeat(np.arange(len(a)), lengths), a.flatten()


def summed(a: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, buckets and sums of the signs of a batch's pairs, in order, exact zeros left out."""
    rows, e = flat(a)
    bucket, sign = np.asarray(e.field("bucket")).astype(np.int64), np.asarray(e.field("sign"))
    width = int(bucket.max()) + 1 if len(bucket) else 1
    key = rows * width + bucket
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    total = np.add.reduceat(sign[order], first) if len(first) else np.zeros(0)
    first = first[total != 0.0]
    return key[first] // width, key[first] % width, total[total != 0.0]


def value_pairs(name: str, values: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of a column's values (UTF-8), by ``hash_bucket`` and ``hash_sign``."""
    hashes = [hashlib.md5(name.encode() + b"=" + v).digest() for v in values]
    first = np.array([int.from_bytes(h[:4], "big") for h in hashes], np.int64)
    return first % n, np.array([-1.0 if h[4] >> 4 & 1 else 1.0 for h in hashes])


def hash_pairs(cols: Sequence[str], n: int) -> Column:
    names, missing = list(cols), MISSING_TOKEN.encode()

    def pairs(*a: pa.Array) -> pa.Array:
        bucket, sign = np.empty((len(a[0]), len(a)), np.int32), np.empty((len(a[0]), len(a)))
        for j, (name, x) in enumerate(zip(names, a)):
            d = x.dictionary_encode()
            b, s = value_pairs(name, [*d.dictionary.cast(pa.binary()).to_pylist(), missing], n)
            at = np.asarray(d.indices.fill_null(len(d.dictionary)))
            bucket[:, j], sign[:, j] = b[at], s[at]
        e = pa.StructArray.from_arrays([pa.array(bucket.ravel()), pa.array(sign.ravel())], names=["bucket", "sign"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(a[0]) + 1) * len(a), pa.int32()), e)
    pairs.__annotations__ = {"a": pa.Array, "return": pa.Array}
    return _udf(pairs, "array<struct<bucket:int,sign:double>>")(*[F.col(c).cast("string") for c in names])


def offsets(rows: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]), pa.int32())


def merged(cells: pa.Array | None, pairs: pa.Array | None, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, positions and values of the entries: cells with a place and a value other than zero, then
    the sums, whose places start at ``at``."""
    rows, idx, val = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if cells is not None:
        rows, e = flat(cells)
        i, v = e.field("idx"), e.field("value")
        there = np.asarray(i.is_valid()) & np.asarray(v.is_valid())
        idx, val = np.asarray(i.fill_null(0)).astype(np.int64), np.asarray(v.fill_null(0.0))
        there &= val != 0.0
        rows, idx, val = rows[there], idx[there], val[there]
    if pairs is not None:
        more, bucket, total = summed(pairs)
        rows, idx, val = np.concatenate([rows, more]), np.concatenate([idx, bucket + at]), np.concatenate([val, total])
        order = np.argsort(rows, kind="stable")
        rows, idx, val = rows[order], idx[order], val[order]
    return rows, idx, val


def _udf(fn, returns) -> object:
    # pickled by value, as in treeshap: executors need no copy of this library
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return F.arrow_udf(fn, returns)


def signed_sums(pairs: Column) -> Column:
    def sums(a: pa.Array) -> pa.Array:
        rows, bucket, total = summed(a)
        e = pa.StructArray.from_arrays([pa.array(bucket, pa.int32()), pa.array(total)], names=["bucket", "value"])
        return pa.ListArray.from_arrays(offsets(rows, len(a)), e)
    return _udf(sums, "array<struct<bucket:int,value:double>>")(pairs)


def _split(cells: Column | None, pairs: Column | None):
    """The columns that are there, and how a batch of them is read as (cells, pairs)."""
    args = [c for c in (cells, pairs) if c is not None]
    has_cells, has_pairs = cells is not None, pairs is not None
    return args, lambda a: (a[0] if has_cells else None, a[-1] if has_pairs else None)


def entries(cells: Column | None, pairs: Column | None, at: int) -> Column:
    """array<struct<idx:int, value:double>> in ascending order of idx."""
    args, read = _split(cells, pairs)

    def fn(*a: pa.Array) -> pa.Array:
        rows, idx, val = merged(*read(a), at)
        e = pa.StructArray.from_arrays([pa.array(idx, pa.int32()), pa.array(val)], names=["idx", "value"])
        return pa.ListArray.from_arrays(offsets(rows, len(a[0])), e)
    fn.__annotations__ = {"a": pa.Array, "return": pa.Array}
    return _udf(fn, "array<struct<idx:int,value:double>>")(*args)


def vector(cells: Column | None, pairs: Column | None, at: int, size: int) -> Column:
    """Sparse ML vector of ``size``."""
    args, read = _split(cells, pairs)

    def fn(*a: pa.Array) -> pa.Array:
        rows, idx, val = merged(*read(a), at)
        n, off = len(a[0]), offsets(rows, len(a[0]))
        return pa.StructArray.from_arrays(
            [pa.array(np.zeros(n), pa.int8()), pa.array(np.full(n, size), pa.int32()),
             pa.ListArray.from_arrays(off, pa.array(idx, pa.int32())), pa.ListArray.from_arrays(off, pa.array(val))],
            names=["type", "size", "indices", "values"])
    fn.__annotations__ = {"a": pa.Array, "return": pa.Array}
    return _udf(fn, VectorUDT())(*args)
