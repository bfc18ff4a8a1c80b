"""Seeded sampling without replacement (C1/C2) and positional slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.hashing import seeded_key


def sample_n(df: DataFrame, n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """min(n, rows) rows, reproducible and independent of partitioning: the n smallest
    md5('<seed>:<id>') keys. Planned as TakeOrderedAndProject (each task keeps n, then merge)."""
    return (df.withColumn("_sk", seeded_key(seed, F.col(id_col)))
            .orderBy("_sk", id_col).limit(n).drop("_sk"))


def sample_fraction(df: DataFrame, fraction: float, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Approximate-size keyed sample: a row is kept when its md5 key falls below the fraction
    (no sort, no shuffle; the same rows on every run and after recomputation)."""
    from riskweave.functions.hashing import md5_prefix_int
    key = md5_prefix_int(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 1, 8)
    return df.where(key < F.lit(int(fraction * 0xFFFFFFFF)))


def head(df: DataFrame, n: int, order_col: str = "id") -> DataFrame:
    """C4: first n rows by a key (a preview)."""
    return df.orderBy(order_col).limit(n)
