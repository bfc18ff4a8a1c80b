"""Two-level ordered prefix sums: the scale-safe replacement for global ordered windows.

``sum(x) over (partition by g order by s)`` puts a whole group into one task; with a binary
target (folds) or a single pooled metric (AUC) that is one or two tasks for the whole table.
Instead rows are first assigned a *range bucket* that is monotone in the order key:

1. bucket: either a caller-given monotone expression (e.g. a prefix of an md5 hex string),
   or ``Bucketizer`` over ``approxQuantile`` split points of the order key (bounded list on the
   driver, balanced buckets even when values cluster);
2. totals per (group, bucket) form a small table (groups x buckets rows) whose prefix sums
   over buckets are computed with a window over that small table;
3. the offsets are joined back (broadcast only below a checked row count) and the running sum
   inside each (group, bucket) uses an ordinary window, so each task holds one bucket.

The result equals the single-window form exactly (tests compare both).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Broadcast the offsets table only when it has at most this many rows (each row is a few longs).
BROADCAST_ROW_LIMIT = 2_000_000


def _bucket_count(df: DataFrame) -> int:
    """Several buckets per shuffle partition, so range buckets spread over all reducers."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(16, min(65536, 4 * parts))


def quantile_buckets(df: DataFrame, order_col: str, n_buckets: int | None = None,
                     rel_err: float | None = None, out_col: str = "_bucket") -> DataFrame:
    """Add a monotone bucket id from approximate quantiles of ``order_col`` (bounded split list;
    the rank error is kept below a quarter bucket so buckets stay balanced)."""
    n = n_buckets or _bucket_count(df)
    rel_err = rel_err if rel_err is not None else min(1e-3, 0.25 / n)
    probs = [i / n for i in range(1, n)]
    cuts = df.approxQuantile(order_col, probs, rel_err)
    splits = sorted({float(c) for c in cuts if c is not None and c == c})
    splits = [float("-inf")] + splits + [float("inf")]
    if len(splits) < 3:
        return df.withColumn(out_col, F.lit(0).cast("int"))
    tmp = f"{out_col}_d"
    b = Bucketizer(splits=splits, inputCol=order_col, outputCol=tmp, handleInvalid="keep")
    return b.transform(df).withColumn(out_col, F.col(tmp).cast("int")).drop(tmp)


def maybe_broadcast(small: DataFrame, bound: int | None = None,
                    limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast hint only when the caller proves a row bound (e.g. groups x probabilities).

    Without a bound no hint is given: adaptive execution materialises the small side first and
    turns the join into a broadcast join when its measured size is under
    ``spark.sql.adaptive.autoBroadcastJoinThreshold``; above it the shuffle join stays (and skew
    join splitting applies). No extra counting job is run either way."""
    return F.broadcast(small) if bound is not None and bound <= limit else small


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder: later passes read the written
    table (it survives executor loss) and the lineage above it is cut."""
    from riskweave.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def running_totals(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                   value_cols: Sequence[str], bucket: Column | None = None,
                   prefix: str = "cum_", inclusive: bool = True,
                   bucket_on: str | None = None, materialized: bool = False) -> DataFrame:
    """Add ``<prefix><v>`` = sum of v over rows of the same group ordered before (and, when
    ``inclusive``, including) the current row. ``order_cols`` must be a total order in the group.
    """
    group_cols, order_cols, value_cols = list(group_cols), list(order_cols), list(value_cols)
    if bucket is None:
        # the split points need one pass over the input before the main job: both passes read
        # one checkpointed copy instead of recomputing the input
        if not materialized:
            df = materialize(df)
        withb = quantile_buckets(df, bucket_on or order_cols[0])
    else:
        withb = df.withColumn("_bucket", bucket)

    totals = withb.groupBy(*group_cols, "_bucket").agg(
        *[F.sum(v).alias(f"_bt_{v}") for v in value_cols])
    wb = Window.partitionBy(*group_cols).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group_cols, "_bucket",
        *[F.coalesce(F.sum(f"_bt_{v}").over(wb), F.lit(0)).alias(f"_off_{v}") for v in value_cols])
    offsets = maybe_broadcast(offsets)     # groups x buckets rows: AQE broadcasts it when small

    joined = withb.join(offsets, on=[*group_cols, "_bucket"], how="left")
    end = 0 if inclusive else -1
    wr = (Window.partitionBy(*group_cols, "_bucket").orderBy(*order_cols)
          .rowsBetween(Window.unboundedPreceding, end))
    out = joined.select(
        *[c for c in withb.columns if c != "_bucket"],
        *[(F.coalesce(F.sum(v).over(wr), F.lit(0)) + F.col(f"_off_{v}")).alias(f"{prefix}{v}")
          for v in value_cols])
    return out


def running_totals_simple(df: DataFrame, group_cols, order_cols, value_cols, prefix="cum_",
                          inclusive=True) -> DataFrame:
    """Single-window reference form, used by tests as the check for ``running_totals``."""
    end = 0 if inclusive else -1
    w = (Window.partitionBy(*group_cols).orderBy(*order_cols)
         .rowsBetween(Window.unboundedPreceding, end))
    return df.select("*", *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"{prefix}{v}")
                            for v in value_cols])


def dense_row_number(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                     bucket: Column | None = None, out_col: str = "rn",
                     bucket_on: str | None = None) -> DataFrame:
    """``row_number() over (partition by g order by o)`` (1-based) computed with two levels."""
    tmp = df.withColumn("_one", F.lit(1).cast("long"))
    out = running_totals(tmp, group_cols, order_cols, ["_one"], bucket=bucket, prefix="_rn",
                         bucket_on=bucket_on)
    return out.withColumnRenamed("_rn_one", out_col).drop("_one")


def range_buckets(df: DataFrame, order_col: str, out_col: str = "_bucket") -> DataFrame:
    """Range-partition on the whole key and keep each row's partition number: a bucket that is
    monotone in the key for any type, long shared prefixes included. The result is checkpointed,
    so the numbers stay as they were dealt."""
    parts = _bucket_count(df)
    return materialize(df.repartitionByRange(parts, order_col).withColumn(out_col, F.spark_partition_id()))
