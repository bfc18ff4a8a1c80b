"""Profiling aggregations (H1-H14). Each profile is one aggregation pass; the single result row
is unpivoted with ``stack`` semantics (``unpivot``), so no per-column jobs are launched."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.missing import number, present
from riskweave.operators.quantiles import exact_quantiles
from riskweave.operators.rank import maybe_broadcast


def _one_row_long(df: DataFrame, exprs: dict, value_name: str, value_type: str) -> DataFrame:
    row = df.agg(*[e.cast(value_type).alias(k) for k, e in exprs.items()])
    return row.unpivot([], list(exprs), "column_name", value_name)


def null_counts(df: DataFrame) -> DataFrame:
    """H1: missing count per column (NULL, and NaN for floating columns)."""
    exprs = {c: F.count_if(~present(c, t)) for c, t in df.dtypes}
    return _one_row_long(df, exprs, "n_missing", "long")


def null_fraction(df: DataFrame, top: int = 20) -> DataFrame:
    """H2: missing fraction per column (NULL or NaN), highest first, top n (a top-k report)."""
    exprs = {c: F.avg((~present(c, t)).cast("double")) for c, t in df.dtypes}
    return (_one_row_long(df, exprs, "fraction", "double")
            .orderBy(F.desc("fraction"), F.asc("column_name")).limit(top))


def nunique(df: DataFrame, cols: Sequence[str], top: int = 50) -> DataFrame:
    """H5: distinct non-missing values per column, highest first, top n. Long form plus
    map-side distinct, so many columns cost one shuffle of distinct pairs."""
    pairs = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                                  F.col(c).cast("string").alias("v")) for c in cols])))
    return (pairs.where(F.col("v").isNotNull()).distinct()
            .groupBy("column_name").agg(F.count(F.lit(1)).alias("n_unique"))
            .orderBy(F.desc("n_unique"), F.asc("column_name")).limit(top))


def table_info(df: DataFrame) -> DataFrame:
    """One row per column with type, non-null count and the table's row count."""
    types = dict(df.dtypes)
    exprs = {c: F.count_if(present(c, types[c])) for c in df.columns}
    agg = df.agg(F.count(F.lit(1)).alias("_n"), *[e.alias(c) for c, e in exprs.items()])
    long = agg.unpivot(["_n"], list(exprs), "column_name", "non_null")
    tmap = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.lit(types[c]))])
    return long.select("column_name", tmap[F.col("column_name")].alias("dtype"),
                       F.col("non_null").cast("long").alias("non_null"), F.col("_n").cast("long").alias("n_rows"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """H3: count per value, missing dropped, highest first."""
    return (df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value"))
            .agg(F.count(F.lit(1)).alias("n")))


def value_share(df: DataFrame, col: str) -> DataFrame:
    """H4: share per value. The total is a scalar aggregate, not a global window."""
    vc = value_counts(df, col)
    total = vc.select(F.sum("n").cast("double")).scalar()
    return vc.select("value", (F.col("n") / total).alias("share"))


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """All ``bins`` equal-width bins over [min, max], empty ones too; the max falls into the
    last bin. A column with one value has all its rows in bin 0; one without values has no bins."""
    x = number(F.col(col))
    mn = df.select(F.min(x)).scalar()                 # scalar subqueries, evaluated in-plan
    mx = df.select(F.max(x)).scalar()
    width = F.when(mx > mn, (mx - mn) / F.lit(float(bins))).otherwise(F.lit(1.0))
    b = F.when(mx == mn, F.lit(0)).otherwise(
        F.least(F.floor((x - mn) / (mx - mn) * F.lit(float(bins))), F.lit(bins - 1))).cast("int")
    counts = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (all_bins.join(counts, "bin", "left").where(mn.isNotNull())
            .select("bin", (mn + F.col("bin") * width).alias("lo"),
                    (mn + (F.col("bin") + 1) * width).alias("hi"), F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def box_stats(df: DataFrame, group_col: str, value_col: str) -> DataFrame:
    """Quartiles (linear interpolation), 1.5 IQR whiskers at the most extreme data points
    inside the fences, and the outlier count, per group."""
    q = exact_quantiles(df, [group_col], value_col, [0.25, 0.5, 0.75])
    wide = (q.groupBy(group_col).pivot("prob", [0.25, 0.5, 0.75]).agg(F.first("value"))
            .toDF(group_col, "q1", "median", "q3"))
    fences = maybe_broadcast(wide.select(
        "*", (F.col("q3") - F.col("q1")).alias("iqr"),
        (F.col("q1") - F.lit(1.5) * (F.col("q3") - F.col("q1"))).alias("_lo"),
        (F.col("q3") + F.lit(1.5) * (F.col("q3") - F.col("q1"))).alias("_hi")))
    v = F.col(value_col).cast("double")
    inside = (v >= F.col("_lo")) & (v <= F.col("_hi"))
    agg = (df.join(fences, group_col, "inner")
           .groupBy(group_col, "q1", "median", "q3", "iqr")
           .agg(F.min(F.when(inside, v)).alias("whisker_lo"), F.max(F.when(inside, v)).alias("whisker_hi"),
                F.count_if(~inside).alias("n_outliers"), F.count(v).alias("n")))
    return agg
