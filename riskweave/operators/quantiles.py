"""Exact quantiles (linear interpolation, like ``quantile_cont`` / pandas median) at scale.

``percentile()`` merges a value->count map of *all* distinct values in one final task. Here:
values collapse to (group, value, count) cells with map-side combine; the cumulative count per
cell comes from the two-level prefix sum; the cells that hold ranks floor(h) and ceil(h),
h = (n - 1) * p, are picked with an equi-join on the group against a tiny targets table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.rank import materialize, maybe_broadcast, running_totals


def exact_quantiles(df: DataFrame, group_cols: Sequence[str], value_col: str,
                    probs: Sequence[float], n_groups: int | None = None) -> DataFrame:
    """Rows (group..., prob, value); groups with no non-null value are absent. ``n_groups`` (when
    the caller knows it, e.g. the number of columns) bounds the targets table for a broadcast."""
    keys = list(group_cols) or ["_g"]
    if not group_cols:
        n_groups = 1
    src = df if group_cols else df.withColumn("_g", F.lit(0))
    cells = (src.where(F.col(value_col).isNotNull() & ~F.isnan(F.col(value_col).cast("double")))
             .groupBy(*keys, F.col(value_col).cast("double").alias("_v"))
             .agg(F.count(F.lit(1)).alias("_c")))
    cells = materialize(cells)
    cum = running_totals(cells, keys, ["_v"], ["_c"], prefix="_cum", inclusive=True, materialized=True)
    prob_arr = F.array(*[F.lit(float(p)) for p in probs])
    targets = (cells.groupBy(*keys).agg(F.sum("_c").alias("_n"))
               .select(*keys, F.explode(prob_arr).alias("prob"), "_n")
               .withColumn("_h", (F.col("_n") - 1) * F.col("prob"))
               .withColumn("_lo", F.floor("_h").cast("long"))
               .withColumn("_hi", F.ceil("_h").cast("long")))
    targets = maybe_broadcast(targets, bound=n_groups * len(probs) if n_groups else None)
    # value v covers 0-based ranks [cum - c, cum - 1]
    j = cum.join(targets, keys, "inner").where(
        ((F.col("_lo") >= F.col("_cum_c") - F.col("_c")) & (F.col("_lo") < F.col("_cum_c"))) |
        ((F.col("_hi") >= F.col("_cum_c") - F.col("_c")) & (F.col("_hi") < F.col("_cum_c"))))
    hit_lo = (F.col("_lo") >= F.col("_cum_c") - F.col("_c")) & (F.col("_lo") < F.col("_cum_c"))
    hit_hi = (F.col("_hi") >= F.col("_cum_c") - F.col("_c")) & (F.col("_hi") < F.col("_cum_c"))
    out = (j.groupBy(*keys, "prob")
           .agg(F.max(F.when(hit_lo, F.col("_v"))).alias("_vlo"),
                F.max(F.when(hit_hi, F.col("_v"))).alias("_vhi"),
                F.first("_h").alias("_h"), F.first("_lo").alias("_lo"))
           .select(*keys, "prob",
                   (F.col("_vlo") + (F.col("_h") - F.col("_lo")) * (F.col("_vhi") - F.col("_vlo"))).alias("value")))
    return out if group_cols else out.drop("_g")


def long_form(df: DataFrame, id_cols: Sequence[str], value_cols: Sequence[str],
              name_col: str = "column_name", value_col: str = "value") -> DataFrame:
    """Unpivot numeric columns to (ids..., column_name, value) with a double value."""
    return df.select(*id_cols, *[F.col(c).cast("double").alias(c) for c in value_cols]) \
             .unpivot(list(id_cols), list(value_cols), name_col, value_col)
