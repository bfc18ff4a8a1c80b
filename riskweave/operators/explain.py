"""Additive attributions in long form ``(id, [model,] feature_idx, phi)``.

Linear SHAP needs only column arithmetic; stacking, global importance and waterfalls are
joins against tiny coefficient / name tables plus aggregations or per-id windows (each id has
one row per feature, so those windows are small and evenly spread).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.rank import maybe_broadcast


def feature_means(x: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    row = x.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def linear_shap(x: DataFrame, cols: Sequence[str], coefs: dict[str, Sequence[float]],
                id_col: str = "id", means: dict[str, float] | None = None) -> DataFrame:
    """phi_j = coef_j * (x_j - mean_j) for each member's coefficient vector, long form
    (id, model, feature_idx, value, phi). One narrow projection + a generator; means are a
    single aggregation."""
    means = means or feature_means(x, cols)
    rows = []
    for m, cs in coefs.items():
        for j, c in enumerate(cols):
            rows.append(F.struct(F.lit(m).alias("model"), F.lit(j).alias("feature_idx"),
                                 F.col(c).cast("double").alias("value"),
                                 (F.lit(float(cs[j])) * (F.col(c).cast("double") - F.lit(means[c]))).alias("phi")))
    return x.select(id_col, F.inline(F.array(*rows)))


def base_value(cols: Sequence[str], coefs: Sequence[float], means: dict[str, float],
               intercept: float = 0.0) -> float:
    """Expected margin of a linear member: intercept + sum coef_j * mean_j."""
    return float(intercept + sum(float(c) * float(means[k]) for c, k in zip(coefs, cols)))


def mean_abs(attr: DataFrame, keys: Sequence[str] = ("feature_idx",)) -> DataFrame:
    """Mean |phi| per feature (map-side partial aggregation)."""
    return attr.groupBy(*keys).agg(F.avg(F.abs("phi")).alias("mean_abs"))


def mean_abs_wide(wide: DataFrame, phi_col: str = "phi") -> DataFrame:
    """H9/P3 from one array of attributions per row: one vector summary (L1 norm and count, combined
    map-side) in place of a row per feature."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    s = wide.select(Summarizer.metrics("normL1", "count").summary(array_to_vector(phi_col)).alias("s"))
    return (s.select(F.posexplode(vector_to_array("s.normL1")).alias("feature_idx", "l1"), F.col("s.count").alias("n"))
            .select("feature_idx", (F.col("l1") / F.col("n")).alias("mean_abs")))


def name_features(ranked: DataFrame, lineage: DataFrame, idx_col: str = "feature_idx") -> DataFrame:
    """B14/J-d: ``f{i}`` and the lineage name via a left join on the index."""
    lin = maybe_broadcast(lineage.select(F.col("idx").alias(idx_col), F.col("name").alias("feature_name")))
    return (ranked.join(lin, idx_col, "left")
            .withColumn("feature", F.concat(F.lit("f"), F.col(idx_col).cast("string"))))


def ranked_importance(attr: DataFrame, lineage: DataFrame) -> DataFrame:
    """Rank (1 = largest mean |phi|, index breaks ties), f{i}, name, mean_abs. The rank
    runs over one row per feature, a tiny table."""
    return rank_features(mean_abs(attr), lineage)


def rank_features(m: DataFrame, lineage: DataFrame) -> DataFrame:
    """Ranks and names of (feature_idx, mean_abs) rows."""
    w = Window.orderBy(F.desc("mean_abs"), F.asc("feature_idx"))
    return name_features(m, lineage).withColumn("rank", F.row_number().over(w))


def stacked(attr: DataFrame, meta_coefs: dict[str, float], id_col: str = "id") -> DataFrame:
    """Sum over members of meta coefficient x member phi, per (id, feature). Every member
    present in the coefficient table takes part (none is skipped)."""
    spark = attr.sparkSession
    coef = spark.createDataFrame([(m, float(c)) for m, c in meta_coefs.items()], "model string, coef double")
    return (attr.join(maybe_broadcast(coef, bound=len(meta_coefs)), "model", "inner")
            .groupBy(id_col, "feature_idx").agg(F.sum(F.col("coef") * F.col("phi")).alias("phi")))


def waterfall(attr: DataFrame, base: float, id_col: str = "id") -> DataFrame:
    """P5: per id, features ordered by |phi| (largest first, index breaks ties) with the
    running total starting at the base value; the last step equals the explained output."""
    w = Window.partitionBy(id_col).orderBy(F.desc(F.abs("phi")), F.asc("feature_idx"))
    wc = w.rowsBetween(Window.unboundedPreceding, 0)
    return attr.select(id_col, F.row_number().over(w).alias("step"), "feature_idx", "phi",
                       (F.lit(base) + F.sum("phi").over(wc)).alias("running"))
