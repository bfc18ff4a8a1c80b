"""Classification metrics (I1-I6) as aggregations over predictions.

Every metric first collapses rows to distinct (group, score) cells with partial aggregation,
so the ordered part works on distinct scores, and the ordered part itself is the two-level
prefix sum of :mod:`riskweave.operators.rank` (no single-task global window).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.rank import materialize, maybe_broadcast, running_totals

EPS = 1e-15


def _score_cells(df: DataFrame, score_col: str, label_col: str, group_cols: Sequence[str],
                 resolution: float | None = None) -> DataFrame:
    """Distinct (group, score) cells with positive / negative counts (map-side combined).
    ``resolution`` (opt-in, approximate) floors scores to a grid first, which bounds the cells
    per group by 1/resolution however many rows or candidates are scored."""
    y = F.col(label_col).cast("long")
    s = F.col(score_col).cast("double")
    if resolution:
        s = F.floor(s / F.lit(resolution)) * F.lit(resolution)
    return (df.select(*group_cols, s.alias("_s"), y.alias("_y"))
            .groupBy(*group_cols, "_s")
            .agg(F.sum("_y").alias("pos"), F.sum(F.lit(1) - F.col("_y")).alias("neg")))


def roc_auc(df: DataFrame, score_col: str = "p", label_col: str = "target",
            group_cols: Sequence[str] = (), out_col: str = "auc",
            resolution: float | None = None) -> DataFrame:
    """Trapezoid ROC AUC (ties count one half) per group.

    AUC = sum_s pos(s) * (neg(below s) + neg(s)/2) / (P * N). Exact by default; with
    ``resolution`` scores closer than the grid count as ties (bounded cells, approximate).
    """
    return auc_of_cells(_score_cells(df, score_col, label_col, list(group_cols), resolution), group_cols, out_col)


#: Equal steps of [0, 1] that scores are dealt into before they are ordered.
SCORE_STEPS = 8192


def score_bucket(score: str = "_s") -> Column:
    """A first-level bucket that is monotone in the score: the step of [0, 1] it lies in, scores
    outside in the end steps. It needs no pass over the data; probabilities spread over it."""
    inside = F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0))
    return F.floor(inside * F.lit(float(SCORE_STEPS))).cast("int")


def auc_of_cells(cells: DataFrame, group_cols: Sequence[str] = (), out_col: str = "auc") -> DataFrame:
    """AUC per group from distinct (group, score ``_s``) cells with counts ``pos`` and ``neg``;
    null for a group of one class only."""
    group_cols = list(group_cols)
    ranked = running_totals(cells, group_cols, ["_s"], ["neg"], bucket=score_bucket(), prefix="below_", inclusive=False)
    return (ranked.groupBy(*group_cols)
            .agg(F.try_divide(F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / F.lit(2.0))),
                              F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias(out_col)))


def confusion(df: DataFrame, score_col: str = "p", label_col: str = "target",
              group_cols: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """Counts of (actual, predicted) with predicted = score > threshold (strict); the four
    cells are always present (zero when empty)."""
    group_cols = list(group_cols)
    counts = (df.select(*group_cols, F.col(label_col).cast("int").alias("actual"),
                        (F.col(score_col) > F.lit(threshold)).cast("int").alias("predicted"))
              .groupBy(*group_cols, "actual", "predicted").agg(F.count(F.lit(1)).alias("n")))
    cells = F.inline(F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"))
                               for a in (0, 1) for b in (0, 1)]))
    grid = df.select(*group_cols).distinct().select(*group_cols, cells) if group_cols else \
        df.sparkSession.range(1).select(cells)
    return (grid.join(counts, [*group_cols, "actual", "predicted"], "left")
            .select(*group_cols, "actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def pr_curve(df: DataFrame, score_col: str = "p", label_col: str = "target",
             group_cols: Sequence[str] = ()) -> DataFrame:
    """I4: one (precision, recall) point per distinct score used as threshold (score >= t),
    plus the closing point precision 1, recall 0 with a NULL threshold."""
    keys = list(group_cols) or ["_g"]
    src = df if group_cols else df.withColumn("_g", F.lit(0))
    cells = materialize(_score_cells(src, score_col, label_col, keys).withColumn("_desc", -F.col("_s")))
    cum = running_totals(cells, keys, ["_desc"], ["pos", "neg"], prefix="cum_", inclusive=True,
                         materialized=True)
    # one row per group: bounded by the number of groups, counted before broadcasting
    totals = maybe_broadcast(cells.groupBy(*keys).agg(F.sum("pos").alias("_P")))
    pts = cum.join(totals, keys, "inner").select(
        *keys, F.col("_s").alias("threshold"),
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        (F.col("cum_pos") / F.col("_P")).alias("recall"))
    end = totals.select(*keys, F.lit(None).cast("double").alias("threshold"),
                        F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    out = pts.unionByName(end)
    return out if group_cols else out.drop("_g")


def log_loss(df: DataFrame, score_col: str = "p", label_col: str = "target",
             group_cols: Sequence[str] = (), eps: float = EPS) -> DataFrame:
    """Mean negative log likelihood with probabilities clipped to [eps, 1-eps]."""
    p = F.least(F.greatest(F.col(score_col).cast("double"), F.lit(eps)), F.lit(1.0 - eps))
    y = F.col(label_col).cast("double")
    ll = y * F.log(p) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - p)
    return df.groupBy(*group_cols).agg((-F.avg(ll)).alias("log_loss"))


def learning_curve_best(curve: DataFrame, iter_col: str = "iter", loss_col: str = "loss",
                        group_cols: Sequence[str] = ()) -> DataFrame:
    """Best iteration (lowest loss, earliest on ties), its loss, last iteration and the
    number of rounds since the best (what an early-stopping wait compares against)."""
    return (curve.groupBy(*group_cols)
            .agg(F.min_by(F.struct(F.col(loss_col), F.col(iter_col)), F.struct(F.col(loss_col), F.col(iter_col))).alias("_b"),
                 F.max(iter_col).alias("last_iter"))
            .select(*group_cols, F.col("_b").getField(iter_col).cast("long").alias("best_iter"),
                    F.col("_b").getField(loss_col).alias("best_loss"),
                    F.col("last_iter").cast("long").alias("last_iter"),
                    (F.col("last_iter") - F.col("_b").getField(iter_col)).cast("long").alias("rounds_since_best")))


def waiting_point(curve: DataFrame, wait: int, iter_col: str = "iter", value_col: str = "auc", larger: bool = True,
                  group_cols: Sequence[str] = ()) -> DataFrame:
    """E5: where early stopping ends on a curve of consecutive iterations: the first iteration
    ``wait`` rounds after the last new best (the end of the curve where there is none), and the best
    until then. Equal values are no new best. The windows hold one row per iteration of a group."""
    groups = list(group_cols)
    v = F.col(value_col) if larger else -F.col(value_col)
    run = Window.partitionBy(*groups).orderBy(iter_col) if groups else Window.orderBy(iter_col)
    before = F.max("_v").over(run.rowsBetween(Window.unboundedPreceding, -1))
    steps = (curve.withColumn("_v", v).withColumn("_before", before)
             .withColumn("_best", F.max(F.when(F.col("_before").isNull() | (F.col("_v") > F.col("_before")), F.col(iter_col))).over(run)))
    stop = F.min(F.when(F.col(iter_col) - F.col("_best") >= wait, F.col(iter_col))).over(Window.partitionBy(*groups))
    seen = steps.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col(iter_col) <= F.col("_stop")))
    best = F.max("_best")
    return (seen.groupBy(*groups)
            .agg(best.cast("long").alias("best_iter"), (F.max("_v") if larger else -F.max("_v")).alias(f"best_{value_col}"),
                 F.max(iter_col).cast("long").alias("last_iter"), (F.max(iter_col) - best).cast("long").alias("rounds_since_best"),
                 F.max("_stop").isNotNull().alias("stopped")))


def metrics_table(preds: DataFrame, run_col: str = "model", fold_col: str = "fold") -> DataFrame:
    """A4: long metric records (run, metric, fold, value): per-fold and pooled AUC, pooled log
    loss and the mean of fold AUCs (fold = -1 marks pooled rows)."""
    from pyspark.sql import functions as G
    per_fold = roc_auc(preds, group_cols=[run_col, fold_col])
    pooled = roc_auc(preds, group_cols=[run_col])
    ll = log_loss(preds, group_cols=[run_col])
    rows = [
        per_fold.select(run_col, G.lit("auc").alias("metric"), G.col(fold_col).cast("int").alias("fold"),
                        G.col("auc").alias("value")),
        pooled.select(run_col, G.lit("oof_auc"), G.lit(-1), "auc"),
        per_fold.groupBy(run_col).agg(G.avg("auc").alias("v")).select(run_col, G.lit("cv_auc"), G.lit(-1), "v"),
        ll.select(run_col, G.lit("log_loss"), G.lit(-1), "log_loss"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.withColumnRenamed(run_col, "run")
