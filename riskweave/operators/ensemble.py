"""Ensembling over the long prediction table ``preds(id, model, fold, target, p)``.

Members are equi-joined on id (never aligned by position); weights and candidates are tiny
driver-side lists turned into literals or broadcast tables.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.blend_auc import ranked_pairs, step_counts
from riskweave.operators.metrics import roc_auc
from riskweave.operators.rank import materialize, maybe_broadcast


def auc_weights(preds: DataFrame, model_col: str = "model") -> DataFrame:
    """G1: pooled AUC per member and weight = auc / sum(auc) (a few rows)."""
    a = roc_auc(preds, group_cols=[model_col])
    total = a.select(F.sum("auc")).scalar()          # scalar subquery: no driver round trip
    return a.select(model_col, "auc", (F.col("auc") / total).alias("weight"))


def blend_weighted(preds: DataFrame, weights: DataFrame, id_col: str = "id",
                   model_col: str = "model") -> DataFrame:
    """Sum over members of weight x p per id (one partial-agg shuffle on id). The weights
    table has one row per member; adaptive execution broadcasts it from its measured size.
    An id without exactly one prediction of every member raises."""
    w = maybe_broadcast(weights.select(model_col, "weight"))
    n = weights.select(F.count(F.lit(1))).scalar()
    blended = (preds.join(w, model_col, "inner").groupBy(id_col)
               .agg(F.sum(F.col("weight") * F.col("p")).alias("_p"), F.count("p").alias("_n"), F.count(F.lit(1)).alias("_rows")))
    wrong = (F.col("_n") != n) | (F.col("_rows") != n)
    return blended.select(id_col, F.when(wrong, _incomplete(F.col(id_col))).otherwise(F.col("_p")).alias("p"))


def _incomplete(id_: Column) -> Column:
    return F.raise_error(F.concat(F.lit("blend: a member's prediction is missing or repeated for id "),
                                  F.coalesce(id_.cast("string"), F.lit("NULL")))).cast("double")


def normalise(weights: dict[str, float]) -> dict[str, float]:
    """W / sum(w); an all-zero vector becomes uniform instead of dividing by zero."""
    s = float(sum(weights.values()))
    if s == 0.0:
        return {k: 1.0 / len(weights) for k in weights}
    return {k: float(v) / s for k, v in weights.items()}


def blend_fixed(members: dict[str, DataFrame], weights: dict[str, float], id_col: str = "id",
                normalise_weights: bool = False, fill_missing: float | None = None) -> DataFrame:
    """Keyed full joins of member submissions (id, p) and a weighted sum. An id that a member
    lacks raises, unless ``fill_missing`` stands in for its prediction (G7)."""
    require_members(len(weights), 1, "blending")
    if normalise_weights:
        weights = normalise(weights)
    names = list(weights)
    out = None
    for m in names:
        d = members[m].select(id_col, F.col("p").alias(f"_p_{m}"))
        out = d if out is None else out.join(d, id_col, "full")
    if fill_missing is not None:
        out = out.fillna(fill_missing, subset=[f"_p_{m}" for m in names])
    expr, missing = None, None
    for m in names:
        term, gap = F.lit(float(weights[m])) * F.col(f"_p_{m}"), F.col(f"_p_{m}").isNull()
        expr, missing = (term, gap) if expr is None else (expr + term, missing | gap)
    return out.select(id_col, F.when(missing, _incomplete(F.col(id_col))).otherwise(expr).alias("p"))


def stack_matrix(preds: DataFrame, models: Sequence[str], id_col: str = "id",
                 keep: Sequence[str] = ("fold", "target"), fill_missing: float | None = None) -> DataFrame:
    """One column per member (explicit list, so no extra distinct job); optional fill."""
    # one aggregation of a buffer per row; pivot() groups by (id, model) first and holds a cell for each
    out = preds.groupBy(id_col, *keep).agg(*[F.max(F.when(F.col("model") == m, F.col("p"))).alias(m) for m in models])
    if fill_missing is not None:
        out = out.fillna(fill_missing, subset=list(models))
    return out


def require_members(n: int, minimum: int, what: str) -> None:
    """Stacking needs at least two members, blending at least one."""
    if n < minimum:
        raise ValueError(f"{what} needs at least {minimum} member(s), got {n}")


def candidates(models: Sequence[str], n: int, seed: int = 42) -> list[dict[str, float]]:
    """Seeded weight draws in [0, 1) per member, normalised (G4/G5, F9 random search)."""
    rng = np.random.default_rng(seed)
    draws = rng.uniform(0.0, 1.0, size=(n, len(models)))
    return [normalise({m: float(w) for m, w in zip(models, row)}) for row in draws]


def candidate_auc(wide: DataFrame, models: Sequence[str], cands: list[dict[str, float]],
                  group_cols: Sequence[str] = (), materialized: bool = False) -> DataFrame:
    """group..., candidate, auc of every candidate weight vector, exactly.

    The rows are written once (``materialized``: they are already) and each task sends on every
    candidate's sorted scores, packed and cut into ranges (``blend_auc.ranked_pairs``); the window
    below is over one row per group, candidate and range."""
    keys = [*group_cols, "candidate"]
    rows = wide if materialized else materialize(wide.select(*group_cols, "target", *models))
    parts = ranked_pairs(rows, models, [[float(c[m]) for m in models] for c in cands], group_cols)
    below = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    return parts.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("ranked").cast("double") * F.col("_below") + F.col("twice") / F.lit(2.0)),
                     F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"))


def blend_search(wide: DataFrame, models: Sequence[str], cands: list[dict[str, float]], materialized: bool = False) -> DataFrame:
    """AUC of every candidate blend; ``best`` marks the highest AUC (lowest candidate id on
    ties)."""
    aucs = candidate_auc(wide, models, cands, materialized=materialized)
    w = Window.orderBy(F.desc("auc"), F.asc("candidate"))   # over len(cands) rows only
    wt = wide.sparkSession.createDataFrame(
        [(i, *[c[m] for m in models]) for i, c in enumerate(cands)],
        "candidate int, " + ", ".join(f"w_{m} double" for m in models))
    return (aucs.join(maybe_broadcast(wt, bound=len(cands)), "candidate")
            .withColumn("best", F.row_number().over(w) == 1))


#: Equal steps of [0, 1] that the first look at a search counts scores in.
COARSE_STEPS = 1024


def _blend(weights: dict[str, float], models: Sequence[str]) -> Column:
    expr = None
    for m in models:
        term = F.lit(float(weights[m])) * F.col(m)
        expr = term if expr is None else expr + term
    return expr


def auc_bounds(wide: DataFrame, models: Sequence[str], cands: list[dict[str, float]], group_cols: Sequence[str] = (),
               steps: int = COARSE_STEPS) -> DataFrame:
    """group..., candidate, lower, upper: bounds of every candidate's AUC from counts per step.

    Rows in different steps are ordered as their scores are; a pair within a step counts 0 in the
    lower and 1 in the upper bound. One pass over the rows, counted in NumPy a chunk at a time, and
    what is shuffled is at most candidates x steps partial counts of each task, however many rows or
    distinct scores there are."""
    keys = [*group_cols, "candidate"]
    counts = (step_counts(wide, models, [[float(c[m]) for m in models] for c in cands], group_cols, steps)
              .groupBy(*keys, "_step").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    below = Window.partitionBy(*keys).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)   # over at most steps + 1 rows
    counts = counts.withColumn("_below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return counts.groupBy(*keys).agg((F.sum(F.col("pos") * F.col("_below")) / pairs).alias("lower"),
                                     (F.sum(F.col("pos") * (F.col("_below") + F.col("neg"))) / pairs).alias("upper"))


def refined_search(wide: DataFrame, models: Sequence[str], cands: list[dict[str, float]], group_cols: Sequence[str] = (),
                   steps: int = COARSE_STEPS, materialized: bool = False) -> DataFrame:
    """candidate, lower, upper, auc, best: a search for the best candidate (by AUC, over groups by mean
    AUC; lowest id on ties) that ranks only those candidates exactly whose upper bound reaches the
    best lower bound; of the others ``auc`` is null. The bounds are one row per candidate."""
    mean = auc_bounds(wide, models, cands, group_cols, steps).groupBy("candidate").agg(F.avg("lower").alias("lower"), F.avg("upper").alias("upper"))
    rows = sorted(mean.collect())
    least = max(r["lower"] for r in rows if r["lower"] is not None) if any(r["lower"] is not None for r in rows) else None
    # a hair of slack: the bounds and the exact value are sums of doubles in different orders
    left = [r["candidate"] for r in rows if least is None or r["upper"] >= least - 1e-12]
    exact = candidate_auc(wide, models, [cands[i] for i in left], group_cols, materialized)
    exact = {r["candidate"]: r["auc"] for r in exact.groupBy("candidate").agg(F.avg("auc").alias("auc")).collect()}
    auc = {i: exact.get(j) for j, i in enumerate(left)}
    best = max((i for i in left if auc[i] is not None), key=lambda i: (auc[i], -i), default=left[0] if left else None)
    return wide.sparkSession.createDataFrame([(r["candidate"], r["lower"], r["upper"], auc.get(r["candidate"]), r["candidate"] == best) for r in rows],
                                             "candidate int, lower double, upper double, auc double, best boolean")


def apply_best(wide_test: DataFrame, weights: dict[str, float], models: Sequence[str], id_col: str = "id") -> DataFrame:
    """Score rows with the best candidate's weights."""
    return wide_test.select(id_col, _blend(weights, models).alias("p"))
