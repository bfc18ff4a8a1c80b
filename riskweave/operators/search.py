"""Search bookkeeping (F9-F11) over a ``trials(trial, fold, auc)`` table.

``trial_table`` evaluates every (trial, fold) in one distributed job: each trial is a
seeded weight vector over the members and each fold's AUC comes from the grouped AUC.
Pruning and best-trial selection are small window / aggregate queries over that table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.ensemble import candidate_auc

# Reports are rounded before being compared with a median, so engines agree on ties.
REPORT_DIGITS = 9


def trial_table(wide: DataFrame, models: Sequence[str], cands: list[dict[str, float]], materialized: bool = False) -> DataFrame:
    """trial, fold, auc for every candidate weight vector and fold (F9 objective per fold)."""
    return candidate_auc(wide, models, cands, ["fold"], materialized).withColumnRenamed("candidate", "trial")


def median_prune(trials: DataFrame, startup: int = 10) -> DataFrame:
    """F10 (median rule over earlier trials): at fold f a trial reports the running mean of its
    fold AUCs; it is pruned at the first fold where the best report so far is below the median
    of the reports of all earlier trials at that fold, once ``startup`` trials exist.
    Output: trial, pruned_at (NULL when never pruned)."""
    wf = Window.partitionBy("trial").orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    rep = trials.select("trial", "fold", F.avg("auc").over(wf).alias("_r"))
    rep = rep.select("trial", "fold", (F.round(F.col("_r") * F.lit(10.0 ** REPORT_DIGITS)) /
                                       F.lit(10.0 ** REPORT_DIGITS)).alias("report"))
    best = F.max("report").over(wf)
    earlier = Window.partitionBy("fold").orderBy("trial").rowsBetween(Window.unboundedPreceding, -1)
    # the frame holds one report per earlier trial (bounded by the trial count)
    prev = F.array_sort(F.collect_list("report").over(earlier))
    flagged = rep.select("trial", "fold", best.alias("best"), prev.alias("_prev"))
    n = F.size("_prev")
    mid = F.element_at("_prev", (F.floor((n - 1) / 2) + 1).cast("int"))
    mid2 = F.element_at("_prev", (F.floor(n / 2) + 1).cast("int"))
    flagged = flagged.select("trial", "fold", "best", n.alias("n_before"),
                             F.when(n > 0, (mid + mid2) / F.lit(2.0)).alias("med"))
    prune = flagged.where((F.col("n_before") >= startup) & (F.col("best") < F.col("med")))
    first = prune.groupBy("trial").agg(F.min("fold").alias("pruned_at"))
    return (trials.select("trial").distinct().join(first, "trial", "left")
            .select("trial", F.col("pruned_at").cast("int").alias("pruned_at")))


def best_trial(trials: DataFrame) -> DataFrame:
    """the trial with the highest mean fold AUC (lowest trial id on ties)."""
    means = trials.groupBy("trial").agg(F.avg("auc").alias("auc"))
    return means.orderBy(F.desc("auc"), F.asc("trial")).limit(1)


def random_search(space: dict[str, tuple], n_trials: int, seed: int,
                  objective: Callable[[dict, Callable[[int, float], bool]], float],
                  startup: int = 10) -> list[dict]:
    """F9/F10 driver loop for model hyper-parameters: seeded draws from ``space``
    (name -> ("int", lo, hi) | ("float", lo, hi) | ("logfloat", lo, hi)); ``objective`` gets the
    parameters and a ``report(fold, running_mean) -> should_prune`` callback. Only *completed*
    trials feed the median (the library rule). Each objective call runs Spark jobs; the loop
    itself holds only the small trial records."""
    rng = np.random.default_rng(seed)
    done: list[dict] = []
    history: list[dict] = []
    for t in range(n_trials):
        params = {}
        for name, (kind, lo, hi) in space.items():
            if kind == "int":
                params[name] = int(rng.integers(lo, hi + 1))
            elif kind == "logfloat":
                params[name] = float(np.exp(rng.uniform(np.log(lo), np.log(hi))))
            else:
                params[name] = float(rng.uniform(lo, hi))
        reports: dict[int, float] = {}

        def report(fold: int, value: float) -> bool:
            reports[fold] = round(value, REPORT_DIGITS)
            if len(done) < startup:
                return False
            prev = [d["reports"][fold] for d in done if fold in d["reports"]]
            if not prev:
                return False
            return max(reports.values()) < float(np.median(prev))

        value = objective(params, report)
        rec = {"trial": t, "params": params, "value": value, "reports": dict(reports),
               "state": "pruned" if value is None else "complete"}
        history.append(rec)
        if value is not None:
            done.append(rec)
    return history
