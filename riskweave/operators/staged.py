"""Metrics of a boosted model after each of its iterations (E5, I6), and fits that stop by waiting.

One pass scores the rows with every prefix of the trees: per row the running sum of weighted tree
outputs. A task's batch is collapsed to distinct (iteration, score) cells at once, cells of all
tasks are summed with map-side combine, and one grouped AUC ranks all iterations in one job.
"""

from __future__ import annotations

import sys
from dataclasses import astuple

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators import boost, treeshap
from riskweave.operators.metrics import auc_of_cells
from riskweave.operators.models import best_prefix, truncated

#: Rows scored at once: the matrix of margins has one column per tree.
BATCH = 2048


def tree_outputs(t: treeshap.Tree, X: np.ndarray) -> np.ndarray:
    """The value of the leaf that each row of X reaches: all rows go down one level per step."""
    node = np.zeros(len(X), np.int64)
    rows = np.flatnonzero(t.left[node] >= 0)
    while len(rows):
        at = node[rows]
        x = X[rows, t.feature[at]]
        goes_left = x <= t.threshold[at]
        for j in np.unique(at).tolist():
            if t.categories[j] is not None:
                here = at == j
                goes_left[here] = np.isin(x[here], list(t.categories[j]))
        node[rows] = np.where(goes_left, t.left[at], t.right[at])
        rows = rows[t.left[node[rows]] >= 0]
    return t.value[node]


def staged_probabilities(trees: list[treeshap.Tree], factor: float, X: np.ndarray) -> np.ndarray:
    """Rows x iterations: the probability that the first 1, 2, ... trees give."""
    margin = np.cumsum(np.column_stack([t.weight * tree_outputs(t, X) for t in trees]), axis=1)
    return 1.0 / (1.0 + np.exp(-factor * margin))


def staged_cells(df: DataFrame, model, features_col: str = "features", label_col: str = "target", start: int = 0) -> DataFrame:
    """Distinct (iter, score ``_s``) cells with counts ``pos`` and ``neg`` of a boosted model's
    iterations from ``start`` on, numbered from 0. Rows without a label are left out."""
    trees, factor = treeshap.read_trees(df.sparkSession, model)
    # pickled by value, as in treeshap: executors need no copy of this library; the broadcast
    # holds the node tables of one model
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(treeshap)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    bc = df.sparkSession.sparkContext.broadcast(([astuple(t) for t in trees], factor))

    def count(batches):
        raw, fac = bc.value
        ts = [treeshap.Tree(*t) for t in raw]
        for pdf in batches:
            for lo in range(0, len(pdf), BATCH):
                part = pdf.iloc[lo:lo + BATCH]
                p = staged_probabilities(ts, fac, np.stack(part["_x"].to_numpy()).astype(float))
                y = part["_y"].to_numpy()
                out = []
                for i in range(start, p.shape[1]):
                    s, back = np.unique(p[:, i], return_inverse=True)
                    n, pos = np.bincount(back, minlength=len(s)), np.bincount(back, y, len(s)).astype(np.int64)
                    out.append(pd.DataFrame({"iter": i, "_s": s, "pos": pos, "neg": n - pos}))
                yield pd.concat(out)

    src = df.where(F.col(label_col).isNotNull()).select(vector_to_array(F.col(features_col)).alias("_x"), F.col(label_col).cast("int").alias("_y"))
    cells = src.mapInPandas(count, "iter int, _s double, pos long, neg long")
    return cells.groupBy("iter", "_s").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def staged_auc(df: DataFrame, model, features_col: str = "features", label_col: str = "target", start: int = 0) -> DataFrame:
    """(iter, auc) on ``df`` after each boosting iteration from ``start`` on; null where ``df`` holds one class only."""
    return auc_of_cells(staged_cells(df, model, features_col, label_col, start), ["iter"])


def fit_patient(estimator, train: DataFrame, val: DataFrame, wait: int, features_col: str = "features",
                label_col: str = "target", id_col: str | None = None) -> tuple[object, list[float]]:
    """E5: boosting stopped when the AUC on ``val`` has not grown for ``wait`` iterations; the best
    prefix of trees and the AUCs that were looked at.

    2 ``wait`` iterations are fitted, then twice as many until the waiting rule stops or the estimator's
    ``maxIter`` is reached: no more than a few times the iterations looked at, however large ``maxIter``
    is. A seeded fit's first trees are those of a longer one, so only new iterations are scored. With
    ``id_col`` the member grows over packed rows (``boost.Boosting``) and goes on from the trees it has."""
    most = estimator.getMaxIter()
    rounds = min(most, 2 * wait)
    grown = boost.Boosting(train, estimator, [None], features_col, label_col, None, id_col) if id_col is not None and boost.can_fit(estimator) else None
    aucs: list[float] = []
    try:
        while True:
            model = grown.rounds(rounds).models()[0] if grown is not None else estimator.copy({estimator.maxIter: rounds}).fit(train)
            aucs += [r["auc"] for r in staged_auc(val, model, features_col, label_col, len(aucs)).orderBy("iter").collect()]
            if not aucs or aucs[0] is None:
                raise ValueError("waiting for the AUC needs validation rows of both classes")
            keep, run = best_prefix([-v for v in aucs], wait)
            if run - keep >= wait or rounds == most:
                return truncated(model, keep), aucs[:run]
            rounds = min(most, 2 * rounds)
    finally:
        if grown is not None:
            grown.release()
