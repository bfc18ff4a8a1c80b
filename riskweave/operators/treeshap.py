"""Tree SHAP for Spark tree ensembles (P1): Shapley values of the path-dependent (cover-weighted)
conditional expectation, computed leaf by leaf for whole batches with NumPy.

The fitted model is saved with Spark ML persistence and its node table read back with
``spark.read.parquet`` (bounded: trees x nodes rows); the arrays travel to executors as a
broadcast and ``mapInArrow`` explains each partition's batches. The explained quantity is the
model margin in log-odds (Spark GBT: 2 x sum of weighted tree outputs), so
``base + sum(phi) = logit(probability)``.
"""

from __future__ import annotations

import math
import sys
import uuid
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators import boost
from riskweave.session import scratch_path


@dataclass
class Tree:
    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    categories: list          # None for continuous splits, else set of left-going categories
    value: np.ndarray
    cover: np.ndarray
    weight: float


def read_trees(spark: SparkSession, model) -> tuple[list[Tree], float]:
    """Node tables of a fitted GBT / random forest / decision tree model, with tree weights and
    the factor turning the weighted sum of tree outputs into log-odds."""
    path = scratch_path(spark, f"treeshap/{uuid.uuid4().hex}")
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "treeID" not in data.columns:
        data = data.withColumn("treeID", F.lit(0))
    rows = (data.select("treeID", "nodeData.id", "nodeData.prediction", "nodeData.impurityStats",
                        "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex",
                        "nodeData.split.leftCategoriesOrThreshold", "nodeData.split.numCategories")
            .toPandas())
    cls = type(model).__name__
    weights = list(getattr(model, "treeWeights", [1.0]))
    factor = 2.0 if cls.startswith("GBT") else 1.0
    # classifier forests / trees store class counts: cover = their sum, leaf value = P(class 1);
    # regression trees (inside GBT) store [count, sum, sum of squares] and predict the mean
    class_counts = "Classification" in cls and not cls.startswith("GBT")
    trees = []
    for tid, g in rows.groupby("treeID"):
        g = g.sort_values("id")
        n = int(g["id"].max()) + 1
        left = np.full(n, -1, dtype=np.int64)
        right = np.full(n, -1, dtype=np.int64)
        feat = np.full(n, -1, dtype=np.int64)
        thr = np.zeros(n)
        val = np.zeros(n)
        cover = np.zeros(n)
        cats: list = [None] * n
        for r in g.itertuples(index=False):
            i = int(r.id)
            left[i], right[i] = int(r.leftChild), int(r.rightChild)
            stats = [float(v) for v in r.impurityStats]
            if class_counts:
                tot = sum(stats)
                cover[i] = tot
                val[i] = stats[1] / tot if tot > 0 and len(stats) > 1 else 0.0
            else:
                cover[i] = stats[0] if stats else 0.0
                val[i] = float(r.prediction)
            if left[i] >= 0:
                feat[i] = int(r.featureIndex)
                if int(r.numCategories) < 0:
                    thr[i] = float(r.leftCategoriesOrThreshold[0])
                else:
                    cats[i] = {float(c) for c in r.leftCategoriesOrThreshold}
        trees.append(Tree(left, right, feat, thr, cats, val, cover, float(weights[int(tid)])))
    if not cls.startswith("GBT") and len(trees) > 1:
        trees = [Tree(t.left, t.right, t.feature, t.threshold, t.categories, t.value, t.cover,
                      1.0 / len(trees)) for t in trees]
    return trees, factor


def _goes_left(t: Tree, j: int, xv: float) -> bool:
    c = t.categories[j]
    return (xv in c) if c is not None else (xv <= t.threshold[j])


# A leaf contributes the game in which a coalition S earns value * prod(j in S: follows_j) *
# prod(j not in S: share_j) over the features j on its path: follows_j says whether x passes all of
# j's splits there, share_j is the fraction of the training rows that do (product of cover
# ratios). Its Shapley values depend on x only through the 0/1 vector of follows_j, so a batch is
# grouped by that vector and the values are computed once for each that occurs.

@dataclass
class Leaf:
    value: float
    features: list            # distinct features on the path
    shares: np.ndarray
    tests: list               # per feature: [(node, must go left), ...]


def leaves(t: Tree) -> list[Leaf]:
    """All leaves with their paths, gathered once per tree."""
    out, todo = [], [(0, [])]
    while todo:
        j, path = todo.pop()
        left, right = int(t.left[j]), int(t.right[j])
        if left >= 0:
            todo += [(left, [*path, (j, True, t.cover[left] / t.cover[j])]),
                     (right, [*path, (j, False, t.cover[right] / t.cover[j])])]
            continue
        tests: dict[int, list] = {}
        share: dict[int, float] = {}
        for node, is_left, ratio in path:
            f = int(t.feature[node])
            tests.setdefault(f, []).append((node, is_left))
            share[f] = share.get(f, 1.0) * ratio
        out.append(Leaf(float(t.value[j]), list(tests), np.array([share[f] for f in tests]), list(tests.values())))
    return out


def leaf_values(follows: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Shapley values of a leaf of value 1 for each row of the 0/1 matrix ``follows``.

    For feature i the coalitions of the others are summed by size: coefficient k of the product
    over j != i of (share_j + follows_j * s) is what coalitions of k features earn together."""
    rows, m = follows.shape
    weight = np.array([math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)])
    out = np.empty((rows, m))
    for i in range(m):
        by_size = np.zeros((rows, m))
        by_size[:, 0] = 1.0
        for j in range(m):
            if j != i:
                grown = by_size * shares[j]
                grown[:, 1:] += by_size[:, :-1] * follows[:, j:j + 1]
                by_size = grown
        out[:, i] = (follows[:, i] - shares[i]) * (by_size @ weight)
    return out


#: Features on a path up to which a leaf's values are tabled for every pattern of follows.
TABLED = 10


def tabled(trees: list[Tree], factor: float) -> list[list[tuple]]:
    """Per tree its leaves with the values of every pattern (None for longer paths), made once for all batches."""
    out = []
    for t in trees:
        mine = []
        for leaf in leaves(t):
            m = len(leaf.features)
            if m:
                every = (np.arange(1 << m)[:, None] >> np.arange(m - 1, -1, -1) & 1).astype(float) if m <= TABLED else None
                mine.append((leaf, None if every is None else leaf_values(every, leaf.shares).T.copy() * (leaf.value * factor * t.weight)))
        out.append(mine)
    return out


def shap_batch(trees: list[Tree], factor: float, X: np.ndarray, n_features: int, ready: list | None = None) -> np.ndarray:
    """Attributions of all rows of X (rows x features) to all features. ``ready``: ``tabled`` of the trees."""
    phi = np.zeros((n_features, len(X)))
    for t, mine in zip(trees, tabled(trees, factor) if ready is None else ready):
        goes_left: dict[int, np.ndarray] = {}
        for j in np.flatnonzero(t.left >= 0).tolist():
            x, c = X[:, int(t.feature[j])], t.categories[j]
            goes_left[j] = np.isin(x, list(c)) if c is not None else x <= t.threshold[j]
        for leaf, table in mine:
            follows = np.ones((len(leaf.features), len(X)), bool)
            for i, tests in enumerate(leaf.tests):
                for node, is_left in tests:
                    follows[i] &= goes_left[node] == is_left
            code = np.zeros(len(X), np.int64)
            for i in range(len(follows)):
                code = code * 2 + follows[i]
                if i % 60 == 59:                              # keep the code within 62 bits
                    code = np.unique(code, return_inverse=True)[1].astype(np.int64)
            if table is None:
                _, first, code = np.unique(code, return_index=True, return_inverse=True)
                table = leaf_values(follows[:, first].T.astype(float), leaf.shares).T * (leaf.value * factor * t.weight)
            for i, f in enumerate(leaf.features):
                phi[f] += table[i].take(code)
    return np.ascontiguousarray(phi.T)


def expected_value(t: Tree, j: int = 0) -> float:
    if t.left[j] < 0:
        return float(t.value[j])
    l, r = t.left[j], t.right[j]
    return (t.cover[l] * expected_value(t, l) + t.cover[r] * expected_value(t, r)) / t.cover[j]


def shap_row(trees: list[Tree], factor: float, x, n_features: int) -> np.ndarray:
    return shap_batch(trees, factor, np.asarray(x, dtype=float)[None], n_features)[0]


def base_value(trees: list[Tree], factor: float) -> float:
    return float(sum(factor * t.weight * expected_value(t) for t in trees))


BATCH = 2048


def tree_shap_wide(df: DataFrame, model, features_col: str = "features", id_col: str = "id",
                   n_features: int | None = None) -> DataFrame:
    """(id, phi array of all features, base) for every row of ``df``. For a sampled explanation
    (C2) pass ``sample_n(df, n)``."""
    spark = df.sparkSession
    trees, factor = read_trees(spark, model)
    nf = n_features or int(model.numFeatures)
    # executors need no copy of this library: the explain function and this module's helpers
    # are pickled by value, and the broadcast holds plain tuples of numpy arrays (the node tables
    # of one model)
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    cloudpickle.register_pickle_by_value(boost)
    bc = spark.sparkContext.broadcast(([astuple(t) for t in trees], factor))

    def explain(batches):
        raw, fac = bc.value
        ts = [Tree(*t) for t in raw]
        ready = tabled(ts, fac)
        for b in batches:
            for lo in range(0, b.num_rows, BATCH):
                part = b.slice(lo, BATCH)
                rows, at, v = boost.entries(part.column(1))
                X = np.zeros((part.num_rows, max(nf, int(at.max()) + 1 if len(at) else 0)))
                X[rows, at] = v
                phi = shap_batch(ts, fac, X, nf, ready)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(X) + 1, dtype=np.int32) * nf), pa.array(phi.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_col, "phi"])

    src = df.select(id_col, F.unwrap_udt(F.col(features_col)).alias("_x"))
    id_type = df.schema[id_col].dataType.simpleString()
    return src.mapInArrow(explain, f"{id_col} {id_type}, phi array<double>").withColumn("base", F.lit(base_value(trees, factor)))


def tree_shap(df: DataFrame, model, features_col: str = "features", id_col: str = "id",
              n_features: int | None = None) -> DataFrame:
    """Long attributions (id, feature_idx, phi, base): every feature of every row, zeros included."""
    wide = tree_shap_wide(df, model, features_col, id_col, n_features)
    return wide.select(id_col, F.posexplode("phi").alias("feature_idx", "phi"), "base")


def brute_force_shapley(trees: list[Tree], factor: float, x: np.ndarray, n_features: int) -> np.ndarray:
    """Exact Shapley values of the cover-weighted conditional expectation (test oracle)."""
    from itertools import combinations
    from math import factorial

    def cond(t: Tree, j: int, s: frozenset) -> float:
        if t.left[j] < 0:
            return float(t.value[j])
        f = int(t.feature[j])
        if f in s:
            return cond(t, t.left[j] if _goes_left(t, j, x[f]) else t.right[j], s)
        l, r = t.left[j], t.right[j]
        return (t.cover[l] * cond(t, l, s) + t.cover[r] * cond(t, r, s)) / t.cover[j]

    def v(s):
        return sum(factor * t.weight * cond(t, 0, s) for t in trees)

    m = n_features
    phi = np.zeros(m)
    for i in range(m):
        others = [k for k in range(m) if k != i]
        for size in range(m):
            for sub in combinations(others, size):
                s = frozenset(sub)
                wgt = factorial(size) * factorial(m - size - 1) / factorial(m)
                phi[i] += wgt * (v(s | {i}) - v(s))
    return phi
