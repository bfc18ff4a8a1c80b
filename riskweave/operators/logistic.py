"""Logistic members over packed rows (E3, F5): the models of all folds are fitted together, one pass a step.

The method is that of Spark ML's ``LogisticRegression`` for two classes (features scaled by the deviation of a
model's own training rows and centred, L2 penalty, L-BFGS with a strong Wolfe line search, the same stopping
rule) and the result is its model class. What differs is the layout: rows are packed once for all folds and
hold their entries other than zero, and a pass over them gives the loss and gradient of every model that
still runs; the driver sees one sum per model and feature.
"""

from __future__ import annotations

import math
import operator
import sys
from collections.abc import Generator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.boost import entries

#: Numbers of a dense piece of a block, and the width per entry beyond which pieces stay sparse.
PIECE, SPARSE = 1 << 16, 24
#: Bytes of the tasks' sums that the driver adds up itself, in the order of the partitions.
SUM_BYTES = 64 << 20
#: Corrections of L-BFGS, tries of a line search, its constants and the values a stop looks back on, as in Spark ML.
MEMORY, TRIES, DECREASE, CURVATURE, LOOK_BACK = 10, 10, 1e-4, 0.9, 20


def can_fit(estimator) -> bool:
    """Settings outside of these are left to Spark ML's own fit."""
    return (isinstance(estimator, LogisticRegression) and not estimator.isDefined(estimator.weightCol)
            and estimator.getRegParam() * estimator.getElasticNetParam() == 0.0 and estimator.getFamily() in ("auto", "binomial")
            and not any(estimator.isSet(estimator.getParam(f"{side}BoundsOn{of}")) for side in ("lower", "upper") for of in ("Coefficients", "Intercepts")))


# ------------------------------------------------------------------ rows

def packed_vectors(x: pa.StructArray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Width, entries per row, and features and values of the entries other than zero."""
    if x.null_count:
        raise ValueError("a row has no feature vector")
    rows, at, v = entries(x)
    sizes = np.where(np.asarray(x.field("type")) == 0, np.asarray(x.field("size").fill_null(0)), np.asarray(x.field("values").value_lengths()))
    if (sizes != sizes[0]).any() or not np.isfinite(v).all():
        raise ValueError("feature vectors must be of one size, without NaN or infinite values")
    kept, width = v != 0.0, int(sizes[0])
    return width, np.bincount(rows[kept], minlength=len(x)), at[kept].astype(np.uint16 if width < 65536 else np.uint32), v[kept]


def pack(df: DataFrame, features_col: str, label_col: str, fold_col: str) -> RDD:
    """RDD of blocks (width, fold, label, entries per row, features and values of the entries), one per Arrow
    batch. Labels other than 0 and 1 become 2."""
    _by_value()

    def blocks(batches):
        for b in batches:
            if len(b):
                width, many, idx, val = packed_vectors(b.column("x"))
                cols = np.asarray(b.column("fold")).astype(np.int32), np.asarray(b.column("y")).astype(np.int8), many.astype(np.int32), idx, val
                yield pa.RecordBatch.from_arrays([pa.array([width])] + [pa.array([c.tobytes()], pa.binary()) for c in cols],
                                                 names=["width", "fold", "y", "many", "idx", "val"])

    def read(r):
        return (r.width, np.frombuffer(r.fold, np.int32), np.frombuffer(r.y, np.int8), np.frombuffer(r.many, np.int32),
                np.frombuffer(r.idx, np.uint16 if r.width < 65536 else np.uint32), np.frombuffer(r.val))

    y = F.col(label_col)
    src = df.where(F.col(fold_col).isNotNull()).select(
        F.col(fold_col).cast("int").alias("fold"), F.when(y.isin(0, 1), y).otherwise(2).cast("int").alias("y"), F.unwrap_udt(F.col(features_col)).alias("x"))
    return src.mapInArrow(blocks, "width long, fold binary, y binary, many binary, idx binary, val binary").rdd.map(read)


def merged(a: tuple, b: tuple) -> tuple:
    """(rows, rows of class 1, rows of neither, mean, squared deviations) of two sets of rows together."""
    n = a[0] + b[0]
    delta, share = b[3] - a[3], b[0] / n
    return n, a[1] + b[1], a[2] + b[2], a[3] + delta * share, a[4] + b[4] + delta * delta * (a[0] * share)


def moments(block: tuple) -> dict[int, tuple]:
    """Per fold of a block's rows what ``merged`` adds up. Deviations are taken from a column's first value, so those of a
    column of one value are exactly zero."""
    width, fold, y, many, idx, val = block
    out, of_entry = {}, np.repeat(fold, many)
    for f in np.unique(fold).tolist():
        mine, n = of_entry == f, int((fold == f).sum())
        mean, m2 = np.zeros(width), np.zeros(width)
        order = np.argsort(idx[mine], kind="stable")
        at, v = idx[mine][order], val[mine][order]
        if len(at):
            first = np.flatnonzero(np.diff(at.astype(np.int64), prepend=-1))
            count = np.diff(np.append(first, len(at)))
            present = at[first]
            some = v[first] + np.add.reduceat(v - np.repeat(v[first], count), first) / count
            mean[present] = some * (count / n)
            m2[present] = np.add.reduceat((v - np.repeat(some, count)) ** 2, first) + some * some * (count / n * (n - count))
        out[f] = (n, int((y[fold == f] == 1).sum()), int((y[fold == f] > 1).sum()), mean, m2)
    return out


def summary(blocks: RDD) -> dict[int, tuple]:
    def together(a, b):
        return {f: merged(a[f], b[f]) if f in a and f in b else a.get(f, b.get(f)) for f in sorted(a.keys() | b.keys())}

    def sums(part):
        out = {}
        for block in part:
            out = together(out, moments(block))
        yield out
    return blocks.mapPartitions(sums).reduce(together)


def pieces(block: tuple):
    """A block's rows in pieces: (rows, margins of weights, sums of residuals times features), both with a line per model.
    A piece is laid out densely, or left sparse where it is wide."""
    width, _, _, many, idx, val = block
    n, at = len(many), idx.astype(np.int64)
    if width > SPARSE and width * n > SPARSE * len(at):
        rows = np.repeat(np.arange(n), many)
        yield (slice(0, n), lambda W: np.stack([np.bincount(rows, val * w.take(at), n) for w in W]),
               lambda R: np.stack([np.bincount(at, val * r.take(rows), width) for r in R]))
        return
    step, end = max(1, PIECE // max(width, 1)), np.concatenate([[0], np.cumsum(many, dtype=np.int64)])
    place = np.repeat(np.arange(n) % step * width, many) + at
    buffer = np.zeros((min(step, n), width))
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        X, here = buffer[:hi - lo], place[end[lo]:end[hi]]
        X.ravel()[here] = val[end[lo]:end[hi]]
        yield slice(lo, hi), lambda W, X=X: W @ X.T, lambda R, X=X: R @ X
        X.ravel()[here] = 0.0


def losses(blocks: RDD, folds: np.ndarray, W: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per model (line) the sums over its training rows: residual times feature, residual, loss."""
    def sums(part):
        out = np.zeros((len(folds), W.shape[1] + 2))
        for block in part:
            side = np.where(block[2] == 1, -1.0, 1.0)
            for rows, margins, back in pieces(block):
                s, learns = side[rows], block[1][rows] != folds[:, None]
                M = s * (margins(W) + b[:, None])            # the loss is log(1 + exp(M))
                E = np.exp(-np.abs(M))
                R = s * learns * np.where(M >= 0.0, 1.0, E) / (1.0 + E)
                out[:, :-2] += back(R)
                out[:, -2] += R.sum(axis=1)
                out[:, -1] += ((np.log1p(E) + np.maximum(M, 0.0)) * learns).sum(axis=1)
        yield out
    each = blocks.mapPartitions(sums)
    small = blocks.getNumPartitions() * len(folds) * (W.shape[1] + 2) * 8 <= SUM_BYTES
    return each.reduce(operator.add) if small else each.treeReduce(operator.add)


# ------------------------------------------------------------------ steps

class SearchFailed(Exception):
    pass


Search = Generator[np.ndarray, tuple[float, np.ndarray], tuple]


def descent(g: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Direction of L-BFGS from the gradient and the last (step, change of the gradient), newest first."""
    d, parts = g.copy(), []
    for s, c in steps:
        parts.append((s @ d) / (s @ c))
        d -= parts[-1] * c
    if steps:
        s, c = steps[0]
        if not (s @ c >= 0.0) or np.isnan(parts).any():
            raise SearchFailed
        d *= (s @ c) / (c @ c)
    for (s, c), a in zip(reversed(steps), reversed(parts)):
        d += (a - (c @ d) / (s @ c)) * s
    return -d


def between(l: tuple, r: tuple) -> float:
    """Minimum of the cubic through two (place, value, slope), kept off both ends."""
    if l[0] > r[0]:
        l, r = r, l
    d1 = l[2] + r[2] - 3 * (l[1] - r[1]) / (l[0] - r[0])
    d2 = math.sqrt(max(d1 * d1 - l[2] * r[2], 0.0))
    bend = r[2] - l[2] + 2 * d2
    t = r[0] - (r[0] - l[0]) * ((r[2] + d2 - d1) / bend if bend else 0.5)
    return min(max(t, l[0] + 0.1 * (r[0] - l[0])), l[0] + 0.9 * (r[0] - l[0]))


def line_search(x: np.ndarray, f: float, g: np.ndarray, d: np.ndarray, t: float) -> Search:
    """(length, point, value, gradient) along ``d`` where the strong Wolfe conditions hold."""
    low, slope = (0.0, f, float(g @ d)), float(g @ d)
    if not slope <= 0:
        raise SearchFailed
    hi, closed = None, 0                         # the other end of the interval, and tries within it
    for i in range(2 * TRIES):
        if hi is None and i >= TRIES:
            raise SearchFailed
        if hi is not None:
            if closed == TRIES:
                raise SearchFailed
            closed, t = closed + 1, between(low, hi)
        at = x + t * d
        value, grad = yield at
        c = (t, value, float(grad @ d))
        if hi is None and not math.isfinite(value):
            t /= 2.0
            continue
        too_high = value > f + DECREASE * t * slope or (value >= low[1] and (hi is not None or i > 0))
        if not too_high and abs(c[2]) <= CURVATURE * abs(slope):
            return t, at, value, grad
        if hi is None:
            if too_high:
                hi = c
            elif c[2] >= 0:
                low, hi = c, low
            else:
                low, t = c, 1.5 * t
        elif too_high:
            hi = c
        else:
            if c[2] * (hi[0] - low[0]) >= 0:
                hi = low
            low = c
    raise SearchFailed


def lbfgs(x: np.ndarray, max_iter: int, tol: float) -> Search:
    """Yields points, is sent their (value, gradient), and returns (last point, iterations)."""
    f, g = yield x
    start, seen, steps, i, failed = f, [math.inf], [], 0, False
    while i < max_iter and np.linalg.norm(g) > max(tol * f, 1e-8) and not (len(seen) > 1 and abs(f - max(seen)) <= tol * start):
        try:
            d = descent(g, steps)
            t, at, value, grad = yield from line_search(x, f, g, d, 1.0 if i else 1.0 / float(np.linalg.norm(d)))
            if t * np.linalg.norm(g) < 1e-10:
                raise SearchFailed
        except SearchFailed:
            if failed:
                break
            steps, failed = [], True             # once more along the gradient
            continue
        steps = [(at - x, grad - g), *steps][:MEMORY]
        x, f, g, i, failed = at, value, grad, i + 1, False
        seen = [*seen, f][-LOOK_BACK:]
    return x, i


class Member:
    """One model: its training rows' moments, its objective's scale and its search."""

    def __init__(self, estimator: LogisticRegression, n: int, positive: int, mean: np.ndarray, m2: np.ndarray):
        self.est, self.n, self.centred = estimator, n, estimator.getFitIntercept()
        std = np.sqrt(m2 / (n - 1)) if n > 1 else np.zeros(len(m2))
        self.scale = np.divide(1.0, std, out=np.zeros(len(std)), where=std != 0.0)
        self.shift = mean * self.scale * self.centred
        self.penalty = estimator.getRegParam() * (np.ones(len(std)) if estimator.getStandardization() else self.scale ** 2)
        self.x, self.search = np.zeros(len(std) + 1), None
        if self.centred and positive in (0, n):  # one class: no search
            self.x[-1] = math.inf if positive else -math.inf
            return
        if self.centred:
            self.x[-1] = math.log(positive / (n - positive))
        self.search = lbfgs(self.x, estimator.getMaxIter(), estimator.getTol())
        self.x = next(self.search)

    def weights(self) -> tuple[np.ndarray, float]:
        """Coefficients and intercept for rows as they are."""
        w = self.x[:-1]
        return w * self.scale, float(self.x[-1] - w @ self.shift)

    def take(self, sums: np.ndarray) -> None:
        """The next point, from the sums over the training rows at this one."""
        w, (by, r, loss) = self.x[:-1], (sums[:-2] / self.n, sums[-2] / self.n, sums[-1] / self.n)
        grad = np.append(by * self.scale - r * self.shift + self.penalty * w, r * self.centred)
        try:
            self.x = self.search.send((float(loss + 0.5 * (self.penalty * w) @ w), grad))
        except StopIteration as end:
            (self.x, _), self.search = end.value, None

    def model(self, sc) -> LogisticRegressionModel:
        w, b = self.weights()
        made = sc._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(self.est.uid, _py2java(sc, Vectors.dense(w)), b)
        return self.est._copyValues(LogisticRegressionModel(made))


def _by_value() -> None:
    # pickled by value, as in treeshap: executors need no copy of this library
    from pyspark import cloudpickle
    for m in (sys.modules[__name__], sys.modules[entries.__module__]):
        cloudpickle.register_pickle_by_value(m)


def fit_folds(df: DataFrame, estimator: LogisticRegression, folds: list[int], features_col: str = "features", label_col: str = "target",
              fold_col: str = "fold") -> list[LogisticRegressionModel] | None:
    """One logistic model per fold on the rows of the others; None where labels are not all 0 and 1, or a fold leaves no rows."""
    sc = df.sparkSession.sparkContext
    est = estimator.copy().setFeaturesCol(features_col).setLabelCol(label_col)
    blocks = pack(df, features_col, label_col, fold_col).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        seen, members = summary(blocks), []
        if any(s[2] for s in seen.values()):
            return None
        for f in folds:
            others = [s for g, s in seen.items() if g != f]
            if not others:
                return None
            total = others[0]
            for s in others[1:]:
                total = merged(total, s)
            members.append(Member(est, total[0], total[1], total[3], total[4]))
        while running := [j for j, m in enumerate(members) if m.search is not None]:
            at = [members[j].weights() for j in running]
            sums = losses(blocks, np.array([folds[j] for j in running]), np.stack([w for w, _ in at]), np.array([b for _, b in at]))
            for j, s in zip(running, sums):
                members[j].take(s)
        return [m.model(sc) for m in members]
    finally:
        blocks.unpersist()
