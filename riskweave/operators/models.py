"""Spark ML members trained out of fold.

The input is persisted once (or checkpointed into the shared checkpoint folder). Boosted and logistic
members of all folds are fitted together (``boost``, ``logistic``), others one after another from the
driver; each fit is itself a distributed job. Early
stopping uses the held-out fold through ``validationIndicatorCol``, scoring is a narrow
``transform`` and the OOF table is the union of the k scored folds.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import SparkContext, StorageLevel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators import boost, logistic
from riskweave.operators.folds import assemble_oof
from riskweave.operators.rank import maybe_broadcast
from riskweave.session import scratch_path


def gbt_leafwise(max_iter: int = 2000, seed: int = 42, **kw) -> GBTClassifier:
    """the leaf-wise family's settings mapped onto Spark GBT (lr .05, ~31 leaves -> depth 5,
    features .8 per tree, bagging .9)."""
    return GBTClassifier(stepSize=kw.get("stepSize", 0.05), maxDepth=kw.get("maxDepth", 5),
                         featureSubsetStrategy=kw.get("featureSubsetStrategy", "0.8"),
                         subsamplingRate=kw.get("subsamplingRate", 0.9), maxIter=max_iter, seed=seed,
                         maxBins=kw.get("maxBins", 64), validationTol=kw.get("validationTol", 0.0001))


def gbt_depthwise(max_iter: int = 20000, seed: int = 42, **kw) -> GBTClassifier:
    """depth-wise family (eta .02, depth 7, subsample .8, colsample .7, histogram splits)."""
    return GBTClassifier(stepSize=kw.get("stepSize", 0.02), maxDepth=kw.get("maxDepth", 7),
                         featureSubsetStrategy=kw.get("featureSubsetStrategy", "0.7"),
                         subsamplingRate=kw.get("subsamplingRate", 0.8), maxIter=max_iter, seed=seed,
                         maxBins=kw.get("maxBins", 64), validationTol=kw.get("validationTol", 0.0001))


def gbt_native_category(max_iter: int = 5000, seed: int = 42, max_bins: int = 64, **kw) -> GBTClassifier:
    """native-category family (depth 8, lr .03); categorical slots come from indexed columns
    whose metadata marks them categorical (``VectorIndexer``)."""
    return GBTClassifier(stepSize=kw.get("stepSize", 0.03), maxDepth=kw.get("maxDepth", 8),
                         maxIter=max_iter, seed=seed, maxBins=max_bins,
                         validationTol=kw.get("validationTol", 0.0001))


def logistic_meta(n_rows: int, C: float = 1.0) -> LogisticRegression:
    """L2 logistic regression equal to the C-parameterised objective:
    regParam = 1 / (C * n), no elastic net, no standardisation, intercept not penalised."""
    return LogisticRegression(regParam=1.0 / (C * n_rows), elasticNetParam=0.0,
                              standardization=False, fitIntercept=True, maxIter=200, tol=1e-10)


def positive_probability(df: DataFrame, prob_col: str = "probability", out: str = "p") -> DataFrame:
    """probability of class 1 from the model's probability vector."""
    return df.withColumn(out, vector_to_array(F.col(prob_col))[1])


def scored(model, df: DataFrame, out: str = "p") -> DataFrame:
    """``df`` with the model's probability of class 1; its raw scores and class are not laid out as columns."""
    m = model.copy()
    for p in ("predictionCol", "rawPredictionCol"):
        if m.hasParam(p):
            m.set(m.getParam(p), "")
    m.set(m.getParam("probabilityCol"), f"_prob_{out}")
    return positive_probability(m.transform(df), f"_prob_{out}", out).drop(f"_prob_{out}")


@dataclass
class OOFResult:
    oof: DataFrame
    models: list
    importances: DataFrame | None
    base: DataFrame | None = None
    curves: DataFrame | None = None       # (fold, iter, auc) where fits waited for the AUC

    def release(self) -> None:
        """Drop the materialised fit input once the OOF table has been consumed or written."""
        if self.base is not None:
            self.base.unpersist()


def persist_input(df: DataFrame, checkpoint: bool = False) -> DataFrame:
    """One materialisation shared by all fold fits: a reliable checkpoint (survives executor
    loss, cuts lineage) or a MEMORY_AND_DISK persist."""
    return df.checkpoint(eager=True) if checkpoint else df.persist(StorageLevel.MEMORY_AND_DISK)


#: Partitions of a small fit input, and bytes of vectors in a partition beyond that.
FIT_PARTITIONS, FIT_BYTES = 8, 256 << 20


def fit_partitions(rows: int, width: int) -> int:
    """Partitions for an iterative fit: every boosting level / optimiser step is a pass over the
    input, so per-task overhead repeats each pass. They follow from the table's size only, so a
    seeded fit that bags by partition gives the same model on any cluster."""
    return max(FIT_PARTITIONS, -(-rows * (8 * width + 64) // FIT_BYTES))


def fit_input(df: DataFrame, features_col: str = "features", checkpoint: bool = False,
              id_col: str | None = None) -> DataFrame:
    """Materialise once, then deal the rows for iterative fits: by ``id_col`` and in its order where
    it is given, so a partition holds the same rows in the same order on every run."""
    held = persist_input(df, checkpoint)
    rows, first = held.count(), held.select(features_col).first()
    parts = fit_partitions(rows, first[0].size if first is not None else 1)
    dealt = held.repartition(parts) if id_col is None else held.repartition(parts, id_col).sortWithinPartitions(id_col)
    out = persist_input(dealt, checkpoint)
    out.count()
    held.unpersist()
    return out


def staged_losses(model, df: DataFrame) -> list[float]:
    """The loss on ``df`` (features, label) after each boosting iteration."""
    return [float(v) for v in model.evaluateEachIteration(df)]


def best_prefix(losses: Sequence[float], wait: int) -> tuple[int, int]:
    """E5: (iterations to keep, iterations run) with early stopping after ``wait`` rounds without a
    new least loss."""
    best = 0
    for i, v in enumerate(losses):
        if v < losses[best]:
            best = i
        elif i - best >= wait:
            return best + 1, i + 1
    return best + 1, len(losses)


def truncated(model, iterations: int):
    """The boosted model of the first ``iterations`` trees."""
    from pyspark.ml.classification import GBTClassificationModel
    jvm, j = model._java_obj, SparkContext._active_spark_context._jvm
    trees, weights = jvm.trees()[:iterations], jvm.treeWeights()[:iterations]
    gateway = SparkContext._active_spark_context._gateway
    ts = gateway.new_array(j.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    ws = gateway.new_array(j.double, len(weights))
    for i, (t, w) in enumerate(zip(trees, weights)):
        ts[i], ws[i] = t, float(w)
    cut = j.org.apache.spark.ml.classification.GBTClassificationModel(f"{model.uid}_{iterations}", ts, ws, model.numFeatures, 2)
    out = GBTClassificationModel(cut)
    for name in ("featuresCol", "predictionCol", "probabilityCol", "rawPredictionCol", "labelCol"):
        cut.set(name, model.getOrDefault(name))
    return out


def fit_early_stopped(estimator, train: DataFrame, val: DataFrame, wait: int):
    """E5: fit all iterations, keep the best prefix on ``val`` by the waiting rule. Returns the
    model and the losses that were looked at."""
    model = estimator.fit(train)
    losses = staged_losses(model, val)
    keep, run = best_prefix(losses, wait)
    return truncated(model, keep), losses[:run]


def train_oof(df: DataFrame, estimator, k: int, features_col: str = "features", label_col: str = "target",
              fold_col: str = "fold", id_col: str = "id", early_stopping: bool = True,
              lineage: DataFrame | None = None, checkpoint: bool = False,
              keep: Sequence[str] = (), parallelism: int = 1, wait: int | None = None) -> OOFResult:
    """Fit one model per fold on the other folds (held-out fold as the early-stopping
    set when the estimator supports it), score the held-out fold, union the folds. ``estimator``
    may be a function of the fold, for settings that depend on the fold's training rows. With
    ``wait`` a boosted member stops when the held-out fold's AUC has not grown for that many
    iterations and keeps its best prefix.

    Boosted members grow together over rows packed once (``boost.fit_folds``), with or without ``wait``, and so
    do logistic ones of one setting for all folds (``logistic.fit_folds``); their
    input is materialised as it is dealt. Otherwise ``parallelism`` > 1 submits that many fold fits concurrently from driver threads (as Spark
    ML's ``CrossValidator`` does): each fit is its own set of jobs over the shared materialised
    input, so small fits overlap instead of leaving executors idle between their jobs."""
    spark = df.sparkSession
    cols = df.select(id_col, fold_col, label_col, features_col, *keep).withColumn(label_col, F.col(label_col).cast("double"))
    packed, logit = boost.can_fit(estimator), logistic.can_fit(estimator)
    models = None
    if packed or logit:
        base = cols if df.storageLevel.useMemory and not checkpoint else persist_input(cols, checkpoint)
    if logit:
        models = logistic.fit_folds(base, estimator, list(range(k)), features_col, label_col, fold_col)
        if models is None:
            base.unpersist()
    if not packed and models is None:
        base = fit_input(cols, features_col, checkpoint, id_col)

    curves: list[tuple[int, int, float]] = []

    def fit_fold(f: int):
        est = (estimator(f) if callable(estimator) else estimator).copy()
        est.setFeaturesCol(features_col).setLabelCol(label_col)
        if wait is not None:
            from riskweave.operators.staged import fit_patient
            model, aucs = fit_patient(est, base.where(F.col(fold_col) != f), base.where(F.col(fold_col) == f), wait, features_col, label_col, id_col)
            curves.extend((f, i, v) for i, v in enumerate(aucs))
            return model
        if early_stopping and est.hasParam("validationIndicatorCol"):
            est.setValidationIndicatorCol("_is_val")
            train = base.withColumn("_is_val", F.col(fold_col) == f)
        else:
            train = base.where(F.col(fold_col) != f)
        return est.fit(train)

    if packed:
        models = boost.fit_folds(base, estimator, list(range(k)), features_col, label_col, fold_col, id_col, early_stopping or wait is not None, wait, curves)
    elif models is None and parallelism > 1:
        from concurrent.futures import ThreadPoolExecutor
        with ThreadPoolExecutor(max_workers=min(parallelism, k)) as pool:
            models = list(pool.map(fit_fold, range(k)))
    elif models is None:
        models = [fit_fold(f) for f in range(k)]
    parts, imps = [], []
    for f, model in enumerate(models):
        val = base.where(F.col(fold_col) == f)
        parts.append(scored(model, val).select(id_col, fold_col, F.col(label_col).cast("int").alias(label_col), "p", *keep))
        if hasattr(model, "featureImportances"):
            vec = model.featureImportances.toArray()
            imps += [(f, i, float(v)) for i, v in enumerate(vec)]
    oof = assemble_oof(parts)
    imp_df = None
    if imps:
        imp_df = spark.createDataFrame(imps, "fold int, feature_idx int, importance double")
        if lineage is not None:
            names = lineage.select(F.col("idx").alias("feature_idx"), F.col("name").alias("feature"))
            imp_df = imp_df.join(maybe_broadcast(names, bound=len(imps)), "feature_idx", "left")
    curve_df = spark.createDataFrame(curves, "fold int, iter int, auc double") if curves else None
    return OOFResult(oof, models, imp_df, base, curve_df)


def node_table(spark: SparkSession, models: list) -> DataFrame:
    """(fold, tree, node, feature_idx, gain, cover) of the fitted trees' inner nodes, read from the
    models as Spark ML saves them. ``cover`` is the weight of the training rows at the node."""
    out = None
    for f, model in enumerate(models):
        path = scratch_path(spark, f"nodes/{uuid.uuid4().hex}")
        model.write().save(path)
        data = spark.read.parquet(f"{path}/data")
        tree = F.col("treeID") if "treeID" in data.columns else F.lit(0)
        # class counts in classification trees; count, sum, sum of squares in those of boosting
        counts = type(model).__name__ in ("DecisionTreeClassificationModel", "RandomForestClassificationModel")
        stats = F.col("nodeData.impurityStats")
        cover = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x) if counts else stats[0]
        part = data.where("nodeData.leftChild >= 0").select(
            F.lit(f).alias("fold"), tree.cast("int").alias("tree"), F.col("nodeData.id").alias("node"),
            F.col("nodeData.split.featureIndex").alias("feature_idx"), F.col("nodeData.gain").alias("gain"), cover.alias("cover"))
        out = part if out is None else out.unionByName(part)
    return out


def gain_importance(nodes: DataFrame, k: int, lineage: DataFrame | None = None) -> DataFrame:
    """F8: (feature_idx, gain, share, n_splits): impurity gain x cover of a feature's splits, summed
    over a fold's trees and averaged over the ``k`` folds (a fold without the feature counts 0), and
    its share of all gain. Features that no tree splits on have no row."""
    total = nodes.agg(F.sum(F.col("gain") * F.col("cover")).alias("_all"))      # one row
    out = (nodes.groupBy("feature_idx").agg((F.sum(F.col("gain") * F.col("cover")) / F.lit(float(k))).alias("gain"), F.count(F.lit(1)).alias("n_splits"))
           .join(F.broadcast(total)).withColumn("share", F.col("gain") * F.lit(float(k)) / F.col("_all")).drop("_all"))
    if lineage is not None:
        out = out.join(lineage.select(F.col("idx").alias("feature_idx"), F.col("name").alias("feature_name")), "feature_idx", "left")
    return out


def mean_importance(importances: DataFrame) -> DataFrame:
    """F8: mean importance over folds, largest first."""
    key = "feature" if "feature" in importances.columns else "feature_idx"
    return (importances.groupBy(key).agg(F.avg("importance").alias("importance"))
            .orderBy(F.desc("importance"), F.asc(key)))


def fold_average(models: list, df: DataFrame, features_col: str = "features", id_col: str = "id") -> DataFrame:
    """mean of the k fold models' probabilities per row, by chaining k transforms on the
    same rows (narrow: no shuffle, no join)."""
    out = df
    cols = []
    for i, m in enumerate(models):
        out = scored(m.copy().setFeaturesCol(features_col), out, f"_p{i}")
        cols.append(F.col(f"_p{i}"))
    mean = sum(cols[1:], cols[0]) / F.lit(float(len(cols)))
    return out.withColumn("p", mean).drop(*[f"_p{i}" for i in range(len(models))])


def refit(estimator, df: DataFrame, params: dict | None = None, features_col: str = "features",
          label_col: str = "target", id_col: str | None = None):
    """refit on all rows with chosen parameters; whole-number floats become ints. With ``id_col`` a
    boosted member is fitted over packed rows (``boost.fit_folds``)."""
    est = estimator.copy()
    for k, v in (params or {}).items():
        if isinstance(v, float) and v.is_integer():
            v = int(v)
        if est.hasParam(k):
            est.set(est.getParam(k), v)
    est.setFeaturesCol(features_col).setLabelCol(label_col)
    df = df.withColumn(label_col, F.col(label_col).cast("double"))
    if id_col is not None and boost.can_fit(est):
        return boost.fit_folds(df, est, [None], features_col, label_col, None, id_col, early_stopping=False)[0]
    return est.fit(df)
