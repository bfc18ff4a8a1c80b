"""Out-of-fold target encoding (D13) and its full-fit apply.

Reference formula: enc = (s * global_mean + key_mean) / (s + 1), where key_mean is the mean of
the target for the key over the *other* folds (train) or over all rows (apply), and a key that
is missing, unseen or only present in the held-out fold takes the global mean.

One pass, no per-fold loop: sums per (key, fold) are aggregated with map-side combine, key
totals come from a window over that small state table, and "other folds" = key total minus the
fold's own cell. The state (keys x folds rows) is joined back with a broadcast when its counted
size allows, otherwise with a shuffle join that AQE splits when one key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.rank import maybe_broadcast


def _global_mean(df: DataFrame, target_col: str):
    """Global target mean as a scalar subquery (evaluated inside the plan)."""
    return df.select(F.avg(F.col(target_col).cast("double"))).scalar()


def _encode(mean_col, n_col, gm, smoothing: float, count_weighted: bool):
    g = gm if not isinstance(gm, (int, float)) else F.lit(gm)
    s = F.lit(float(smoothing))
    if count_weighted:
        # (n * mean + s * prior) / (n + s): the group size enters the shrinkage
        return F.when(n_col > 0, (n_col * mean_col + s * g) / (n_col + s)).otherwise(g)
    return (s * g + F.coalesce(mean_col, g)) / (s + F.lit(1.0))


def join_state_split_hot(df: DataFrame, state: DataFrame, cells: DataFrame, key_col: str,
                         fold_col: str, hot_key_rows: int) -> DataFrame:
    """Left join of rows to the (key, fold) state with hot keys split off.

    Keys holding more than ``hot_key_rows`` rows number at most rows / hot_key_rows (a proven
    bound), so their slice of the state (x folds) is broadcast to the hot rows; every other row
    takes the ordinary join, which then carries no heavy key. Exact: each row meets the same
    state row either way. One small job reads the totals off the aggregated cells."""
    tot = cells.agg(F.sum("_nf").alias("rows"), F.countDistinct(fold_col).alias("folds")).first()
    bound = max(1, int(tot["rows"] or 0) // max(1, hot_key_rows))
    hot = (cells.groupBy(key_col).agg(F.sum("_nf").alias("_rows"))
           .where(F.col("_rows") > F.lit(hot_key_rows)).select(key_col))
    hot_keys = maybe_broadcast(hot, bound=bound)
    hot_state = maybe_broadcast(state.join(hot_keys, key_col, "left_semi"),
                                bound=bound * max(1, int(tot["folds"] or 1)))
    hot_part = df.join(hot_keys, key_col, "left_semi").join(hot_state, [key_col, fold_col], "left")
    cold_part = df.join(hot_keys, key_col, "left_anti").join(maybe_broadcast(state), [key_col, fold_col], "left")
    return hot_part.unionByName(cold_part)


def target_encode_oof(df: DataFrame, key_col: str, fold_col: str = "fold", target_col: str = "target",
                      smoothing: float = 10.0, out_col: str = "enc", count_weighted: bool = False,
                      fold_safe_prior: bool = False, hot_key_rows: int | None = None) -> DataFrame:
    """Adds ``out_col`` to every row of ``df`` (which must carry ``fold_col``). With
    ``hot_key_rows`` the state join splits hot keys off (see :func:`join_state_split_hot`);
    by default adaptive execution broadcasts the state or splits skewed partitions itself."""
    y = F.col(target_col).cast("double")
    cells = (df.where(F.col(key_col).isNotNull())
             .groupBy(key_col, fold_col).agg(F.sum(y).alias("_sf"), F.count(F.lit(1)).alias("_nf")))
    wk = Window.partitionBy(key_col)
    state = cells.select(
        key_col, fold_col,
        F.try_divide(F.sum("_sf").over(wk) - F.col("_sf"),
                     (F.sum("_nf").over(wk) - F.col("_nf")).cast("double")).alias("_m"),
        (F.sum("_nf").over(wk) - F.col("_nf")).alias("_n"))
    if fold_safe_prior:
        # prior from the training part of each fold only (no held-out rows leak into it)
        fold_tot = df.groupBy(fold_col).agg(F.sum(y).alias("_fs"), F.count(F.lit(1)).alias("_fn"))
        ts = df.select(F.sum(y)).scalar()
        tn = df.select(F.count(F.lit(1))).scalar()
        priors = fold_tot.select(fold_col, ((ts - F.col("_fs")) / (tn - F.col("_fn"))).alias("_gm"))
        out = (df.join(maybe_broadcast(priors), fold_col, "left")
               .join(maybe_broadcast(state), [key_col, fold_col], "left"))
        g = F.col("_gm")
        s = F.lit(float(smoothing))
        enc = ((F.col("_n") * F.col("_m") + s * g) / (F.col("_n") + s) if count_weighted
               else (s * g + F.coalesce(F.col("_m"), g)) / (s + F.lit(1.0)))
        if count_weighted:
            enc = F.when(F.col("_n") > 0, enc).otherwise(g)
        return out.withColumn(out_col, enc).drop("_m", "_n", "_gm")
    gm = _global_mean(df, target_col)
    if hot_key_rows is not None:
        out = join_state_split_hot(df, state, cells, key_col, fold_col, hot_key_rows)
    else:
        out = df.join(maybe_broadcast(state), [key_col, fold_col], "left")
    return out.withColumn(out_col, _encode(F.col("_m"), F.col("_n"), gm, smoothing, count_weighted)) \
              .drop("_m", "_n")


class TargetEncoding:
    """D14 fitted state: mean target per key plus the global mean."""

    def __init__(self, key_col: str, state: DataFrame, global_mean: float, smoothing: float,
                 count_weighted: bool = False):
        self.key_col, self.state, self.global_mean = key_col, state, global_mean
        self.smoothing, self.count_weighted = smoothing, count_weighted

    @classmethod
    def fit(cls, df: DataFrame, key_col: str, target_col: str = "target", smoothing: float = 10.0,
            count_weighted: bool = False) -> "TargetEncoding":
        y = F.col(target_col).cast("double")
        state = (df.where(F.col(key_col).isNotNull()).groupBy(key_col)
                 .agg(F.avg(y).alias("_m"), F.count(F.lit(1)).alias("_n")))
        return cls(key_col, state, _global_mean(df, target_col), smoothing, count_weighted)

    def transform(self, df: DataFrame, out_col: str = "enc") -> DataFrame:
        out = df.join(maybe_broadcast(self.state), self.key_col, "left")
        enc = _encode(F.col("_m"), F.coalesce(F.col("_n"), F.lit(0)), self.global_mean,
                      self.smoothing, self.count_weighted)
        return out.withColumn(out_col, enc).drop("_m", "_n")


def per_fold_encodings(df: DataFrame, key: str, k: int = 5, smoothing: float = 10.0) -> DataFrame:
    """(key, fold, enc) for every key and fold model f: smoothed mean of rows outside fold f,
    global mean (of rows outside f) for a key absent there. One aggregation, one window."""
    y = F.col("target").cast("double")
    cells = df.where(F.col(key).isNotNull()).groupBy(key, "fold").agg(F.sum(y).alias("_s"), F.count(F.lit(1)).alias("_n"))
    folds_tot = df.groupBy("fold").agg(F.sum(y).alias("_fs"), F.count(F.lit(1)).alias("_fn"))
    tot = df.agg(F.sum(y).alias("s"), F.count(F.lit(1)).alias("n")).first()
    gms = {r["fold"]: (tot["s"] - r["_fs"]) / (tot["n"] - r["_fn"]) for r in folds_tot.collect()}
    keys = cells.select(key).distinct()
    grid = keys.select(key, F.explode(F.array(*[F.lit(f) for f in range(k)])).alias("fold"))
    wk = Window.partitionBy(key)
    st = (grid.join(cells, [key, "fold"], "left").fillna(0, subset=["_s", "_n"])
          .select(key, "fold", (F.sum("_s").over(wk) - F.col("_s")).alias("_os"),
                  (F.sum("_n").over(wk) - F.col("_n")).alias("_on")))
    gm_map = F.create_map(*[x for f, g in gms.items() for x in (F.lit(f), F.lit(float(g)))])
    gm = gm_map[F.col("fold")]
    enc = (F.lit(smoothing) * gm + F.coalesce(F.try_divide(F.col("_os"), F.col("_on").cast("double")), gm)) \
        / F.lit(smoothing + 1.0)
    gm_avg = float(sum(((smoothing * g + g) / (smoothing + 1.0)) for g in gms.values()) / len(gms))
    return st.select(key, "fold", enc.alias("enc"), F.lit(gm_avg).alias("gm_avg"))
