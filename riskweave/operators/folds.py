"""Fold assignment and cross-validation splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.hashing import seeded_key
from riskweave.operators.rank import dense_row_number

# md5 hex prefix width used as the first rank level: 16^4 = 65536 uniform buckets, so each
# (class, bucket) window holds ~1/65536 of a class even at 1000x the test data; the offsets
# table (classes x 65536 rows) stays a few MB.
_PREFIX_HEX = 4


def _md5_order(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    return df.withColumn("_fkey", seeded_key(seed, F.col(id_col)))


def _prefix_bucket():
    return F.conv(F.substring("_fkey", 1, _PREFIX_HEX), 16, 10).cast("int")


def stratified_kfold(df: DataFrame, id_col: str = "id", target_col: str = "target", k: int = 5,
                     seed: int = 42, out_col: str = "fold") -> DataFrame:
    """Within each class, rows ordered by md5('<seed>:<id>'), id; fold = (rank-1) mod k.

    Class fold sizes differ by at most one. The rank is two-level (md5 prefix bucket, then a
    window inside the bucket), so a binary target does not put the table into two tasks.
    """
    keyed = _md5_order(df, id_col, seed)
    ranked = dense_row_number(keyed, [target_col], ["_fkey", id_col], bucket=_prefix_bucket(),
                              out_col="_rn")
    return ranked.withColumn(out_col, F.pmod(F.col("_rn") - 1, F.lit(k)).cast("int")).drop("_rn", "_fkey")


def kfold(df: DataFrame, id_col: str = "id", k: int = 5, seed: int = 42,
          out_col: str = "fold") -> DataFrame:
    """Shuffled K-fold without strata; fold sizes differ by at most one."""
    keyed = _md5_order(df, id_col, seed)
    ranked = dense_row_number(keyed, [], ["_fkey", id_col], bucket=_prefix_bucket(), out_col="_rn")
    return ranked.withColumn(out_col, F.pmod(F.col("_rn") - 1, F.lit(k)).cast("int")).drop("_rn", "_fkey")


def split(df: DataFrame, fold: int, fold_col: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(train, validation) for one fold over the same (cached) input."""
    return df.filter(F.col(fold_col) != fold), df.filter(F.col(fold_col) == fold)


def fold_balance(df: DataFrame, fold_col: str = "fold", target_col: str = "target") -> DataFrame:
    return df.groupBy(fold_col, target_col).agg(F.count(F.lit(1)).alias("n"))


def assemble_oof(scored_folds: list[DataFrame]) -> DataFrame:
    """Union of the k scored validation folds; each id appears once."""
    out = scored_folds[0]
    for d in scored_folds[1:]:
        out = out.unionByName(d)
    return out
