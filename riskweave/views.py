"""Fixture views built from the supplied tables, each with its DuckDB SQL twin.

``telemetry`` (T) stands in for the wide telemetry table; ``preds`` for the long table of
out-of-fold predictions of three member models. Both are derived from ``orders`` /
``customer`` / ``lineitem``, so their size grows with the scale factor. The SQL twins are the
CTEs the oracle queries start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators.folds import stratified_kfold
from riskweave.sources.tables import load

MODELS = ("lgb", "cat", "xgb")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal",
                                               "c_mktsegment")
    first_ship = (load(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
                  .groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship")))
    j = (o.join(c, o.o_custkey == c.c_custkey, "inner")
         .join(first_ship, o.o_orderkey == first_ship.l_orderkey, "left"))
    idc = F.col("o_orderkey")

    def null_when(mod: int, v):
        return F.when(F.pmod(idc, F.lit(mod)) == 0, F.lit(None)).otherwise(v)

    return j.select(
        idc.alias("id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("target"),
        null_when(11, F.col("o_totalprice")).cast("double").alias("amount"),
        null_when(13, F.col("c_acctbal")).cast("double").alias("balance"),
        null_when(7, F.col("c_mktsegment")).alias("segment"),
        F.col("o_orderpriority").alias("priority"),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("nation"),
        F.col("c_name").alias("account"),
        null_when(19, F.concat(F.lit("C"), F.pmod(F.col("o_custkey"), F.lit(97)).cast("string"))).alias("city"),
        F.when(F.pmod(idc, F.lit(17)) == 0, F.lit("bad-date"))
         .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date_as"),
        F.col("first_ship").cast("string").alias("date_os"),
    )


T_SQL = """t AS (
  SELECT o.o_orderkey AS id,
         CAST(o.o_orderstatus = 'F' AS INTEGER) AS target,
         CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE o.o_totalprice END AS amount,
         CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE c.c_acctbal END AS balance,
         CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE c.c_mktsegment END AS segment,
         o.o_orderpriority AS priority,
         'N' || CAST(c.c_nationkey AS VARCHAR) AS nation,
         c.c_name AS account,
         CASE WHEN o.o_orderkey % 19 = 0 THEN NULL ELSE 'C' || CAST(o.o_custkey % 97 AS VARCHAR) END AS city,
         CASE WHEN o.o_orderkey % 17 = 0 THEN 'bad-date' ELSE strftime(o.o_orderdate, '%Y-%m-%d') END AS date_as,
         CAST(fs.first_ship AS VARCHAR) AS date_os
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS first_ship FROM lineitem GROUP BY l_orderkey) fs
    ON o.o_orderkey = fs.l_orderkey
)"""

# Stratified 5-fold with seed 42, plain-window form (the Spark side uses the two-level rank).
FOLDS_SQL = """tf AS (
  SELECT t.*, CAST((row_number() OVER (PARTITION BY target ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) - 1) % 5 AS INTEGER) AS fold
  FROM t
)"""


def telemetry_folds(spark: SparkSession, sf_dir: str, k: int = 5, seed: int = 42) -> DataFrame:
    return stratified_kfold(telemetry(spark, sf_dir), "id", "target", k=k, seed=seed)


def member_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide member predictions per id: lgb, cat, xgb (deterministic, with plenty of ties)."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return o.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_totalprice") / F.lit(500000.0)).alias("lgb"),
        (F.pmod(F.col("o_orderkey") * 37, F.lit(101)) / F.lit(101.0)).alias("cat"),
        (F.pmod(F.col("o_custkey") * 53, F.lit(89)) / F.lit(89.0)).alias("xgb"),
    )


def preds_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, fold, target, lgb, cat, xgb: one row per id (the stack matrix shape)."""
    tf = telemetry_folds(spark, sf_dir).select("id", "fold", "target")
    return tf.join(member_scores(spark, sf_dir), "id")


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long predictions: id, model, fold, target, p (one row per id and model)."""
    return preds_long(preds_wide(spark, sf_dir))


def preds_long(w: DataFrame) -> DataFrame:
    """The stack matrix as long predictions."""
    return w.select("id", "fold", "target",
                    F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("p"))
                                       for m in MODELS])))


PREDS_SQL = """pw AS (
  SELECT tf.id, tf.fold, tf.target,
         o.o_totalprice / 500000.0 AS lgb,
         ((o.o_orderkey * 37) % 101) / 101.0 AS cat,
         ((o.o_custkey * 53) % 89) / 89.0 AS xgb
  FROM tf JOIN orders o ON tf.id = o.o_orderkey
),
preds AS (
  SELECT id, 'lgb' AS model, fold, target, lgb AS p FROM pw
  UNION ALL SELECT id, 'cat', fold, target, cat FROM pw
  UNION ALL SELECT id, 'xgb', fold, target, xgb FROM pw
)"""


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BASE_SQL = with_sql(T_SQL, FOLDS_SQL, PREDS_SQL)
