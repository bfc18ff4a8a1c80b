"""Artifact discovery (A8) and model / state persistence paths.

Files are found through the data source itself: reading the folder with partition discovery
and ``_metadata.file_path`` gives (kind, model, file, rows) in one aggregation; no globbing
by name patterns, and nothing is read twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def registry(spark: SparkSession, root: str, expected_rows: int,
             exclude_kinds: tuple[str, ...] = ("stack",)) -> DataFrame:
    files = (spark.read.option("basePath", root).parquet(root)
             .select("kind", "model", F.col("_metadata.file_path").alias("path"))
             .where(~F.col("kind").isin(*exclude_kinds))
             .groupBy("kind", "model", "path").agg(F.count(F.lit(1)).alias("n_rows")))
    per_member = files.groupBy("kind", "model").agg(F.sum("n_rows").alias("_member_rows"))
    return (files.join(per_member, ["kind", "model"])
            .select("model", "kind", "path", F.col("n_rows").cast("long").alias("n_rows"),
                    (F.col("_member_rows") == F.lit(expected_rows)).alias("usable")))


def discover(spark: SparkSession, root: str, expected_rows: int, pred_cols: tuple[str, ...] = ("p", "prob", "proba", "pred")) -> DataFrame:
    """A8, tolerant: one row per file below ``root``: model and folder of the file (its last two
    folders' names), file, n_rows, pred_col (the first of ``pred_cols`` with a value) and reason
    (null: usable): ``unreadable or empty``, ``no prediction column`` or ``row count``, for which
    a model's files of one folder are counted together.

    Files are listed by the file source without reading them, and probed in one pass that reads
    the candidate columns only; a file that cannot be read gives no rows there. Files of no bytes at
    all are not listed: Spark's file sources pass them over."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!_.]*").load(root)
             .select(F.col("path").alias("file")))
    schema = ", ".join(f"{x} double" for x in pred_cols)
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("pathGlobFilter", "[!_.]*").parquet(root)
    first = F.coalesce(*[F.when(F.col(f"_n_{x}") > 0, F.lit(x)) for x in pred_cols], F.lit(None).cast("string"))
    seen = (rows.groupBy(F.col("_metadata.file_path").alias("_path")).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(x).alias(f"_n_{x}") for x in pred_cols])
            .select("_path", "n_rows", first.alias("pred_col")))
    # both sources name a file by its URI, but differ in the slashes after the scheme
    bare = lambda x: F.regexp_replace(x, "^([a-z0-9]+):/+", "$1:/")
    found = files.join(seen, bare("file") == bare("_path"), "left").select(
        F.element_at(F.split("file", "/"), -3).alias("model"), F.element_at(F.split("file", "/"), -2).alias("folder"), "file",
        F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), "pred_col")
    total = found.where("pred_col is not null").groupBy("model", "folder").agg(F.sum("n_rows").alias("_total"))
    reason = (F.when(F.col("n_rows") == 0, "unreadable or empty").when(F.col("pred_col").isNull(), "no prediction column")
              .when(F.col("_total") != expected_rows, "row count"))
    return found.join(total, ["model", "folder"], "left").select("model", "folder", "file", "n_rows", "pred_col", reason.alias("reason"))


def model_path(root: str, family: str, fold: int | None = None) -> str:
    """models/<family>/fold=<k> (or /full for a refit on all rows)."""
    return f"{root.rstrip('/')}/models/{family}/" + (f"fold={fold}" if fold is not None else "full")


def save_models(models: list, root: str, family: str) -> list[str]:
    """A5: one Spark ML model per fold, ``models/<family>/fold=<k>`` (MLWriter, overwrite)."""
    paths = []
    for k, m in enumerate(models):
        p = model_path(root, family, k)
        m.write().overwrite().save(p)
        paths.append(p)
    return paths


def load_models(model_cls, paths: list[str]) -> list:
    """A5: the fold models back, in fold order (no name-pattern globbing)."""
    return [model_cls.load(p) for p in paths]


def save_attribution(attr: DataFrame, path: str) -> None:
    """Long attributions (id, feature_idx, phi, ...) as parquet, partitioned by model
    when present so one member can be read alone (partition pruning)."""
    w = attr.write.mode("overwrite").option("compression", "zstd")      # repeated values of one-hot features pack well
    if "model" in attr.columns:
        w = w.partitionBy("model")
    w.parquet(path)


def load_attribution(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("model") == model) if model is not None else df


def match_members(members: DataFrame, folders: DataFrame, model_col: str = "model", folder_col: str = "folder") -> DataFrame:
    """J-g: for each member (named ``<family>_...``) the folder of submissions whose name contains its
    family, in any case: model, folder (null: none), exact (the family is a whole token of the
    name), n_matches. Of several a whole token goes first, then the shorter name, then its order.

    "Is contained in" is an equi-join: a folder's name gives all its pieces up to the length of the
    longest family as keys. Names are short, so there are at most a few thousand per folder."""
    family = F.lower(F.split(model_col, "_")[0])
    fam = members.select(F.col(model_col).alias("model"), family.alias("_key")).distinct()
    longest = fam.agg(F.coalesce(F.max(F.length("_key")), F.lit(0))).first()[0]
    names = folders.select(F.col(folder_col).alias("_folder"), F.lower(folder_col).alias("_low")).where("length(_low) > 0").distinct()
    starts = names.select("_folder", "_low", F.explode(F.expr("sequence(1, length(_low))")).alias("_at"))
    pieces = starts.select("_folder", "_low", F.explode(F.expr(
        f"transform(sequence(1, greatest(1, least({int(longest)}, length(_low) - _at + 1))), n -> substring(_low, _at, n))")).alias("_key")).distinct()
    exact = F.array_contains(F.split("_low", "[^a-z0-9]+"), F.col("_key"))
    best = F.struct((~exact).alias("part"), F.length("_folder").alias("len"), F.col("_folder").alias("folder"))
    found = fam.where("_key != ''").join(pieces, "_key").groupBy("model").agg(F.min(best).alias("_b"), F.count(F.lit(1)).alias("n_matches"))
    return members.select(F.col(model_col).alias("model")).distinct().join(found, "model", "left").select(
        "model", F.col("_b.folder").alias("folder"), (~F.col("_b.part")).alias("exact"), F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"))
