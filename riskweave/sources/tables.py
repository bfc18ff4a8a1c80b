"""Table sources and sinks (A1-A3): parquet / CSV / JSON with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied parquet tables; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_table(spark: SparkSession, path: str, schema: StructType | None = None,
               fmt: str = "csv") -> DataFrame:
    """A1: header CSV (or parquet / json). With a schema nothing is inferred (no extra scan)."""
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", True).option("mode", "PERMISSIVE")
        if schema is not None:
            reader = reader.schema(schema)
        else:
            reader = reader.option("inferSchema", True)
        return reader.csv(path)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(fmt).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """A2/A3: write without any index column; header for CSV."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
