"""Two-pass external shuffle of whole records into shards, in DataFrame operations only.

Pass 1 scatters the records uniformly into buckets of at most about ``bucket_rows`` rows and
``bucket_bytes`` bytes of text by a seeded hash, so a bucket fits in a task's memory at any table
size. Pass 2 permutes each bucket with Spark's seeded Fisher-Yates ``shuffle`` and writes it. A
record's place in the whole order is its bucket's offset plus its place in the bucket. Shards are
equal runs of places: row counts differ by at most one (law ``rows``), slots are gapless, and a
bucket is written as one file (two where it crosses from one shard to the next).

The records are numbered by their place in a staged table, so that repeated rows scatter like
others, without any group of them. Its files, the number of partitions (which follows from the
table's size, not from adaptive execution) and so the permutation are the same when a task runs
again after a lost executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm import common as c

BUCKET_ROWS = 16_384
BUCKET_BYTES = 16 << 20


def _places(rows: DataFrame, seed: int, bucket_rows: int, bucket_bytes: int) -> tuple[DataFrame, int]:
    """The rows (``_id, _size, _crc`` and others) as struct ``r`` with their ``place`` from 0, and
    their number."""
    rows = c.stage(rows)
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("_size"), F.lit(0))).first()
    buckets = max(1, -(-n // bucket_rows), -(-total // bucket_bytes))
    number = F.monotonically_increasing_id()
    scattered = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "_id", "_crc", number), F.lit(buckets)))
    mixed = (scattered.repartition(min(buckets, 100_000), "bucket").sortWithinPartitions("bucket", "_id", "_crc", "_size")
             .groupBy("bucket").agg(F.collect_list(F.struct(*rows.columns)).alias("rows")).select("bucket", F.shuffle("rows", seed).alias("rows")))
    counts = scattered.select("bucket").groupBy("bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))      # one row per bucket
    offsets = counts.select("bucket", F.coalesce(before, F.lit(0)).alias("before"))
    out = mixed.join(offsets, "bucket").select("before", F.posexplode("rows").alias("pos", "r"))
    return out.select("r", (F.col("before") + F.col("pos")).alias("place")), n


def _shards(placed: DataFrame, n: int, shards: int) -> DataFrame:
    """``r``, ``shard`` and ``slot``: shard k holds the places from ceil(k * n / shards) on."""
    cols = placed.withColumn("shard", F.expr(f"cast((place * {shards}) div {max(n, 1)} as int)"))
    return cols.select("r", "shard", F.expr(f"place - (shard * {n}L + {shards - 1}) div {shards}").alias("slot"))


def _keys(id_col: str, text_col: str) -> list:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("_size"), F.crc32(text).alias("_crc")]


def _check(shards: int, bucket_rows: int, bucket_bytes: int) -> None:
    if min(shards, bucket_rows, bucket_bytes) < 1:
        raise ValueError("shards, bucket_rows and bucket_bytes must be positive")


def place(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, seed: int = 17,
          bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = 1 << 62) -> DataFrame:
    """The shuffle of ids alone, nothing written. Per input row: ``id_col``, ``size`` (UTF-8 bytes of
    the text plus 1), ``text_crc32``, ``shard`` and ``slot``.

    A null text counts as empty (size 1, CRC 0), a text of any length by its size; a null id is a
    value like any other; repeated rows get a slot each; other columns are not read. An empty
    table gives no rows."""
    _check(shards, bucket_rows, bucket_bytes)
    placed, n = _places(docs.select(*_keys(id_col, text_col)), seed, bucket_rows, bucket_bytes)
    return _shards(placed, n, shards).select(F.col("r._id").alias(id_col), F.col("r._size").alias("size"),
                                             F.col("r._crc").alias("text_crc32"), "shard", "slot")


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = 8,
                 seed: int = 17, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write the whole records, struct ``record`` with all columns as they are (clashing names
    included), and their ``slot`` to ``path/shard=K``. Raises if ``path`` exists.

    Nulls, repeated rows and empty tables as with :func:`place`. A bucket is as large as its
    longest text at least: a task holds a few copies of it."""
    _check(shards, bucket_rows, bucket_bytes)
    placed, n = _places(docs.select(F.struct(*[docs[x] for x in docs.columns]).alias("record"), *_keys(id_col, text_col)),
                        seed, bucket_rows, bucket_bytes)
    (_shards(placed, n, shards).select(F.col("r.record").alias("record"), "slot", "shard")
     .write.mode("errorifexists").option("compression", "zstd").partitionBy("shard").parquet(path))


def read_shards(docs: DataFrame, path: str) -> DataFrame:
    """The records written from ``docs``: ``record``, ``slot`` and ``shard``."""
    record = docs.schema.simpleString()
    return docs.sparkSession.read.schema(f"record {record}, slot long, shard int").parquet(path)
