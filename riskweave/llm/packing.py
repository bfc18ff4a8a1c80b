"""Best-fit packing of texts into sequences, with conflicts.

A bin holds ``capacity`` bytes, and at most one text of each source and of each duplicate
cluster: it carries both as bitmaps. Open bins are kept in the order of their residual; a text
takes the successor of its size in that order, and the search goes on to the next larger residual
until a bin is compatible, which is then the tightest compatible one; else it opens a bin. Texts
come by decreasing size.

Texts longer than a bin are cut into whole bins and a rest; nothing is dropped. Records are dealt
by hash into groups of about ``group_rows`` pieces that are packed on their own (equal rows carry
a copy number into the hash, so none of them makes a large group): each group's last, half-empty
bins are the price, a vanishing share of the whole.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 8192
GROUP_ROWS = 16_384


def pack(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """The bin of each piece (in the given order, bins numbered as they are opened)."""
    bit = lambda values: {v: 1 << k for k, v in enumerate(dict.fromkeys(v for v in values if v is not None))}
    of_source, of_cluster = bit(sources), bit(clusters)
    residual: list[tuple[int, int]] = []                     # open bins by (residual, number)
    has: list[list[int]] = []                                # bitmaps of each bin
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        s, d = of_source.get(source, 0), of_cluster.get(cluster, 0)
        at = bisect_left(residual, (size, -1))
        while at < len(residual):
            own = has[residual[at][1]]
            if not (own[0] & s or own[1] & d):
                break
            at += 1
        if at < len(residual):
            left, b = residual.pop(at)
            has[b][0] |= s
            has[b][1] |= d
        else:
            left, b = capacity, len(has)
            has.append([s, d])
        if left > size:
            insort(residual, (left - size, b))
        out.append(b)
    return out


def _pack_group(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "hash", "copy", "piece"], ascending=[False, True, True, True], kind="stable")
        none = lambda col: [None if pd.isna(v) else v for v in col.tolist()]
        pdf["bin"] = pack(pdf["size"].tolist(), none(pdf["source"]), none(pdf["cluster"]), capacity)
        by = pdf.groupby("bin")["size"]
        pdf["bin_start"] = by.cumsum() - pdf["size"]
        pdf["bin_used"] = by.transform("sum")
        return pdf[["id", "copy", "piece", "start", "size", "source", "cluster", "pack_group", "bin", "bin_start", "bin_used"]]

    return run


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                     cluster_col: str | None = None, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, seed: int = 5) -> DataFrame:
    """One row per piece of each text: ``id_col``, ``copy``, ``piece``, ``start`` (byte in the text),
    ``size`` (bytes of the piece, and a separator after the last), ``source``, ``cluster``, and its
    place: ``pack_group``, ``bin``, ``bin_start``, ``bin_used``.

    ``cluster_col`` names a column of cluster ids; without it equal texts make a cluster. A null
    text is empty (its piece is a separator); a null source conflicts with nothing; repeated rows
    are numbered by ``copy`` and share a cluster; other columns are not read; an empty table
    gives no rows."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    cluster = F.xxhash64(text) if cluster_col is None else F.col(cluster_col).cast("long")
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), cluster.alias("cluster"),
                       (F.octet_length(text) + 1).cast("long").alias("total"))
    rows = (rows.groupBy("id", "source", "cluster", "total").agg(F.count("*").alias("n"))
            .select("id", "source", "cluster", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy")))
    pieces = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / capacity))).alias("piece")).select(
        "id", "copy", "piece", "source", "cluster", (F.col("piece") * capacity).alias("start"),
        F.least(F.lit(capacity).cast("long"), F.col("total") - F.col("piece") * capacity).alias("size"),
        F.xxhash64(F.lit(seed), "id", "cluster", "copy", "piece").alias("hash"))
    bytes_, n = docs.agg(F.sum(F.octet_length(text) + 1), F.count("*")).first()
    groups = max(1, -(-(n + (bytes_ or 0) // capacity) // group_rows))
    out = pieces.withColumn("pack_group", F.pmod("hash", F.lit(groups)).cast("int")).groupBy("pack_group").applyInPandas(
        _pack_group(capacity), f"id {id_type}, copy long, piece long, start long, size long, source string, cluster long, "
        "pack_group int, bin long, bin_start long, bin_used long")
    return out.withColumnRenamed("id", id_col)
