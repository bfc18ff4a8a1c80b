"""Column-level feature operators (B2, D1-D19): role detection, encoders and their state.

State is always small and bounded (one value per column, categories below the low-card
threshold, one row per key for encoders) and is computed with aggregations; transforms are
narrow projections or joins against that state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions.hashing import MISSING_TOKEN
from riskweave.functions.missing import number
from riskweave.operators import sparse
from riskweave.operators.quantiles import exact_quantiles, long_form
from riskweave.operators.rank import maybe_broadcast

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                 T.DecimalType, T.BooleanType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def _pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct (column c, value v) pairs, map-side combined."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v"))
                                        for c in cols]))).distinct()


def distinct_incl_missing(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    """H6: exact distinct count of each column with missing counted as one more value.

    Computed in long form (column, value) with map-side distinct, so the cost is one pass and
    one shuffle of distinct pairs regardless of how many columns are asked for.
    """
    return _counts(_pairs(df, cols)) if cols else {}


def _counts(pairs: DataFrame) -> dict[str, int]:
    return {r["c"]: int(r["n"]) for r in pairs.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}


def detect_roles(df: DataFrame, id_cols: Sequence[str], target_col: str, date_cols: Sequence[str],
                 low_card_thresh: int = 30) -> dict:
    """B2: numeric / low-card / high-card split; strings with distinct (incl. missing) below the
    threshold are low-card.

    All counts are exact, in long form (one row per distinct (column, value) pair after map-side
    distinct). The sorted categories of the low-card columns are then collected from the same pairs:
    fewer than the threshold per column."""
    excluded = set(id_cols) | {target_col} | set(date_cols)
    nums = numeric_columns(df, excluded)
    strs = string_columns(df, excluded)
    pairs = _pairs(df, strs).persist(StorageLevel.MEMORY_AND_DISK) if strs else None
    try:
        counts = _counts(pairs) if strs else {}
        counts = {c: counts.get(c, 0) for c in strs}
        low = [c for c in strs if counts[c] < low_card_thresh]
        high = [c for c in strs if counts[c] >= low_card_thresh]
        cats = _value_lists(pairs, low, MISSING_TOKEN) if low else {}
    finally:
        if strs:
            pairs.unpersist()
    return {"numeric": nums, "low_card": low, "high_card": high,
            "date": [c for c in date_cols if c in df.columns], "distinct": counts,
            "categories": cats}


def medians(df: DataFrame, cols: Sequence[str], mode: str = "exact",
            accuracy: int = 100000) -> dict[str, float | None]:
    """D5 state: median of each column; None when all missing.

    ``exact`` (default): mean of the middle two, via two-level ranks over (column, value) cells.
    ``approx``: one pass of ``percentile_approx`` (bounded sketch per column and task), for
    tables where even the distinct (column, value) cells are too many to rank."""
    if not cols:
        return {}
    if mode == "approx":
        row = df.agg(*[F.percentile_approx(number(F.col(c)), 0.5, accuracy).alias(c)
                       for c in cols]).first()
        return {c: row[c] for c in cols}
    q = exact_quantiles(long_form(df, [], cols), ["column_name"], "value", [0.5], n_groups=len(cols))
    got = {r["column_name"]: r["value"] for r in q.collect()}
    return {c: got.get(c) for c in cols}


def moments(df: DataFrame, cols: Sequence[str], fills: dict[str, float | None]) -> dict[str, tuple]:
    """D6 state: mean and population std after imputation (one aggregation); NaN is missing."""
    exprs = []
    for c in cols:
        x = F.coalesce(number(F.col(c)), F.lit(fills.get(c)))
        exprs += [F.avg(x).alias(f"{c}__m"), F.stddev_pop(x).alias(f"{c}__s")]
    if not exprs:
        return {}
    row = df.agg(*exprs).first()
    return {c: (row[f"{c}__m"], row[f"{c}__s"]) for c in cols}


def scaled(c: str, fill: float | None, mean: float | None, std: float | None) -> Column:
    """(x - mean) / std after median fill; zero std divides by one."""
    x = F.coalesce(number(F.col(c)), F.lit(fill).cast("double"))
    sd = 1.0 if (std is None or std == 0.0) else std
    return (x - F.lit(mean).cast("double")) / F.lit(sd)


def _value_lists(pairs: DataFrame, cols: Sequence[str], fill: str) -> dict[str, list[str]]:
    rows = pairs.where(F.col("c").isin(*cols)).select("c", F.coalesce("v", F.lit(fill)).alias("v")).distinct().collect()
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in rows:
        out[r["c"]].append(r["v"])
    return {c: sorted(v, key=lambda x: x.encode("utf-8")) for c, v in out.items()}


def categories(df: DataFrame, cols: Sequence[str], fill: str = MISSING_TOKEN, limit: int = 1000) -> dict[str, list[str]]:
    """D8 state: sorted distinct values (missing spelled ``__missing__``) of low-card columns. The
    values come to the driver, so they are counted first: a column with more than ``limit``
    raises."""
    for c, n in distinct_incl_missing(df, cols).items():
        if n > limit:
            raise ValueError(f"column {c} has {n} distinct values, more than {limit}")
    return _value_lists(_pairs(df, cols), cols, fill) if cols else {}


def one_hot_columns(c: str, cats: Sequence[str], fill: str = MISSING_TOKEN) -> list[Column]:
    """One 0/1 column per known category; an unseen value is all zeros."""
    v = F.coalesce(F.col(c).cast("string"), F.lit(fill))
    return [(v == F.lit(k)).cast("double").alias(f"{c}={k}") for k in cats]


def one_hot_index(c: str, cats: Sequence[str], fill: str = MISSING_TOKEN) -> Column:
    """Position of the value among the sorted categories, NULL when unseen."""
    v = F.coalesce(F.col(c).cast("string"), F.lit(fill))
    at = F.array_position(F.array(*[F.lit(k) for k in cats]), v).cast("int")
    return F.when(at > 0, at - 1)


def hash_pairs(cols: Sequence[str], n: int) -> Column:
    """array<struct<bucket:int, sign:double>>, one pair per column's token: its :func:`hash_bucket` and
    :func:`hash_sign`, computed once per distinct value of a batch of rows."""
    return sparse.hash_pairs(cols, n)


def signed_sums(pairs: Column) -> Column:
    """array<struct<bucket:int, value:double>> in bucket order: colliding pairs are summed, exact
    zeros (cancelled collisions) dropped, a batch of rows at a time."""
    return sparse.signed_sums(pairs)


def hashed_entries(cols: Sequence[str], n: int) -> Column:
    """D10/D11 per row, no shuffle: signed sums of the columns' tokens per bucket."""
    return signed_sums(hash_pairs(cols, n))


def cat_fill(c: str, fill: str = "NA") -> Column:
    """Categorical fill before the string cast (missing becomes NA, not 'nan')."""
    return F.coalesce(F.col(c).cast("string"), F.lit(fill)).alias(c)


def label_codes(df: DataFrame, col: str) -> DataFrame:
    """B16/D17 state: dense 0-based code per distinct non-missing value in sorted order.
    The code table has one row per distinct value. Values are range-partitioned on the whole
    string; a value's code is its place in its partition plus the sizes of the partitions before."""
    from riskweave.operators.rank import dense_row_number, range_buckets
    vals = df.select(F.col(col).cast("string").alias(col)).where(F.col(col).isNotNull()).distinct()
    ranked = dense_row_number(range_buckets(vals, col, "_range"), [], [col], bucket=F.col("_range"), out_col="_rn")
    return ranked.select(col, (F.col("_rn") - 1).cast("long").alias("code"))


def frequency_table(df: DataFrame, col: str) -> DataFrame:
    """D16 state: share of rows per value (missing kept as its own value)."""
    n = df.select(F.count(F.lit(1)).cast("double")).scalar()
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("_c"))
            .select(col, (F.col("_c") / n).alias("freq")))


def encode_with(df: DataFrame, state: DataFrame, col: str, out: str, default=None) -> DataFrame:
    """Left join with counted-size broadcast; null-safe so a missing key can have a code."""
    st = maybe_broadcast(state)
    j = df.join(st, df[col].eqNullSafe(st[col]), "left").drop(st[col])
    if default is not None:
        j = j.withColumn(out, F.coalesce(F.col(out), F.lit(default)))
    return j


def group_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per-key mean / population std / count joined back to every row.

    Aggregated with map-side combine (a hot key costs no more than any other), then joined
    back null-safely through a counted-size broadcast; a window over the key would put a hot
    key's rows into one task."""
    v = F.col(value).cast("double")
    state = df.groupBy(key).agg(F.avg(v).alias(f"{value}_mean_by_{key}"),
                                F.stddev_pop(v).alias(f"{value}_std_by_{key}"),
                                F.count(v).alias(f"{value}_n_by_{key}"))
    return encode_with(df, state, key, f"{value}_n_by_{key}")
