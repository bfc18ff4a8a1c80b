"""FeatureSpec -> FeatureModel (D20): fit a few bounded aggregations, transform with projections.

fit (over one persisted copy of the input):
       1 pass  exact distinct counts of the string columns (long form)
       1 pass  sorted categories of the columns below the threshold
       1 pass  date maxima
       1 job   exact medians (two-level quantiles, no single-task merge; or one sketch pass)
       1 pass  mean / population std after imputation
transform: narrow projections (no shuffle); the feature vector is date parts/ages |
       scaled numerics | one-hot | signed hashed buckets, described row by row by ``lineage()``,
       and built from sparse entries: its cost follows the input columns, not its width.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.dates import age_days, date_parts, parse_datetime
from riskweave.functions.missing import nan_to_null
from riskweave.operators import features as fx
from riskweave.operators import sparse


@dataclass
class FeatureSpec:
    n_hash_features: int = 64
    low_card_thresh: int = 30
    id_cols: tuple = ("MachineID",)
    date_cols: tuple = ("DateAS", "DateOS")
    target_col: str = "target"
    age_mode: str = "fitted"          # "fitted": max date is state; "batch": max of each batch
    median_mode: str = "exact"        # "exact" (parity) or "approx" (one sketch pass)

    def fit(self, df: DataFrame, written: bool = False) -> "FeatureModel":
        """``written``: the input is read from a columnar table, so each pass reads its columns there."""
        # fit makes a handful of small-output passes; they share one persisted copy of the input,
        # released once the (bounded) state is on the driver
        from pyspark import StorageLevel
        if written:
            return self._fit(nan_to_null(df))
        df = nan_to_null(df).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._fit(df)
        finally:
            df.unpersist()

    def _fit(self, df: DataFrame) -> "FeatureModel":
        roles = fx.detect_roles(df, self.id_cols, self.target_col, self.date_cols,
                                self.low_card_thresh)
        dates = roles["date"]
        date_max = {}
        if dates:
            row = df.agg(*[F.max(parse_datetime(F.col(c), df.schema[c].dataType)).alias(c) for c in dates]).first()
            date_max = {c: (row[c].isoformat(sep=" ") if row[c] is not None else None) for c in dates}
        med = fx.medians(df, roles["numeric"], mode=self.median_mode)
        nums = [c for c in roles["numeric"] if med.get(c) is not None]   # all-missing: dropped
        mom = fx.moments(df, nums, med)
        cats = roles["categories"]                # sorted low-card values from the detection pass
        state = FeatureState(
            numeric=nums, low_card=roles["low_card"], high_card=roles["high_card"], dates=dates,
            date_max=date_max, medians={c: med[c] for c in nums},
            means={c: mom[c][0] for c in nums}, stds={c: mom[c][1] for c in nums},
            categories=cats, n_hash=self.n_hash_features, id_cols=list(self.id_cols),
            target_col=self.target_col, age_mode=self.age_mode,
            distinct=roles["distinct"])
        return FeatureModel(state)


@dataclass
class FeatureState:
    numeric: list
    low_card: list
    high_card: list
    dates: list
    date_max: dict
    medians: dict
    means: dict
    stds: dict
    categories: dict
    n_hash: int
    id_cols: list
    target_col: str
    age_mode: str = "fitted"
    distinct: dict = field(default_factory=dict)


class FeatureModel:
    def __init__(self, state: FeatureState):
        self.state = state

    # ------------------------------------------------------------ columns
    def date_columns(self, df: DataFrame) -> list:
        s = self.state
        out = []
        batch_max = {}
        if s.age_mode == "batch" and s.dates:
            row = df.agg(*[F.max(parse_datetime(F.col(c), df.schema[c].dataType)).alias(c)
                           for c in s.dates if c in df.columns]).first()
            batch_max = {c: (row[c].isoformat(sep=" ") if row[c] is not None else None)
                         for c in s.dates if c in df.columns}
        for c in s.dates:
            ts = (parse_datetime(F.col(c), df.schema[c].dataType) if c in df.columns
                  else F.lit(None).cast("timestamp_ntz"))
            mx = batch_max.get(c) if s.age_mode == "batch" else s.date_max.get(c)
            out += [x.cast("double") for x in date_parts(ts, c)]
            out.append(age_days(ts, mx).cast("double").alias(f"{c}_age_days"))
        return out

    def numeric_columns(self) -> list:
        s = self.state
        return [fx.scaled(c, s.medians[c], s.means[c], s.stds[c]).alias(c) for c in s.numeric]

    def one_hot_columns(self) -> list:
        s = self.state
        return [col for c in s.low_card for col in fx.one_hot_columns(c, s.categories[c])]

    def names(self) -> list[str]:
        return [r[1] for r in self.lineage_rows()]

    def lineage_rows(self) -> list[tuple]:
        s = self.state
        rows = []
        for c in s.dates:
            for part in ("year", "month", "day", "age_days"):
                rows.append((f"{c}_{part}", "date", c, None))
        rows += [(c, "numeric", c, None) for c in s.numeric]
        rows += [(f"{c}={k}", "onehot", c, k) for c in s.low_card for k in s.categories[c]]
        if s.high_card:
            rows += [(f"hash_{i}", "hash", None, None) for i in range(s.n_hash)]
        return [(i, *r) for i, r in enumerate(rows)]

    def lineage(self, spark: SparkSession) -> DataFrame:
        """Idx, name, family, source_col, category (drives vector order and names)."""
        return spark.createDataFrame(
            self.lineage_rows(), "idx int, name string, family string, source_col string, category string")

    # ------------------------------------------------------------ transform
    def _aligned(self, df: DataFrame) -> DataFrame:
        """Missing input columns become NULL so a partial record still transforms."""
        s = self.state
        need = s.numeric + s.low_card + s.high_card
        missing = [c for c in need if c not in df.columns]
        for c in missing:
            df = df.withColumn(c, F.lit(None).cast("double" if c in s.numeric else "string"))
        return df

    def _tokenised(self, df: DataFrame) -> DataFrame:
        s = self.state
        df = self._aligned(nan_to_null(df))
        return df.select("*", fx.hash_pairs(s.high_card, s.n_hash).alias("_pairs")) if s.high_card else df

    def _celled(self, df: DataFrame, keep: list[str]) -> tuple[DataFrame, Column | None, Column | None, int]:
        """Kept columns, ``_cells`` (a struct per date part, number and category) and ``_pairs``, with
        the columns that are there and the place of the first hash bucket."""
        s = self.state
        parts = self.date_columns(df) + self.numeric_columns()
        cells = [F.struct(F.lit(i).alias("idx"), v.cast("double").alias("value")) for i, v in enumerate(parts)]
        at = len(parts)
        for c in s.low_card:
            cells.append(F.struct((F.lit(at) + fx.one_hot_index(c, s.categories[c])).alias("idx"), F.lit(1.0).alias("value")))
            at += len(s.categories[c])
        df = df.select(*keep, *([F.array(*cells).alias("_cells")] if cells else []), *(["_pairs"] if s.high_card else []))
        return df, F.col("_cells") if cells else None, F.col("_pairs") if s.high_card else None, at

    def entries(self, df: DataFrame, keep: tuple = (), out_col: str = "entries") -> DataFrame:
        """The feature vector in sparse form: array<struct<idx:int, value:double>> in ascending order,
        zeros left out. A row costs one struct per input column, whatever the number of categories and
        hash buckets: one-hot and hashed values find their place by adding the offset of their part."""
        df = self._tokenised(df)
        keep = self._kept(df, keep)
        df, cells, pairs, at = self._celled(df, keep)
        if cells is None and pairs is None:
            return df.select(*keep, F.array().cast("array<struct<idx:int,value:double>>").alias(out_col))
        return df.select(*keep, sparse.entries(cells, pairs, at).alias(out_col))

    def _kept(self, df: DataFrame, keep: tuple) -> list[str]:
        s = self.state
        return [c for c in (list(keep) or [*s.id_cols, s.target_col]) if c in df.columns]

    def transform(self, df: DataFrame, keep: tuple = (), vector_col: str = "features",
                  wide: bool = False) -> DataFrame:
        """Narrow projections (no shuffle): tokens and cells in compiled code, the sparse vector from Arrow
        batches of them. With ``wide`` every feature is a column of its own."""
        s = self.state
        if not wide:
            df = self._tokenised(df)
            keep = self._kept(df, keep)
            df, cells, pairs, at = self._celled(df, keep)
            empty = F.array().cast("array<double>")
            vec = array_to_vector(empty) if cells is None and pairs is None else sparse.vector(cells, pairs, at, len(self.lineage_rows()))
            return df.select(*keep, vec.alias(vector_col))
        df = self._tokenised(df)
        cols = self.date_columns(df) + self.numeric_columns() + self.one_hot_columns()
        if s.high_card:
            df = df.select("*", F.map_from_entries(fx.signed_sums(F.col("_pairs"))).alias("_sums"))
            cols += [F.coalesce(F.try_element_at("_sums", F.lit(i)), F.lit(0.0)).alias(f"hash_{i}") for i in range(s.n_hash)]
        return df.select(*self._kept(df, keep), *cols)

    # ------------------------------------------------------------ persistence
    def save(self, spark: SparkSession, path: str) -> None:
        blob = json.dumps(asdict(self.state))
        spark.createDataFrame([(blob,)], "state string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FeatureModel":
        blob = spark.read.text(path).first()[0]
        return cls(FeatureState(**json.loads(blob)))


def build_from_df(df: DataFrame, **kw) -> tuple[FeatureModel, dict]:
    """Fit and return the model plus the detected column lists."""
    m = FeatureSpec(**kw).fit(df)
    s = m.state
    return m, {"num_cols": s.numeric, "low_card_cols": s.low_card, "high_card_cols": s.high_card,
               "date_cols": s.dates}
