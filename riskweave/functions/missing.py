"""Missing values: NaN counts as missing wherever NULL does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOATING = ("double", "float")


def number(c: Column) -> Column:
    """A column as double with NaN as NULL."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def present(c: str, dtype: str) -> Column:
    """Whether a column's value is there (neither NULL nor NaN)."""
    there = F.col(c).isNotNull()
    return there & ~F.isnan(F.col(c)) if dtype in FLOATING else there


def nan_to_null(df: DataFrame) -> DataFrame:
    """All columns, floating ones with NaN as NULL (a narrow projection)."""
    if not any(t in FLOATING for _, t in df.dtypes):
        return df
    return df.select(*[F.nanvl(F.col(c), F.lit(None).cast(t)).alias(c) if t in FLOATING else F.col(c)
                       for c, t in df.dtypes])
