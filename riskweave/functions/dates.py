"""Date expressions (D1-D4): coerce-parse, calendar parts and whole-day ages.

All of them stay inside whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType

MICROS_PER_DAY = 86_400_000_000
# Fixed value: age given to a missing date, or to every row when the column was all missing.
MISSING_AGE_DAYS = 999999


def parse_datetime(c: Column | str, dtype=None) -> Column:
    """Coerce to TIMESTAMP_NTZ; unparseable strings become NULL instead of failing (ANSI safe)."""
    col = F.col(c) if isinstance(c, str) else c
    if dtype is not None and isinstance(dtype, (TimestampNTZType,)):
        return col
    if dtype is not None and isinstance(dtype, (DateType, TimestampType)):
        return col.cast("timestamp_ntz")
    return col.cast(StringType()).try_cast("timestamp_ntz")


def date_parts(ts: Column, prefix: str) -> list[Column]:
    """``<prefix>_year/_month/_day`` with missing mapped to 0 (integers)."""
    return [
        F.coalesce(F.year(ts), F.lit(0)).alias(f"{prefix}_year"),
        F.coalesce(F.month(ts), F.lit(0)).alias(f"{prefix}_month"),
        F.coalesce(F.dayofmonth(ts), F.lit(0)).alias(f"{prefix}_day"),
    ]


def whole_days_between(start: Column, end: Column) -> Column:
    """floor((end - start) in days), exact with times of day and time-zone free (NTZ micros)."""
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return F.floor(micros / F.lit(MICROS_PER_DAY)).cast("long")


def age_days(ts: Column, fitted_max) -> Column:
    """Days from the date to the fitted maximum; missing date or missing maximum gives 999999."""
    if fitted_max is None:
        return F.lit(MISSING_AGE_DAYS).cast("long")
    mx = F.lit(fitted_max).cast("timestamp_ntz")
    return F.coalesce(whole_days_between(ts, mx), F.lit(MISSING_AGE_DAYS).cast("long"))
