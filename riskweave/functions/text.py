"""Text measures (D15): character length and whitespace word count, built-ins only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_length(text: Column) -> Column:
    return F.length(text.cast("string")).cast("long")


def word_count(text: Column) -> Column:
    """Words split on runs of whitespace, empty pieces dropped (like ``str.split()``)."""
    parts = F.split(text.cast("string"), r"\s+")
    return F.size(F.filter(parts, lambda x: x != F.lit(""))).cast("long")
