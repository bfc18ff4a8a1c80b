"""Scalar scoring expressions: risk band, recommendation text, percent text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band cut points and the text shown for each band.
HIGH_CUT = 0.75
MEDIUM_CUT = 0.4
BAND_TEXT = {
    "High": "Immediate action recommended. Run full scan.",
    "Medium": "Monitor system closely. Update definitions.",
    "Low": "System appears healthy.",
}


def risk_band(p: Column) -> Column:
    return (F.when(p >= F.lit(HIGH_CUT), F.lit("High"))
            .when(p >= F.lit(MEDIUM_CUT), F.lit("Medium"))
            .otherwise(F.lit("Low")))


def recommendation(band: Column) -> Column:
    return (F.when(band == "High", F.lit(BAND_TEXT["High"]))
            .when(band == "Medium", F.lit(BAND_TEXT["Medium"]))
            .otherwise(F.lit(BAND_TEXT["Low"])))


def percent_text(p: Column) -> Column:
    """Probability as a percentage with one decimal, e.g. ``73.4%``."""
    return F.concat(F.format_number(p * F.lit(100.0), 1), F.lit("%"))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
