"""Scalar functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(value: Column) -> Column:
    """NaN and infinities as null."""
    v = value.cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def safe_divide(a: Column, b: Column) -> Column:
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def clip(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def pct_change(new: Column, old: Column) -> Column:
    return safe_divide(new, old) - 1


def sign_status(value: Column, band: float) -> Column:
    return F.when(value.isNull(), "unknown").when(value > band, "positive").when(value < -band, "negative").otherwise("flat")


def correlation_band(value: Column) -> Column:
    return F.when(value.isNull(), "unknown").when(F.abs(value) < 0.3, "low").when(F.abs(value) < 0.6, "medium").otherwise("high")


def canonical_hash(*columns: Column) -> Column:
    """sha256 of the columns as canonical JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
