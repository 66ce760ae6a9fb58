"""Derived measures as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hot_score(inflow: Column, outflow: Column) -> Column:
    """(out+1)/(in+1) * ln(out+1)."""
    sold = outflow.cast("double") + 1
    return sold / (inflow.cast("double") + 1) * F.ln(sold)


def liquidity(inflow: Column, outflow: Column) -> Column:
    """outflow/inflow, NULL where nothing came in."""
    return F.when(inflow > 0, outflow.cast("double") / inflow.cast("double"))


def usable_weight(weight: Column) -> Column:
    """NULL and non-positive weights count as 1."""
    w = weight.cast("double")
    return F.when(w > 0, w).otherwise(F.lit(1.0))


def weight_to_minutes(weight: Column, base_minutes: int) -> Column:
    return F.round(F.lit(float(base_minutes)) / usable_weight(weight)).cast("int")


def minutes_to_weight(minutes: Column, base_minutes: int) -> Column:
    return F.lit(float(base_minutes)) / F.when(minutes > 0, minutes.cast("double")).otherwise(float(base_minutes))


def interval_us(weight: Column, base_s: int, low_s: int, high_s: int) -> Column:
    """Observation interval in whole microseconds: base/weight inside [low, high] (given in seconds)."""
    raw = F.lit(base_s * 1e6) / usable_weight(weight)
    return F.greatest(F.least(raw, F.lit(high_s * 1e6)), F.lit(low_s * 1e6)).cast("long")
