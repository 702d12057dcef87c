"""Column helpers that many operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def by(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys)


def ratio(top: Column, bottom: Column, otherwise: float | None = 0.0) -> Column:
    """top / bottom, or a fixed value where bottom is zero."""
    value = F.try_divide(top.cast("double"), bottom.cast("double"))
    return value if otherwise is None else F.coalesce(value, F.lit(otherwise))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def minmax(x: str, keys: list[str], flat: float) -> Column:
    """x scaled to 0..1 within its group; flat where all values are equal."""
    w = by(*keys)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(high > low, (F.col(x) - low) / (high - low)).otherwise(F.lit(flat))


def zscore(x: str, keys: list[str]) -> Column:
    """Population z-score within a group; 0 where all values are equal."""
    w = by(*keys)
    sd = F.stddev_pop(x).over(w)
    return F.when(sd > 0, (F.col(x) - F.avg(x).over(w)) / sd).otherwise(F.lit(0.0))


def mid_rank(x: str, keys: list[str]) -> Column:
    """Rank from 1 in ascending order, ties sharing the middle of their ranks."""
    w = by(*keys).orderBy(x)
    return F.rank().over(w) + (F.count("*").over(by(*keys, x)) - 1) / 2


def r6(x: Column) -> Column:
    return F.round(x.cast("double"), 6)


def half_up(x: Column, places: int) -> Column:
    """A double rounded by its own value times a power of ten, halves away from zero, as DuckDB does; round() goes by the digits that it is shown with."""
    scaled = F.abs(x) * 10.0**places
    whole = F.floor(scaled)
    return F.signum(x) * (whole + (scaled - whole >= 0.5).cast("int")) / 10.0**places
