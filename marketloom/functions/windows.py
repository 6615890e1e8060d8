"""Ordered windows with the full-window rule.

A time series here holds one row per (key, date), so a window partition is
bounded by the number of calendar days (or months) whatever the size of the
raw data: raw records are reduced to that grain by an aggregate with map-side
combine before any window is applied.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def series(keys: str | Sequence[str] = "ticker", order: str = "date") -> WindowSpec:
    keys = [keys] if isinstance(keys, str) else list(keys)
    return Window.partitionBy(*keys).orderBy(order)


def trailing(n: int, keys: str | Sequence[str] = "ticker", order: str = "date") -> WindowSpec:
    return series(keys, order).rowsBetween(-(n - 1), 0)


def so_far(keys: str | Sequence[str] = "ticker", order: str = "date") -> WindowSpec:
    return series(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def whole_series(keys: str | Sequence[str] = "ticker", order: str = "date") -> WindowSpec:
    return series(keys, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def rolling(
    agg: Callable[[Column], Column],
    value: Column | str,
    n: int,
    keys: str | Sequence[str] = "ticker",
    order: str = "date",
) -> Column:
    """Trailing aggregate that is NULL until n non-NULL values are present."""
    value = F.col(value) if isinstance(value, str) else value
    frame = trailing(n, keys, order)
    return F.when(F.count(value).over(frame) == n, agg(value).over(frame))


def rolling_std(
    value: Column | str, n: int, keys: str | Sequence[str] = "ticker", order: str = "date"
) -> Column:
    """Trailing sample standard deviation with the full-window rule. The central
    moment aggregate keeps its digits where the spread is small beside the level,
    and is exactly zero for constant values."""
    return rolling(F.stddev_samp, value, n, keys, order)


def rolling_avg(
    value: Column | str, n: int, keys: str | Sequence[str] = "ticker", order: str = "date"
) -> Column:
    """Trailing mean with the full-window rule."""
    return rolling(F.avg, value, n, keys, order)
