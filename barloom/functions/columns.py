"""Column helpers that every layer shares."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEY = ["market", "symbol", "trade_date"]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tie_safe(c: str | Column, places: int, half: float = 0.5) -> Column:
    """Half-up rounding in binary, the same on every engine: floor(x * 10^p + 1/2) / 10^p."""
    return F.floor(col(c) * F.lit(10.0**places) + F.lit(half)) / F.lit(10.0**places)


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is null or 0."""
    return F.try_divide(col(a), col(b))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def or_zero(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(0.0))


def series() -> WindowSpec:
    return Window.partitionBy("market", "symbol").orderBy("trade_date")


def frame(n: int) -> WindowSpec:
    """The last n bars of a series, this one included."""
    return series().rowsBetween(1 - n, 0)


def full(n: int, value: Column, count: str = "rn") -> Column:
    """value once n bars (or n counted values) are there; row numbers count bars, since a series has no holes."""
    return F.when(F.col(count) >= n, value)


def display(market: str | Column = "market", symbol: str | Column = "symbol") -> Column:
    """600519.SH"""
    return F.concat(col(symbol), F.lit("."), F.upper(col(market)))
