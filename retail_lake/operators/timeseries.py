"""Period growth and rolling means over aggregated (short) series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retail_lake.functions.exprs import dbl, mean, ratio, rnd


def truncated(day: str, period: str) -> Column:
    """First day of the month or quarter as a date, or the year as a number."""
    return F.year(day) if period == "year" else F.trunc(day, period)


def period_growth(
    series: DataFrame,
    period: str,
    value: str,
    previous: str,
    growth: str,
    change: str | None = None,
    lag: int = 1,
) -> DataFrame:
    """Previous value, growth in percent and, if named, the difference.

    ``series`` is already aggregated: one row per period, so one window task is enough.
    """
    before = F.lag(value, lag).over(Window.orderBy(F.col(period).asc_nulls_last()))
    out = series.withColumn(previous, before)
    if change:
        out = out.withColumn(change, rnd(F.col(value) - F.col(previous)))
    delta = dbl(F.col(value)) - dbl(F.col(previous))
    return out.withColumn(growth, rnd(ratio(delta, F.col(previous)) * 100.0))


def rolling(order: str, rows: int, partition: Sequence[str] = ()) -> "Window":
    """The current row and the ``rows - 1`` before it."""
    base = Window.partitionBy(*partition) if partition else Window.partitionBy()
    return base.orderBy(F.col(order).asc_nulls_last()).rowsBetween(-(rows - 1), 0)


def calendar_frame(order: str, days: int, partition: Sequence[str] = ()) -> "Window":
    """The current day and the ``days - 1`` calendar days before it."""
    base = Window.partitionBy(*partition) if partition else Window.partitionBy()
    return base.orderBy(F.unix_date(order)).rangeBetween(-(days - 1), 0)


def rolling_mean(value: str, frame: "Window", digits: int | None = 2) -> Column:
    return mean(F.sum(value).over(frame), F.count(value).over(frame), digits)
