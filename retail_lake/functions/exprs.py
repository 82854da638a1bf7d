"""Column expressions shared by the reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_lake.functions import labels

# Scale at which a double is fixed before it is rounded half up, so that the last
# binary digit of a quotient cannot flip the result.
ROUND_GUARD = "decimal(38,8)"


def rnd(value: Column, digits: int = 2) -> Column:
    """Round half up to ``digits`` and return a double."""
    return F.round(value.cast(ROUND_GUARD), digits).cast("double")


def dbl(value: Column) -> Column:
    return value.cast("double")


def rows() -> Column:
    """Aggregate: number of rows."""
    return F.count(F.lit(1))


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` in double; NULL where the divisor is zero or NULL."""
    return dbl(num) / F.nullif(dbl(den), F.lit(0.0))


def mean(total: Column, n: Column, digits: int | None = 2) -> Column:
    """Mean from an exact sum (whole or up to six decimals) and a count; NULL for an empty group.

    Rounded half up in whole numbers, so that means of any size round right: with the sum in
    millionths N and the count in the same unit per result digit D, it is (2N + D) div 2D.
    """
    if digits is None:
        return ratio(total, n)
    millionths = (F.abs(total).cast("decimal(30,6)") * F.lit(1_000_000)).cast("decimal(37,0)")
    unit = F.nullif(n.cast("decimal(20,0)") * F.lit(10 ** (6 - digits)), F.lit(0))
    twice = (millionths * 2 + unit).cast("decimal(38,0)")
    steps = F.call_function("div", twice, (unit * 2).cast("decimal(38,0)"))
    return F.signum(dbl(total)) * dbl(steps) / F.lit(float(10**digits))


def avg(col: str | Column, digits: int | None = 2) -> Column:
    """Aggregate: exact sum over count of the non-NULL values."""
    c = F.col(col) if isinstance(col, str) else col
    return mean(F.sum(c), F.count(c), digits)


def money(col: str | Column) -> Column:
    """Aggregate: exact sum, as a double."""
    return rnd(F.sum(col))


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, rounded; NULL for an empty whole."""
    return rnd(dbl(part) * 100.0 / F.nullif(dbl(whole), F.lit(0.0)), digits)


def rate(condition: Column, digits: int = 2) -> Column:
    """Aggregate: share of the rows that meet ``condition``, in percent."""
    return pct(F.count_if(condition), rows(), digits)


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def iso_weekday(day: str | Column) -> Column:
    """Monday = 1 … Sunday = 7."""
    return F.weekday(day) + 1


def day_name(day: str | Column) -> Column:
    return F.date_format(day, "EEEE")


def month_name(day: str | Column) -> Column:
    return F.date_format(day, "MMMM")


def days_between(start: str | Column, end: str | Column) -> Column:
    return F.datediff(end, start)


def year_span(born: str | Column, as_of: Column) -> Column:
    """Number of year boundaries between two dates."""
    return F.year(as_of) - F.year(born)


def lookup(col: Column, mapping: Mapping[str, int], default: int | None = None) -> Column:
    """Label to number; ``default`` (or NULL) for any other label."""
    out = None
    for label, number in mapping.items():
        out = F.when(col == label, number) if out is None else out.when(col == label, number)
    return out.otherwise(F.lit(default)) if default is not None else out


def season(day: str | Column) -> Column:
    month = F.month(day)
    out = None
    for name, months in labels.SEASON_MONTHS.items():
        hit = month.isin(list(months))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(labels.SEASON_ELSE)


def apply_filters(df: DataFrame, filters: Mapping[str, object | None]) -> DataFrame:
    """Keep the rows equal to every given value; a value of None does not filter."""
    for name, value in filters.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df
