from __future__ import annotations

import datetime as dt
from collections import Counter
from decimal import Decimal

from pyspark.sql import DataFrame


def day(text: str | None) -> dt.date | None:
    return dt.date.fromisoformat(text) if text else None


def dec(text: str | None) -> Decimal | None:
    return Decimal(text) if text is not None else None


def bag(df: DataFrame) -> Counter:
    """Rows as a multiset, columns in name order."""
    columns = sorted(df.columns)
    return Counter(tuple(row[c] for c in columns) for row in df.collect())


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]
