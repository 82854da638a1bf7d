"""Value bands: one ordered list of conditions with labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Band:
    """``test`` is one of below (<), upto (<=), atleast (>=) and within (both ends in)."""

    test: str
    bounds: tuple
    label: str

    def condition(self, c: Column) -> Column:
        if self.test == "within":
            return c.between(*self.bounds)
        (bound,) = self.bounds
        return {"below": c < bound, "upto": c <= bound, "atleast": c >= bound}[self.test]


def below(bound, label) -> Band:
    return Band("below", (bound,), label)


def upto(bound, label) -> Band:
    return Band("upto", (bound,), label)


def atleast(bound, label) -> Band:
    return Band("atleast", (bound,), label)


def within(low, high, label) -> Band:
    return Band("within", (low, high), label)


@dataclass(frozen=True)
class Bands:
    """The first band that holds gives the label; NULL and gaps fall to ``otherwise``."""

    bands: tuple[Band, ...]
    otherwise: str

    @property
    def labels(self) -> tuple[str, ...]:
        return (*(b.label for b in self.bands), self.otherwise)

    def of(self, value: str | Column) -> Column:
        c = F.col(value) if isinstance(value, str) else value
        out = None
        for band in self.bands:
            hit = band.condition(c)
            out = F.when(hit, band.label) if out is None else out.when(hit, band.label)
        return out.otherwise(self.otherwise)

    def order(self, label: str | Column) -> Column:
        """Position of a label in the list, to sort by."""
        return position(label, self.labels)


def position(label: str | Column, ordered: tuple[str, ...]) -> Column:
    c = F.col(label) if isinstance(label, str) else label
    return F.array_position(F.array(*[F.lit(x) for x in ordered]), c)
