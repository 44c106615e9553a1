"""Filter selections as one predicate, applied before any sort or aggregate."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _whole_numbers(name: str, values: Iterable, low: int, high: int) -> frozenset[int]:
    """All values as integers in range, or an error: never a partial list."""
    numbers = set()
    for value in values or ():
        try:
            number = int(value)
        except (TypeError, ValueError):
            raise ValueError(f"Invalid {name} value: {value}") from None
        if not low <= number <= high:
            raise ValueError(f"{name.title()} {number} is out of valid range ({low}-{high})")
        numbers.add(number)
    return frozenset(numbers)


@dataclass(frozen=True)
class FilterSpec:
    """Which transactions to keep. An empty part does not restrict."""

    years: frozenset[int] = frozenset()
    quarters: frozenset[int] = frozenset()
    months: frozenset[int] = frozenset()
    account_codes: frozenset[str] = frozenset()
    amount_categories: frozenset[str] = frozenset()
    date_range: tuple[dt.date, dt.date] | None = None
    search_term: str = ""

    def __post_init__(self):
        set_field = object.__setattr__
        set_field(self, "years", _whole_numbers("year", self.years, 1900, 2100))
        set_field(self, "quarters", _whole_numbers("quarter", self.quarters, 1, 4))
        set_field(self, "months", _whole_numbers("month", self.months, 1, 12))
        set_field(self, "account_codes", frozenset(self.account_codes or ()))
        set_field(self, "amount_categories", frozenset(self.amount_categories or ()))

    def is_empty(self) -> bool:
        return self._bounded() is None and not self.account_codes

    def _bounded(self) -> Column | None:
        """The conjunction of all parts but the accounts; None if none restricts."""
        parts = []
        for name, values in (
            ("transaction_year", self.years),
            ("transaction_quarter", self.quarters),
            ("transaction_month", self.months),
            ("amount_category", self.amount_categories),
        ):
            if values:
                parts.append(F.col(name).isin(sorted(values)))
        if self.date_range:
            start, end = self.date_range
            parts.append(F.col("transaction_date").between(F.lit(start), F.lit(end)))
        if self.search_term.strip():
            term = F.lower(F.lit(self.search_term.strip()))
            parts.append(F.lower(F.col("description")).contains(term))
        return reduce(lambda a, b: a & b, parts) if parts else None

    def apply(self, frame: DataFrame) -> DataFrame:
        """Accounts, of which there may be many, are joined; the rest is one predicate."""
        condition = self._bounded()
        rows = frame if condition is None else frame.where(condition)
        return is_among(rows, "account_code", self.account_codes) if self.account_codes else rows


@dataclass(frozen=True)
class SourceSelection:
    """Which source files to show. ``enabled`` is off while all are shown."""

    selected: frozenset[str] = field(default_factory=frozenset)
    enabled: bool = False

    @classmethod
    def of(cls, selected: Iterable[str], available: Iterable[str]) -> SourceSelection:
        chosen = frozenset(selected)
        return cls(chosen, enabled=len(chosen) < len(frozenset(available)))

    def restricts(self) -> bool:
        """As a query condition, selecting nothing means no condition."""
        return self.enabled and bool(self.selected)

    def apply(self, frame: DataFrame) -> DataFrame:
        return is_among(frame, "source_file", self.selected) if self.restricts() else frame

    def keep_rows(self, frame: DataFrame) -> DataFrame:
        """As a row filter, selecting nothing keeps nothing.

        Frames that do not say where their rows come from pass unchanged.
        """
        if not self.enabled or "source_file" not in frame.columns:
            return frame
        return is_among(frame, "source_file", self.selected)


def is_among(frame: DataFrame, name: str, values: Iterable) -> DataFrame:
    """Rows whose column is one of the values: a join, however many there are."""
    values = sorted(set(values))
    wanted = frame.sparkSession.createDataFrame(
        [(value,) for value in values], f"`{name}` {frame.schema[name].dataType.simpleString()}"
    )
    return semi_join(frame, wanted, name)


def semi_join(frame: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """Rows whose column occurs in ``wanted``; the planner picks the join."""
    return frame.join(wanted.select(name), name, "left_semi")


def anti_join(frame: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Rows whose column does not occur in ``known``."""
    return frame.join(known.select(name), name, "left_anti")
