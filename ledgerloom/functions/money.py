"""Column helpers for amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.schema import MONEY, TOTAL


def column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def amount_or_zero(value: Column | str) -> Column:
    """NULL counts as nothing booked."""
    return F.coalesce(column(value).cast(MONEY), F.lit(0).cast(MONEY))


def total(value: Column | str) -> Column:
    return F.sum(column(value)).cast(TOTAL)


def total_or_zero(value: Column | str) -> Column:
    return F.coalesce(total(value), F.lit(0).cast(TOTAL))


def as_double(value: Column | str) -> Column:
    """Money as shown to callers: two decimals, double."""
    return F.round(column(value), 2).cast("double")
