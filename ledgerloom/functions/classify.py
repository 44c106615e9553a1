"""Classifications of transactions and accounts as column expressions.

``as_of`` is the reporting date, a ``datetime.date``, wherever a class depends
on how long ago something happened.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.money import column


def _ladder(value: Column, steps: list[tuple[float, str]], lowest: str) -> Column:
    """The label of the first step the value exceeds."""
    result = None
    for bound, label in steps:
        condition = value > bound
        result = F.when(condition, label) if result is None else result.when(condition, label)
    return result.otherwise(lowest)


def _since(day: Column, as_of: dt.date, steps: list[tuple[int, str]], oldest: str) -> Column:
    """The label of the first step, in days before ``as_of``, that reaches the day."""
    result = None
    for days, label in steps:
        condition = day >= F.lit(as_of - dt.timedelta(days=days))
        result = F.when(condition, label) if result is None else result.when(condition, label)
    return result.otherwise(oldest)


def transaction_type(debit: Column | str, credit: Column | str) -> Column:
    """A NULL comparison falls through, so a lone negative debit is ``Zero``."""
    return (
        F.when(column(debit) > 0, "Debit").when(column(credit) > 0, "Credit").otherwise("Zero")
    )


def amount_category(net: Column | str) -> Column:
    return _ladder(
        F.abs(column(net)), [(5000, "Large"), (1000, "Medium"), (100, "Small")], "Minimal"
    )


def recency_category(day: Column | str, as_of: dt.date) -> Column:
    return _since(
        column(day),
        as_of,
        [(30, "Last 30 days"), (90, "Last 90 days"), (365, "Last year")],
        "Older than 1 year",
    )


def activity_status(last_day: Column | str, as_of: dt.date) -> Column:
    return _since(
        column(last_day), as_of, [(30, "Active"), (90, "Recently Active")], "Inactive"
    )


def balance_type(debit: Column | str, credit: Column | str) -> Column:
    """Three-way, on account totals."""
    return (
        F.when(column(debit) > column(credit), "Net Debit")
        .when(column(credit) > column(debit), "Net Credit")
        .otherwise("Balanced")
    )


def net_side(net: Column | str) -> Column:
    """Two-way, used by the filtered rollups: a zero balance is ``Net Credit``."""
    return F.when(column(net) > 0, "Net Debit").otherwise("Net Credit")


def volume_category(transactions: Column | str) -> Column:
    return _ladder(
        column(transactions), [(100, "High Volume"), (20, "Medium Volume")], "Low Volume"
    )


def value_category(net: Column | str) -> Column:
    return _ladder(
        F.abs(column(net)), [(10000, "High Value"), (1000, "Medium Value")], "Low Value"
    )


def quarter_label(day: Column | str) -> Column:
    return F.concat(F.lit("Q"), F.quarter(column(day)).cast("string"))


def quality_flag(debit: Column | str, credit: Column | str, description: Column | str) -> Column:
    debit, credit, description = column(debit), column(credit), column(description)
    return (
        F.when((debit == 0) & (credit == 0), "Zero Amount")
        .when((debit > 0) & (credit > 0), "Both Debit and Credit")
        .when(description.isNull() | (F.trim(description) == ""), "Missing Description")
        .otherwise("Complete")
    )


def row_id(*values: Column | str) -> Column:
    """Identical rows share an id; NULL counts as an empty string."""
    parts = [F.coalesce(column(value).cast("string"), F.lit("")) for value in values]
    return F.md5(F.concat_ws("|", *parts))
