"""Staged transactions -> transaction mart."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.classify import (
    amount_category,
    quality_flag,
    quarter_label,
    recency_category,
    row_id,
)
from ledgerloom.operators.prefix import HOT_ROWS, SLICE_ROWS, running_total
from ledgerloom.plans.staging import ACCOUNT_ORDER
from ledgerloom.schema import MONEY, NET, TOTAL

ROUNDED = {
    "debit_amount": MONEY,
    "credit_amount": MONEY,
    "net_amount": NET,
    "balance_amount": MONEY,
    "vat_amount": MONEY,
}


def rounded(transactions: DataFrame) -> DataFrame:
    """The columns that the mart takes from a transaction."""
    return transactions.select(
        "account_code",
        "account_name",
        "transaction_date",
        "booking_number",
        "description",
        *[F.round(name, 2).cast(kind).alias(name) for name, kind in ROUNDED.items()],
        "transaction_type",
        "transaction_year",
        "transaction_quarter",
        "transaction_month",
        "transaction_code",
        "Code1",
        "Code2",
        "vat_code",
        "booking_status",
        "number",
        "invoice_number",
        "source_file",
        "loaded_timestamp",
    )


def enrich(transactions: DataFrame, as_of: dt.date) -> DataFrame:
    """Row id, calendar labels, classes and quality flag of each transaction."""
    return _classified(rounded(transactions), as_of)


def _classified(rows: DataFrame, as_of: dt.date, *besides: str) -> DataFrame:
    day = F.col("transaction_date")
    return rows.select(
        row_id(
            "account_code", "transaction_date", "booking_number", "description", "net_amount"
        ).alias("transaction_id"),
        *[name for name in rows.columns if name not in besides],
        F.date_format(day, "EEEE").alias("day_of_week"),
        F.dayofmonth(day).cast("bigint").alias("day_of_month"),
        quarter_label(day).alias("quarter_label"),
        amount_category("net_amount").alias("amount_category"),
        recency_category(day, as_of).alias("recency_category"),
        quality_flag("debit_amount", "credit_amount", "description").alias("data_quality_flag"),
        *besides,
    )


def with_running_balance(
    transactions: DataFrame, hot_rows: int = HOT_ROWS, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Balance of the account after each line, in booking order."""
    order = [F.col(name).asc_nulls_last() for name in ACCOUNT_ORDER]
    return running_total(
        transactions,
        ["account_code"],
        order,
        "net_amount",
        "running_balance",
        TOTAL,
        hot_rows,
        slice_rows,
    )


def transaction_details(
    transactions: DataFrame,
    as_of: dt.date,
    updated_at: dt.datetime | None = None,
    hot_rows: int = HOT_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """The transaction mart; unsorted, since an order belongs to the reader.

    Ids, labels and classes are added after the running balance, so that they are not shuffled.
    """
    balanced = with_running_balance(rounded(transactions), hot_rows, slice_rows)
    details = _classified(balanced, as_of, "running_balance")
    if updated_at is not None:
        details = details.withColumn(
            "last_updated", F.lit(str(updated_at)).cast("timestamp_ntz")
        )
    return details

