"""Staged transactions -> account balances -> account mart."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.classify import (
    activity_status,
    balance_type,
    value_category,
    volume_category,
)
from ledgerloom.functions.money import total
from ledgerloom.schema import TOTAL

ROUNDED = ("total_debit", "total_credit", "net_balance", "total_vat")


def account_balances(transactions: DataFrame, as_of: dt.date) -> DataFrame:
    """Counts, sums, dates and classes per account code and name, with the code's trends.

    One scan and one wide shuffle: a day of an account becomes one row before it, and
    counting the days is then a plain count. A hot account arrives at the next step as at
    most one row per day and upstream task. The trends are of a code, whatever its names, and
    are summed over the few rows that its names leave.
    """
    daily = transactions.groupBy("account_code", "account_name", "transaction_date").agg(
        F.count(F.lit(1)).alias("n"),
        total("debit_amount").alias("debit"),
        total("credit_amount").alias("credit"),
        total("net_amount").alias("net"),
        total("vat_amount").alias("vat"),
    )
    day = F.col("transaction_date")
    last_year = day >= F.lit(as_of - dt.timedelta(days=365))
    last_quarters = day >= F.lit(as_of - dt.timedelta(days=270))
    none = F.lit(0).cast("decimal(26,2)")
    named = daily.groupBy("account_code", "account_name").agg(
        F.sum("n").alias("total_transactions"),
        F.count("transaction_date").alias("unique_transaction_dates"),
        total("debit").alias("total_debit"),
        total("credit").alias("total_credit"),
        total("net").alias("net_balance"),
        total("vat").alias("total_vat"),
        F.min("transaction_date").alias("first_transaction_date"),
        F.max("transaction_date").alias("last_transaction_date"),
        total(F.when(last_year, F.col("net")).otherwise(none)).alias("_net_12m"),
        F.sum(F.when(last_year, F.col("n")).otherwise(F.lit(0))).alias("_n_12m"),
        total(F.when(last_quarters, F.col("net")).otherwise(none)).alias("_net_4q"),
        F.collect_set(F.year("transaction_date")).alias("_years"),
    )
    same_code = Window.partitionBy("account_code")
    days = F.greatest(
        F.lit(1), F.datediff("last_transaction_date", "first_transaction_date") + 1
    )
    years = F.size(F.array_distinct(F.flatten(F.collect_list("_years").over(same_code))))
    return named.withColumns(
        {
            "account_balance_type": balance_type("total_debit", "total_credit"),
            "activity_status": activity_status("last_transaction_date", as_of),
            "years_active": years.cast("bigint"),
            "net_amount_12m": F.sum("_net_12m").over(same_code),
            "transactions_12m": F.sum("_n_12m").over(same_code),
            "net_amount_4q": F.sum("_net_4q").over(same_code),
            "avg_daily_transaction_frequency": F.col("total_transactions").cast("double") / days,
        }
    ).drop("_net_12m", "_n_12m", "_net_4q", "_years")


def account_summary(
    balances: DataFrame, updated_at: dt.datetime | None = None
) -> DataFrame:
    """The account mart; unsorted, since an order belongs to the reader."""
    columns = [
        "account_code",
        "account_name",
        "total_transactions",
        "unique_transaction_dates",
        "avg_daily_transaction_frequency",
        *[F.round(name, 2).cast(TOTAL).alias(name) for name in ROUNDED],
        F.round("net_amount_12m", 2).cast(TOTAL).alias("net_amount_last_12_months"),
        F.col("transactions_12m").alias("transactions_last_12_months"),
        F.round("net_amount_4q", 2).cast(TOTAL).alias("net_amount_last_4_quarters"),
        "first_transaction_date",
        "last_transaction_date",
        "years_active",
        "account_balance_type",
        "activity_status",
        volume_category("total_transactions").alias("transaction_volume_category"),
        value_category("net_balance").alias("balance_value_category"),
    ]
    updated = None if updated_at is None else str(updated_at)
    columns.append(F.lit(updated).cast("timestamp_ntz").alias("last_updated"))
    return balances.where(F.col("total_transactions") > 0).select(*columns)
