"""The dashboard's queries over the two marts."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.classify import net_side
from ledgerloom.functions.money import total, total_or_zero
from ledgerloom.operators.filters import FilterSpec, SourceSelection
from ledgerloom.operators.paging import Level, page
from ledgerloom.operators.rows import beside
from ledgerloom.plans.accounts import account_balances, account_summary

# The columns of the results, in their order.
ACCOUNT_COLUMNS = (
    "account_code",
    "account_name",
    "total_transactions",
    "total_debit",
    "total_credit",
    "net_balance",
    "total_vat",
    "net_amount_last_12_months",
    "transactions_last_12_months",
    "first_transaction_date",
    "last_transaction_date",
    "years_active",
    "account_balance_type",
    "activity_status",
    "transaction_volume_category",
    "balance_value_category",
    "last_updated",
)
TRANSACTION_COLUMNS = (
    "transaction_id",
    "account_code",
    "account_name",
    "transaction_date",
    "booking_number",
    "description",
    "debit_amount",
    "credit_amount",
    "net_amount",
    "balance_amount",
    "vat_amount",
    "transaction_type",
    "transaction_year",
    "transaction_quarter",
    "transaction_month",
    "amount_category",
    "recency_category",
    "running_balance",
    "data_quality_flag",
    "source_file",
)
FILTERED_COLUMNS = (
    "transaction_id",
    "account_code",
    "account_name",
    "transaction_date",
    "booking_number",
    "description",
    "debit_amount",
    "credit_amount",
    "net_amount",
    "transaction_type",
    "amount_category",
    "recency_category",
    "source_file",
)

STATS_COLUMNS = (
    "total_accounts",
    "active_accounts",
    "total_assets",
    "total_liabilities",
    "total_transactions",
    "unique_accounts",
    "total_debit",
    "total_credit",
    "net_total",
)

# Separates the lines of one booking, so that a page has one content.
LINE = ("number", "Code1", "Code2", "debit_amount", "credit_amount")

AMOUNT_BINS = (("0-100", 0, 100), ("100-500", 100, 500), ("500-1000", 500, 1000), ("1000+", 1000, None))


class Page(NamedTuple):
    rows: DataFrame
    total: int


def _largest_balance_first():
    return [
        F.abs("net_balance").desc(),
        F.col("account_code").asc_nulls_last(),
        F.col("account_name").asc_nulls_last(),
    ]


def _newest_first():
    return [
        F.col("transaction_date").desc_nulls_last(),
        F.col("booking_number").desc_nulls_last(),
        *[F.col(name).asc_nulls_last() for name in LINE],
    ]


def _booking_levels() -> list[Level]:
    number = F.col("booking_number")
    return [Level(F.shiftright(number, 12), descending=True), Level(number, descending=True)]


def newest_levels() -> list[Level]:
    """What the order of the newest first is counted by: days, and in a crowded one bookings."""
    return [Level(F.col("transaction_date"), descending=True), *_booking_levels()]


def account_levels() -> list[Level]:
    code = F.col("account_code")
    return [Level(F.substring(code, 1, 2)), Level(code), Level(F.col("transaction_date")), *_booking_levels()]


def _by_code():
    return [F.col("account_code").asc_nulls_last(), F.col("account_name").asc_nulls_last()]


class Dashboard:
    """Queries over an account mart and a transaction mart.

    A restricting source selection is applied to the transactions, and the
    account figures are then derived from what is left of them.
    """

    def __init__(
        self,
        transactions: DataFrame,
        accounts: DataFrame,
        as_of: dt.date,
        sources: SourceSelection = SourceSelection(),
    ):
        self.as_of = as_of
        self.transactions = sources.apply(transactions)
        if sources.restricts():
            self.accounts = account_summary(account_balances(self.transactions, as_of))
        else:
            self.accounts = accounts

    # --- accounts ---

    def account_summary(self, limit: int | None = None, offset: int = 0) -> DataFrame:
        rows = self.accounts.select(*ACCOUNT_COLUMNS)
        return page(rows, _largest_balance_first(), limit, offset)

    def account_summary_count(self) -> DataFrame:
        return self.accounts.agg(F.count(F.lit(1)).alias("count"))

    def top_accounts_by_balance(self, limit: int = 10) -> DataFrame:
        rows = self.accounts.select(
            "account_code", "account_name", "net_balance", "account_balance_type", "activity_status"
        )
        return page(rows, _largest_balance_first(), limit)

    def account_activity_breakdown(self) -> DataFrame:
        return (
            self.accounts.groupBy("activity_status")
            .agg(
                F.count(F.lit(1)).alias("account_count"),
                total("net_balance").alias("total_balance"),
                F.count("net_balance").alias("_balances"),
            )
            .withColumn("avg_balance", F.col("total_balance").cast("double") / F.col("_balances"))
            .drop("_balances")
            .orderBy(F.col("account_count").desc(), "activity_status")
        )

    def balance_type_distribution(self) -> DataFrame:
        kind = F.coalesce(F.col("account_balance_type"), F.lit("Other"))
        return self.accounts.groupBy(kind.alias("account_type")).agg(
            F.count(F.lit(1)).alias("account_count")
        )

    def balance_chart(self, bars: int = 10) -> DataFrame:
        rows = self.accounts.select("account_code", "account_name", "net_balance")
        return page(rows, _by_code(), bars).select("account_code", "net_balance")

    # --- transactions ---

    def transaction_details(self, limit: int | None = None, offset: int = 0) -> DataFrame:
        rows = self.transactions.select(*TRANSACTION_COLUMNS, *self._order_only(TRANSACTION_COLUMNS))
        return self._newest(rows, limit, offset).select(*TRANSACTION_COLUMNS)

    def transaction_details_count(self) -> DataFrame:
        return self.transactions.agg(F.count(F.lit(1)).alias("count"))

    def filtered_transactions(
        self, spec: FilterSpec, limit: int | None = None, offset: int = 0
    ) -> DataFrame:
        rows = spec.apply(self.transactions).select(
            *FILTERED_COLUMNS, *self._order_only(FILTERED_COLUMNS)
        )
        return self._newest(rows, limit, offset).select(*FILTERED_COLUMNS)

    def transaction_stats(self) -> DataFrame:
        """One row. Grouping by both counted columns first leaves little to count
        the distinct values of, and no copy of the input per distinct count."""
        grouped = self.transactions.groupBy("account_code", "source_file").agg(
            F.count(F.lit(1)).alias("n"),
            total("debit_amount").alias("debit"),
            total("credit_amount").alias("credit"),
            total("net_amount").alias("net"),
            F.min("transaction_date").alias("first"),
            F.max("transaction_date").alias("last"),
        )
        return grouped.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_transactions"),
            F.countDistinct("account_code").alias("unique_accounts"),
            total("debit").alias("total_debit"),
            total("credit").alias("total_credit"),
            total("net").alias("net_total"),
            F.min("first").alias("earliest_date"),
            F.max("last").alias("latest_date"),
            F.countDistinct("source_file").alias("source_files"),
        )

    def monthly_trends(self, months: int = 12) -> DataFrame:
        since = self.as_of - dt.timedelta(days=30 * months)
        return (
            self.transactions.where(
                (F.col("transaction_date") >= F.lit(since))
                # Implied by the date; prunes the mart's year partitions.
                & (F.col("transaction_year") >= since.year)
            )
            .groupBy("transaction_year", "transaction_month")
            .agg(
                F.count(F.lit(1)).alias("transaction_count"),
                total("debit_amount").alias("total_debit"),
                total("credit_amount").alias("total_credit"),
                total("net_amount").alias("net_amount"),
            )
            .withColumn(
                "period", F.format_string("%d-%02d", "transaction_year", "transaction_month")
            )
            .orderBy(F.col("transaction_year").desc(), F.col("transaction_month").desc())
            .limit(months)
        )

    def daily_volume(self, days: int = 10) -> DataFrame:
        return (
            self.transactions.groupBy("transaction_date")
            .agg(total(F.abs("net_amount")).alias("volume"))
            .orderBy(F.col("transaction_date").asc_nulls_last())
            .limit(days)
        )

    def amount_histogram(self) -> DataFrame:
        """Four bins of the absolute amount; empty ones show 0."""
        size = F.abs("net_amount")
        counts = self.transactions.agg(
            *[
                F.count_if((size >= low) if high is None else (size >= low) & (size < high)).alias(
                    label
                )
                for label, low, high in AMOUNT_BINS
            ]
        )
        bins = F.array(
            *[
                F.struct(F.lit(label).alias("amount_range"), F.col(f"`{label}`").alias("n"))
                for label, _, _ in AMOUNT_BINS
            ]
        )
        return counts.select(F.inline(bins))

    # --- both ---

    def dashboard_stats(self) -> DataFrame:
        balance = F.col("net_balance")
        accounts = self.accounts.agg(
            F.count(F.lit(1)).alias("total_accounts"),
            F.count_if(F.col("activity_status") == "Active").alias("active_accounts"),
            total_or_zero(F.when(balance > 0, balance)).alias("total_assets"),
            total_or_zero(F.when(balance < 0, -balance)).alias("total_liabilities"),
        )
        return beside(accounts, self.transaction_stats())

    def mart_counts(self) -> DataFrame:
        name = F.lit("mart_account_summary").alias("mart")
        other = F.lit("mart_transaction_details").alias("mart")
        return (
            self.account_summary_count()
            .select(name, "count")
            .unionByName(self.transaction_details_count().select(other, "count"))
        )

    def last_refresh_time(self) -> DataFrame:
        """NULL if the mart does not say."""
        return self.accounts.agg(F.max("last_updated").alias("last_updated"))

    def filtered_account_rollup(self, spec: FilterSpec) -> DataFrame:
        """Account totals of the filtered transactions, all of them."""
        return (
            spec.apply(self.transactions)
            .groupBy("account_code", "account_name")
            .agg(
                F.count(F.lit(1)).alias("total_transactions"),
                total_or_zero("debit_amount").alias("total_debit"),
                total_or_zero("credit_amount").alias("total_credit"),
                total_or_zero("net_amount").alias("net_balance"),
            )
            .withColumns(
                {
                    "account_balance_type": net_side("net_balance"),
                    "activity_status": F.lit("Active"),
                }
            )
        )

    def filtered_stats(self, spec: FilterSpec) -> DataFrame:
        """The dashboard's figures for the filtered transactions."""
        if spec.is_empty():
            return self.dashboard_stats().select(*STATS_COLUMNS)
        by_account = (
            spec.apply(self.transactions)
            .groupBy("account_code")
            .agg(
                F.count(F.lit(1)).alias("n"),
                total("debit_amount").alias("debit"),
                total("credit_amount").alias("credit"),
                total("net_amount").alias("balance"),
            )
        )
        balance = F.col("balance")
        return by_account.agg(
            F.count(F.lit(1)).alias("total_accounts"),
            F.count(F.lit(1)).alias("active_accounts"),
            total_or_zero(F.when(balance > 0, balance)).alias("total_assets"),
            total_or_zero(F.when(balance < 0, -balance)).alias("total_liabilities"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_transactions"),
            F.count(F.lit(1)).alias("unique_accounts"),
            total_or_zero("debit").alias("total_debit"),
            total_or_zero("credit").alias("total_credit"),
            total_or_zero("balance").alias("net_total"),
        )

    def sorted_accounts(self, spec: FilterSpec = FilterSpec()) -> DataFrame:
        """All accounts by code; totals of the filtered transactions if filtered."""
        if not spec.is_empty():
            return self.filtered_account_rollup(spec).orderBy(*_by_code())
        return self.accounts.select(*ACCOUNT_COLUMNS).orderBy(*_by_code())

    def limited_transactions(
        self, limit: int = 20, spec: FilterSpec = FilterSpec()
    ) -> DataFrame:
        """The newest ones, shown by account and date."""
        if not spec.is_empty():
            newest = self.filtered_transactions(spec, limit)
        else:
            newest = self.transaction_details(limit)
        return newest.orderBy(
            F.col("account_code").asc_nulls_last(), F.col("transaction_date").asc_nulls_last()
        )

    # --- pages with totals ---

    def paginated_accounts(self, offset: int, limit: int) -> Page:
        """The page is cut by balance, then shown by code."""
        rows = self.account_summary(limit, offset).orderBy(*_by_code())
        return Page(rows, self.accounts.count())

    def paginated_transactions(self, offset: int, limit: int) -> Page:
        return Page(self.transaction_details(limit, offset), self.transactions.count())

    def filtered_paginated_accounts(self, spec: FilterSpec, offset: int, limit: int) -> Page:
        if spec.is_empty():
            return self.paginated_accounts(offset, limit)
        accounts = self.filtered_account_rollup(spec)
        names = spec.apply(self.transactions).select("account_code", "account_name")
        return Page(page(accounts, _by_code(), limit, offset), names.distinct().count())

    def filtered_paginated_transactions(self, spec: FilterSpec, offset: int, limit: int) -> Page:
        if spec.is_empty():
            return self.paginated_transactions(offset, limit)
        return Page(
            self.filtered_transactions(spec, limit, offset),
            spec.apply(self.transactions).count(),
        )

    def accounts_slice(self, offset: int, limit: int) -> Page:
        """A slice of the accounts by code."""
        rows = self.accounts.select(*ACCOUNT_COLUMNS)
        return Page(page(rows, _by_code(), limit, offset), self.accounts.count())

    def transactions_slice(self, offset: int, limit: int) -> Page:
        """A slice of all transactions, by account and date."""
        rows = self.transactions.select(
            *TRANSACTION_COLUMNS, *self._order_only(TRANSACTION_COLUMNS)
        )
        order = [
            F.col("account_code").asc_nulls_last(),
            F.col("transaction_date").asc_nulls_last(),
            *_newest_first()[1:],
        ]
        rows = page(rows, order, limit, offset, account_levels()).select(*TRANSACTION_COLUMNS)
        return Page(rows, self.transactions.count())

    @staticmethod
    def _newest(rows: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
        return page(
            rows,
            _newest_first(),
            limit,
            offset,
            newest_levels(),
            "transaction_year",
        )

    @staticmethod
    def _order_only(shown) -> list[str]:
        return [name for name in (*LINE, "transaction_year") if name not in shown]
