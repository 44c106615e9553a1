"""Building and saving the marts."""

from __future__ import annotations

import datetime as dt
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ledgerloom.plans.accounts import account_balances, account_summary
from ledgerloom.plans.staging import stage
from ledgerloom.plans.transactions import transaction_details
from ledgerloom.session import PACKED, without_leftovers

ROWS_PER_FILE = 10_000_000


class Marts(NamedTuple):
    transactions: DataFrame
    accounts: DataFrame


def marts(ledger: DataFrame, as_of: dt.date, updated_at: dt.datetime | None = None) -> Marts:
    """Both marts as plans."""
    staged = stage(ledger)
    return Marts(
        transaction_details(staged, as_of, updated_at),
        account_summary(account_balances(staged, as_of), updated_at),
    )


def save_snapshot(ledger: DataFrame, folder: str) -> DataFrame:
    """Write consolidated ledger rows below ``folder`` and read them back.

    The marts and their tests read the ledger several times; saved, it is
    consolidated once.
    """
    path = f"{folder}/ledger_snapshot-{uuid.uuid4().hex}"
    with without_leftovers(ledger.sparkSession):
        writer = ledger.write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE)
        writer.options(**PACKED).parquet(path)
    return ledger.sparkSession.read.schema(ledger.schema).parquet(path)


def save_marts(
    ledger: DataFrame,
    folder: str,
    as_of: dt.date,
    updated_at: dt.datetime | None = None,
    made_of: str | None = None,
) -> Marts:
    """Write both marts below ``folder`` and read them back.

    The staged rows are computed once: the transaction mart holds all of them,
    so the accounts are summed from its saved columns. It is partitioned by
    year, which most filters name. Each call writes a folder of its own, so that
    readers of earlier marts are not disturbed, and is named in ``current`` at the end, along
    with ``made_of``, which says what it was made of.
    """
    spark = ledger.sparkSession
    root, folder = folder, f"{folder}/{uuid.uuid4().hex}"
    details = transaction_details(stage(ledger), as_of, updated_at)
    with without_leftovers(spark):
        (
            details.write.mode("overwrite")
            .options(**PACKED, maxRecordsPerFile=ROWS_PER_FILE)
            .partitionBy("transaction_year")
            .parquet(f"{folder}/mart_transaction_details")
        )
    transactions = spark.read.schema(details.schema).parquet(
        f"{folder}/mart_transaction_details"
    )
    summary = account_summary(account_balances(transactions, as_of), updated_at)
    with without_leftovers(spark):
        summary.write.mode("overwrite").options(**PACKED).parquet(f"{folder}/mart_account_summary")
    spark.range(1).select(
        F.lit(folder).alias("folder"),
        F.current_timestamp().alias("written_at"),
        F.lit(made_of).cast("string").alias("made_of"),
    ).write.mode("append").parquet(f"{root}/current")
    return Marts(
        transactions,
        spark.read.schema(summary.schema).parquet(f"{folder}/mart_account_summary"),
    )


CURRENT = "folder string, written_at timestamp, made_of string"


def current_marts(spark: SparkSession, folder: str) -> Marts:
    """The marts saved last below ``folder``."""
    newest = spark.read.schema(CURRENT).parquet(f"{folder}/current").agg(F.max_by("folder", "written_at")).first()[0]
    return Marts(
        spark.read.parquet(f"{newest}/mart_transaction_details"),
        spark.read.parquet(f"{newest}/mart_account_summary"),
    )


def current_made_of(spark: SparkSession, folder: str) -> str | None:
    """What the marts saved last were made of; None if there are none."""
    try:
        rows = spark.read.schema(CURRENT).parquet(f"{folder}/current")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.agg(F.max_by(F.coalesce("made_of", F.lit("")), "written_at")).first()[0]
