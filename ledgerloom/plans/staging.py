"""Loaded ledger rows -> staged transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.classify import transaction_type
from ledgerloom.functions.money import amount_or_zero
from ledgerloom.schema import NET

# Canonical names of the export's columns.
RENAMED = {
    "CodeGrootboekrekening": "account_code",
    "NaamGrootboekrekening": "account_name",
    "Code": "transaction_code",
    "Boekingsnummer": "booking_number",
    "Boekdatum": "transaction_date",
    "Periode": "period",
    "Omschrijving": "description",
    "Debet": "debit_amount",
    "Credit": "credit_amount",
    "Saldo": "balance_amount",
    "Btwbedrag": "vat_amount",
    "Btwcode": "vat_code",
    "Boekingsstatus": "booking_status",
    "Nummer": "number",
    "Factuurnummer": "invoice_number",
    "_loaded_at": "loaded_timestamp",
    "_source_file": "source_file",
    "_data_version": "data_version",
}
PASSED_THROUGH = ("CodeAdministratie", "NaamAdministratie", "Code1", "Code2")
AMOUNTS = ("Debet", "Credit", "Saldo", "Btwbedrag")

# A total order of an account's lines: date and booking, then the line itself.
ACCOUNT_ORDER = (
    "transaction_date",
    "booking_number",
    "number",
    "Code1",
    "Code2",
    "debit_amount",
    "credit_amount",
)


def stage(ledger: DataFrame) -> DataFrame:
    """Canonical names, amounts without NULLs, period parts, type and net amount.

    Rows without a date or an account are left out.
    """
    kept = ledger.where(
        F.col("Boekdatum").isNotNull() & F.col("CodeGrootboekrekening").isNotNull()
    )
    day = F.col("Boekdatum")
    net = F.coalesce(F.col("Debet"), F.lit(0)) - F.coalesce(F.col("Credit"), F.lit(0))
    renamed = [
        (amount_or_zero(name) if name in AMOUNTS else F.col(name)).alias(alias)
        for name, alias in RENAMED.items()
    ]
    return kept.select(
        *PASSED_THROUGH,
        *renamed,
        F.year(day).cast("bigint").alias("transaction_year"),
        F.quarter(day).cast("bigint").alias("transaction_quarter"),
        F.month(day).cast("bigint").alias("transaction_month"),
        transaction_type("Debet", "Credit").alias("transaction_type"),
        net.cast(NET).alias("net_amount"),
    )
