"""Declared schemas: the raw ledger, the marts, files, models and versions."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(15, 2)
NET = T.DecimalType(16, 2)  # difference of two MONEY values
TOTAL = T.DecimalType(28, 2)  # sums of MONEY or NET over any number of rows

# The export layout. The order is part of the format, the
# twelfth column being the debit amount.
LEDGER = T.StructType(
    [
        T.StructField("CodeAdministratie", T.StringType()),
        T.StructField("NaamAdministratie", T.StringType()),
        T.StructField("CodeGrootboekrekening", T.StringType()),
        T.StructField("NaamGrootboekrekening", T.StringType()),
        T.StructField("Code", T.StringType()),
        T.StructField("Boekingsnummer", T.LongType()),
        T.StructField("Boekdatum", T.DateType()),
        T.StructField("Periode", T.StringType()),
        T.StructField("Code1", T.StringType()),
        T.StructField("Code2", T.StringType()),
        T.StructField("Omschrijving", T.StringType()),
        T.StructField("Debet", MONEY),
        T.StructField("Credit", MONEY),
        T.StructField("Saldo", MONEY),
        T.StructField("Btwbedrag", MONEY),
        T.StructField("Btwcode", T.StringType()),
        T.StructField("Boekingsstatus", T.StringType()),
        T.StructField("Nummer", T.LongType()),
        T.StructField("Factuurnummer", T.StringType()),
    ]
)

# Load metadata. Timestamps are zone-free throughout, as a ledger's dates are.
LOAD_METADATA = T.StructType(
    [
        T.StructField("_loaded_at", T.TimestampNTZType()),
        T.StructField("_source_file", T.StringType()),
        T.StructField("_data_version", T.LongType()),
    ]
)

LOADED_LEDGER = T.StructType(LEDGER.fields + LOAD_METADATA.fields)

# A file is accepted when it carries at least these.
CORE_COLUMNS = ("CodeGrootboekrekening", "Boekdatum", "Debet", "Credit")

# One ledger line is identified by the first three columns; the others give a
# total order among the lines of one booking.
BUSINESS_KEY = ("CodeGrootboekrekening", "Boekdatum", "Boekingsnummer")
LINE_ORDER = ("Nummer", "Code1", "Code2", "Debet", "Credit")

VERSION_MANIFEST = T.StructType(
    [
        T.StructField("snapshot_id", T.StringType()),
        T.StructField("created", T.TimestampNTZType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("parquet_file", T.StringType()),
        T.StructField("records_count", T.LongType()),
        T.StructField("file_size_mb", T.DoubleType()),
        T.StructField("operation", T.StringType()),
        T.StructField("columns", T.ArrayType(T.StringType())),  # that the version came with
        T.StructField("landed", T.StringType()),  # the export it was ingested from
    ]
)

INGESTION_LOG = T.StructType(
    [
        T.StructField("logged_at", T.TimestampNTZType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("output_file", T.StringType()),
        T.StructField("row_count", T.LongType()),
    ]
)

# What callers of the query layer are promised.
SNAPSHOT = T.StructType(
    [
        T.StructField("snapshot_id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("parquet_file", T.StringType()),
        T.StructField("records_count", T.LongType()),
        T.StructField("file_size_mb", T.DoubleType()),
        T.StructField("operation", T.StringType()),
    ]
)

ACCOUNT_MART = T.StructType(
    [
        T.StructField("account_code", T.StringType()),
        T.StructField("account_name", T.StringType()),
        T.StructField("total_transactions", T.LongType()),
        T.StructField("total_debit", T.DoubleType()),
        T.StructField("total_credit", T.DoubleType()),
        T.StructField("net_balance", T.DoubleType()),
        T.StructField("total_vat", T.DoubleType()),
        T.StructField("net_amount_last_12_months", T.DoubleType()),
        T.StructField("transactions_last_12_months", T.LongType()),
        T.StructField("first_transaction_date", T.DateType()),
        T.StructField("last_transaction_date", T.DateType()),
        T.StructField("years_active", T.LongType()),
        T.StructField("account_balance_type", T.StringType()),
        T.StructField("activity_status", T.StringType()),
        T.StructField("transaction_volume_category", T.StringType()),
        T.StructField("balance_value_category", T.StringType()),
        T.StructField("last_updated", T.TimestampNTZType()),
    ]
)

TRANSACTION_MART = T.StructType(
    [
        T.StructField("account_code", T.StringType()),
        T.StructField("account_name", T.StringType()),
        T.StructField("transaction_date", T.DateType()),
        T.StructField("booking_date", T.DateType()),
        T.StructField("description", T.StringType()),
        T.StructField("debit_amount", T.DoubleType()),
        T.StructField("credit_amount", T.DoubleType()),
        T.StructField("net_amount", T.DoubleType()),
        T.StructField("booking_number", T.StringType()),
        T.StructField("reference", T.StringType()),
        T.StructField("transaction_id", T.StringType()),
    ]
)

FILE_METADATA = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("size_mb", T.DoubleType()),
        T.StructField("n_columns", T.LongType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("total_debit", T.DoubleType()),
        T.StructField("total_credit", T.DoubleType()),
        T.StructField("modified", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)

MODEL_LIST = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("dependencies", T.StringType()),
        T.StructField("sources", T.StringType()),
    ]
)
