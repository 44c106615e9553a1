"""The named queries: ``(spark, folder) -> DataFrame``."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.money import as_double
from ledgerloom.functions.rules import (
    apply_rules,
    check_account_code,
    check_amount,
    check_date,
    check_email,
    check_text,
    display_text,
)
from ledgerloom.operators import align, timetravel
from ledgerloom.operators.filters import FilterSpec, SourceSelection, semi_join
from ledgerloom.operators.paging import page
from ledgerloom.plans import quality
from ledgerloom.plans.accounts import account_balances, account_summary
from ledgerloom.plans.dashboard import Dashboard, Page, newest_levels
from ledgerloom.plans.ingest import ingest_folder, new_files, status_counts
from ledgerloom.plans.refresh import refresh
from ledgerloom.plans.staging import ACCOUNT_ORDER, stage
from ledgerloom.plans.transactions import transaction_details, with_running_balance
from ledgerloom.registry import inputs
from ledgerloom.registry.inputs import VERSIONS
from ledgerloom.registry.inputs import saved_ledger as ledger
from ledgerloom.schema import ACCOUNT_MART, LEDGER, TRANSACTION_MART
from ledgerloom.session import new_folder
from ledgerloom.sources import files, logs
from ledgerloom.sources.inventory import file_inventory
from ledgerloom.sources.sample import AS_OF
from ledgerloom.sources.store import VersionStore, migrated
from ledgerloom.streaming.incremental import ingest_available

Query = Callable[[SparkSession, str], DataFrame]

FIRST, SECOND, THIRD = VERSIONS

FILTERS = FilterSpec(
    years={1997, 1998}, quarters={1, 2}, amount_categories={"Large", "Medium"}
)
PERIOD = FilterSpec(years={1999}, months={1, 2, 3})
SEARCH = FilterSpec(
    date_range=(dt.date(1998, 3, 1), dt.date(1999, 2, 28)), search_term=" LINE 3 "
)
# Selections that name no year, quarter or month.
ONE_CONDITION = {
    "account": FilterSpec(account_codes={"42", "7", "103"}),
    "category": FilterSpec(amount_categories={"Large"}),
    "dates": FilterSpec(date_range=(dt.date(1998, 3, 1), dt.date(1999, 2, 28))),
    "search": FilterSpec(search_term=" LINE 3 "),
}
ALL_SOURCES = tuple(f"DUMP{year}.xlsx" for year in range(1995, 2002))
SOURCES = SourceSelection.of(("DUMP1997.xlsx", "DUMP1999.xlsx"), ALL_SOURCES)


def shown(frame: DataFrame) -> DataFrame:
    """Results as callers see them: money as double, dates and times as text."""
    changed = []
    for field in frame.schema:
        value = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, T.DecimalType):
            value = as_double(value)
        elif isinstance(kind, T.DateType):
            value = F.date_format(value, "yyyy-MM-dd")
        elif isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            value = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.IntegerType):
            value = value.cast("bigint")
        elif isinstance(kind, T.ArrayType):
            value = F.array_join(value, ", ")
        changed.append(value.alias(field.name))
    return frame.select(*changed)


def with_total(result: Page) -> DataFrame:
    return result.rows.withColumn("total_count", F.lit(result.total).cast("bigint"))


# --- models -----------------------------------------------------------------


def staged(spark, folder):
    return stage(ledger(spark, folder))


def balances(spark, folder):
    return account_balances(staged(spark, folder), AS_OF)


def running_balance(spark, folder):
    rows = with_running_balance(staged(spark, folder))
    return rows.select(*RUNNING)


def running_balance_sliced(spark, folder):
    """The same, with every account treated as a hot one."""
    rows = staged(spark, folder).select(*dict.fromkeys((*RUNNING[:-1], *ACCOUNT_ORDER)))
    return with_running_balance(rows, hot_rows=0, slice_rows=50_000).select(*RUNNING)


RUNNING = (
    "account_code",
    "transaction_date",
    "booking_number",
    "number",
    "Code1",
    "Code2",
    "net_amount",
    "running_balance",
)


# --- dashboard --------------------------------------------------------------


def on_dashboard(query: Callable[[Dashboard], DataFrame]) -> Query:
    return lambda spark, folder: query(inputs.dashboard(spark, folder))


def deep_page(spark, folder):
    """A page far down: only the days that it lies on are sorted."""
    rows = inputs.marts(spark, folder).transactions.select(*DEEP)
    order = [
        F.col("transaction_date").desc_nulls_last(),
        F.col("booking_number").desc_nulls_last(),
        *[F.col(name).asc_nulls_last() for name in DEEP[3:]],
    ]
    return page(rows, order, limit=50, offset=3000, levels=newest_levels())


DEEP = (
    "transaction_id",
    "transaction_date",
    "booking_number",
    "number",
    "Code1",
    "Code2",
    "debit_amount",
    "credit_amount",
)


def source_filtered(query: Callable[[Dashboard], DataFrame]) -> Query:
    return lambda spark, folder: query(inputs.dashboard(spark, folder, SOURCES))


def row_source_filter(spark, folder):
    rows = inputs.marts(spark, folder).transactions.select("transaction_id", "source_file")
    return SOURCES.keep_rows(rows)


def high_value_transactions(spark, folder):
    """Transactions of the accounts with a high balance."""
    saved = inputs.marts(spark, folder)
    wanted = saved.accounts.where(F.col("balance_value_category") == "High Value")
    rows = saved.transactions.select("transaction_id", "account_code", "net_amount")
    return semi_join(rows, wanted, "account_code")


def date_range_search(spark, folder):
    rows = SEARCH.apply(inputs.marts(spark, folder).transactions)
    return rows.select("transaction_id", "transaction_date", "description", "net_amount")


# --- versions ---------------------------------------------------------------

STORED = (
    "CodeGrootboekrekening",
    "Boekdatum",
    "Boekingsnummer",
    "Nummer",
    "Code1",
    "Code2",
    "Debet",
    "Credit",
    "_loaded_at",
)


def on_store(query: Callable[[VersionStore], DataFrame]) -> Query:
    return lambda spark, folder: query(inputs.store(spark, folder))


def consolidated(spark, folder):
    rows = timetravel.consolidated_view(inputs.store(spark, folder))
    return rows.select("version_id", *STORED)


def relaxed_union(spark, folder):
    """Two halves of the ledger that differ in column order and types."""
    rows = ledger(spark, folder)
    older = F.year("Boekdatum") <= 1998
    first = rows.where(older).select("CodeGrootboekrekening", "Boekingsnummer", "Nummer", "Debet")
    second = rows.where(~older).select(
        F.col("Debet").cast("double"),
        F.col("Nummer").cast("string"),
        F.col("Boekingsnummer").cast("decimal(20,0)"),
        "CodeGrootboekrekening",
    )
    union = align.union_relaxed(first, second)
    return union.withColumn("Boekingsnummer", F.col("Boekingsnummer").cast("bigint"))


def audit_account(store):
    trail = timetravel.audit_trail(
        store, "42", dt.date(1997, 1, 1), dt.date(2000, 12, 31), ordered=False
    )
    return trail.select("_version_file", "_version_created", *STORED)


def audit_versions(store):
    trail = timetravel.audit_trail(store, date_from=dt.date(1999, 1, 1), date_to=dt.date(1999, 6, 30))
    return timetravel.audited_versions(trail)


def as_of_batch(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_orderdate")
    manifest = inputs.store(spark, folder).manifest()
    return timetravel.versions_at(orders, "o_orderdate", manifest)


# --- ingest -----------------------------------------------------------------


def landed_new_files(spark, folder):
    names = ledger(spark, folder).select(F.col("_source_file").alias("name"), "Boekdatum")
    done = names.where(F.year("Boekdatum") <= 1999).select(F.col("name").alias("source_file"))
    return new_files(names.select("name").distinct(), done.distinct())


def permissive_cast(spark, folder):
    rows = files.clean(inputs.dirty_ledger(spark, folder), inputs.LOADED_AT)
    return rows.select(*LEDGER.names, "_loaded_at", "_source_file", "_data_version")


def migrate(spark, folder):
    table = ledger(spark, folder).select(
        *[
            F.col(f.name).cast("double" if isinstance(f.dataType, T.DecimalType) else f.dataType)
            for f in LEDGER
            if f.name != "Nummer"
        ],
        F.col("Nummer").cast("string"),
    )
    return migrated(table, inputs.LOADED_AT)


def ingested(spark, folder):
    store = VersionStore(spark, new_folder(spark, "store"))
    statuses = ingest_folder(store, inputs.landing(spark, folder), inputs.LOADED_AT)
    return store, statuses


def ingest_status(spark, folder):
    return ingested(spark, folder)[1].select("file", "status", "row_count", "rejected", "message")


def ingest_counts(spark, folder):
    """A second run over the same files, one of which had been refused."""
    store, _ = ingested(spark, folder)
    return status_counts(
        ingest_folder(store, inputs.landing(spark, folder), inputs.LOADED_AT + dt.timedelta(1))
    )


def landed_version(store, name):
    manifest = store.manifest().where(F.col("landed") == name)
    return manifest.select("snapshot_id").first()[0]


def landed_extras(spark, folder):
    """A version of an export that has a column of its own."""
    store, _ = ingested(spark, folder)
    rows = store.read(landed_version(store, f"DUMP{inputs.WITHOUT_OPTIONAL}.csv"))
    return rows.select("Boekingsnummer", "Nummer", "Code1", "Code2", "Debet", "Credit", "Opmerking")


def compare_landed(spark, folder):
    """Versions of two exports, one with a column of its own."""
    store, _ = ingested(spark, folder)
    both = [landed_version(store, f"DUMP{y}.csv") for y in (1997, inputs.WITHOUT_OPTIONAL)]
    return timetravel.compare_versions(store, *both).select(
        "rows1", "rows2", "columns1", "columns2", "new_columns", "removed_columns"
    )


def declared_table(spark, folder):
    """The stored rows through the catalog, declared before anything was stored."""
    store = VersionStore(spark, new_folder(spark, "store"))
    name = f"declared_{uuid.uuid4().hex}"
    store.create_table(name)
    ingest_folder(store, inputs.landing(spark, folder), inputs.LOADED_AT)
    return spark.table(name).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("Debet").alias("debit")
    )


def export_parquet(spark, folder):
    path = new_folder(spark, "export")
    files.write_rows(ledger(spark, folder), path)
    return spark.read.parquet(path).select(
        "CodeGrootboekrekening", "Boekdatum", "Boekingsnummer", "Nummer", "Debet", "Credit"
    )


def raw_load(spark, folder):
    """Two loads in one second; the first is read."""
    store = VersionStore(spark, new_folder(spark, "store"))
    first = ledger(spark, folder).select(*LEDGER.names)
    version = store.load_raw(first, "manual.csv", inputs.LOADED_AT)
    store.load_raw(first.limit(1), "manual.csv", inputs.LOADED_AT)
    return store.read(version).select(
        "CodeGrootboekrekening", "Boekdatum", "Boekingsnummer", "Debet", "Credit",
        "_loaded_at", "_source_file", "_data_version",
    )


def incremental_ingest(spark, folder):
    """A batch run and two of the stream over one folder: the stream finds nothing new."""
    store, _ = ingested(spark, folder)
    checkpoint = new_folder(spark, "stream")
    for _ in range(2):
        ingest_available(
            store, inputs.landing(spark, folder), checkpoint, clock=lambda: inputs.LOADED_AT
        )
    rows = store.read_all().groupBy(F.col("_source_file").alias("source_file"))
    return rows.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("Debet").alias("total_debit"),
        F.sum("Credit").alias("total_credit"),
    )


def faulty_ingest(spark, folder):
    store = VersionStore(spark, new_folder(spark, "store"))
    return store, ingest_folder(store, inputs.faulty_landing(spark, folder), inputs.LOADED_AT)


def quarantined(spark, folder):
    """What was read and not stored, and why. Of a record without a date the text is not compared:
    it is the record as it was parsed."""
    store, _ = faulty_ingest(spark, folder)
    text = F.when(F.col("reason") != files.DATE, F.col("text"))
    return store.quarantine().groupBy("file", "reason").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(F.length(text)).alias("characters"),
        F.min(text).alias("first_text"),
    )


def faulty_exports(spark, folder):
    """Each export by itself: its status, and what was stored of it."""
    store, statuses = faulty_ingest(spark, folder)
    stored = store.read_all().groupBy(F.col("_source_file").alias("file")).agg(
        F.sum("Debet").alias("debit"), F.sum(F.length("Omschrijving")).alias("characters")
    )
    return statuses.join(stored, "file", "left").select(
        "file", "status", "row_count", "rejected", "debit", "characters"
    )


def late_parts(spark, folder):
    """An export whose parts land one after another, ingested by batch and stream in turn."""
    store = VersionStore(spark, new_folder(spark, "store"))
    landing, checkpoint = new_folder(spark, "late"), new_folder(spark, "stream")
    for part in range(3):
        inputs.late_parts(spark, folder, landing, part, 3)
        at = inputs.LOADED_AT + dt.timedelta(part)
        if part == 1:
            ingest_available(store, landing, checkpoint, clock=lambda at=at: at)
        else:
            ingest_folder(store, landing, at)
    return store.read_all().groupBy(F.col("_source_file").alias("source_file")).agg(
        F.countDistinct("version_id").alias("versions"),
        F.count(F.lit(1)).alias("row_count"),
        F.sum("Debet").alias("total_debit"),
    )


def ingestion_log_rows(spark, folder):
    """A log of one line with two records per order, read back as rows."""
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    key = F.col("o_orderkey").cast("string")
    record = lambda name, rows: F.concat(
        stamp, F.lit(" | "), name, F.lit(".xlsx | "), name, F.lit(".parquet | "),
        rows.cast("string"), F.lit(" rows\\n"),
    )
    text = spark.read.parquet(f"{folder}/orders.parquet").select(
        F.concat(
            record(F.concat(F.lit("order"), key), F.col("o_custkey")),
            record(F.concat(F.lit("copy"), key), F.col("o_orderkey")),
        ).alias("value")
    )
    return logs.parse_ingestion_log(text)


def inventory(spark, folder):
    return file_inventory(spark, inputs.landing(spark, folder)).select(
        "filename", "n_columns", "n_rows", "total_debit", "total_credit", "status", "source"
    )


def conformance(spark, folder):
    landed = files.discover(spark, inputs.landing(spark, folder))
    return files.conformance_report(spark, files.exports(spark, landed))


def version_label(spark, folder):
    label = inputs.store(spark, folder).data_label()
    return inputs.store(spark, folder).manifest().agg(
        F.lit(label).alias("label"), F.sum("records_count").alias("records")
    )


# --- quality ----------------------------------------------------------------


def tested_models(spark, folder):
    saved = inputs.marts(spark, folder)
    return {
        "stg_financial_transactions": staged(spark, folder),
        "int_account_balances": account_balances(saved.transactions, AS_OF),
        "mart_account_summary": saved.accounts,
        "mart_transaction_details": saved.transactions,
    }


def not_null_tests(spark, folder):
    rows = inputs.dirty_transactions(spark, folder)
    return quality.not_null_tests(rows, "dirty_transactions", rows.columns)


def unique_tests(spark, folder):
    """One that holds and one that does not."""
    saved = inputs.marts(spark, folder)
    model = "mart_transaction_details"
    return quality.unique_test(saved.transactions, model, "transaction_id").unionByName(
        quality.unique_test(saved.transactions, model, "booking_number")
    )


def test_results(spark, folder):
    return quality.run_tests(tested_models(spark, folder))


def as_text(spark, folder):
    """Transactions whose amounts are text, not all of it numbers."""
    amount = F.col("net_amount").cast("string")
    return inputs.marts(spark, folder).transactions.select(
        "transaction_id",
        "booking_number",
        inputs.by_line("number", {1: F.lit("n/a")}, amount).alias("net_amount"),
        "debit_amount",
        "amount_category",
        "vat_code",
        inputs.by_line("number", {2: F.lit("-")}, amount).alias("vat_reported"),
    )


def lenient_schema(spark, folder):
    return quality.validate_schema(as_text(spark, folder), TRANSACTION_MART)


def strict_schema(spark, folder):
    """How the saved account mart differs from its declared schema."""
    return quality.schema_report(inputs.marts(spark, folder).accounts, ACCOUNT_MART)


def standardize_numeric(spark, folder):
    return quality.standardize_numeric(as_text(spark, folder))


LINE = ("booking_number", "number", "code1", "code2")


def checked(column: str, rule) -> Query:
    def query(spark, folder):
        rows = inputs.dirty_transactions(spark, folder)
        return apply_rules(rows, {"value": rule(column)}).select(
            *LINE, F.col("clean_value").alias("value"), F.col("error_value").alias("error")
        )

    return query


def checked_amounts(spark, folder):
    rules = {
        "value": check_amount("debit_amount"),
        "unsigned": check_amount("debit_amount", allow_negative=False),
    }
    return apply_rules(inputs.dirty_transactions(spark, folder), rules).select(
        *LINE,
        F.col("clean_value").cast("double").alias("value"),
        F.col("error_value").alias("error"),
        F.col("error_unsigned").alias("unsigned_error"),
    )


def validated(spark, folder):
    return quality.validate_transactions(inputs.dirty_transactions(spark, folder), AS_OF)


def valid_transactions(spark, folder):
    rows = quality.valid_records(validated(spark, folder))
    return rows.withColumns(
        {name: F.col(name).cast("double") for name in ("debit_amount", "credit_amount")}
    )


def validation_report(spark, folder):
    order = [F.col(name).asc_nulls_last() for name in (*LINE, "debit_amount", "description")]
    rows = quality.validation_report(validated(spark, folder), order)
    return rows.select(*LINE, "errors", "more_invalid")


def validated_accounts(spark, folder):
    """Account records, some without a name, some with text for a total."""
    rows = inputs.marts(spark, folder).accounts.select(
        F.col("account_code"),
        F.when(F.col("balance_value_category") == "Low Value", " ")
        .otherwise(F.col("account_name"))
        .alias("account_name"),
        F.when(F.col("activity_status") == "Inactive", "unknown")
        .otherwise(F.col("total_debit").cast("string"))
        .alias("total_debit"),
        "total_credit",
        "net_balance",
    )
    return quality.validate_accounts(rows)


# --- texts ------------------------------------------------------------------


def model_texts(spark, folder):
    """A model text per order, in one of the three layers; some are examples."""
    key = F.col("o_orderkey").cast("string")
    layer = (
        F.when(F.col("o_orderstatus") == "F", "staging/")
        .when(F.col("o_orderstatus") == "O", "intermediate/")
        .otherwise("marts/")
    )
    prefix = F.when(F.col("o_orderpriority") == "5-LOW", "my_").otherwise("order_")
    customer = F.col("o_custkey").cast("string")
    text = F.concat(
        F.lit("select * from {{ ref('customer_"), customer, F.lit("') }}\njoin {{ ref(\"calendar\") }}"),
        F.when(
            F.col("o_orderstatus") == "F",
            F.concat(F.lit("\njoin {{ source('sales',  \"lines_"), key, F.lit("\") }}")),
        ).otherwise(""),
    )
    return spark.read.parquet(f"{folder}/orders.parquet").select(
        F.concat(layer, prefix, key, F.lit(".sql")).alias("path"), text.alias("text")
    )


def run_log(spark, folder):
    """Log lines made of events: which command, and how it ended."""
    command = (
        F.when(F.col("event_type") == "click", "dbt debug")
        .when(F.col("event_type") == "view", "dbt run --select marts")
        .when(F.col("event_type") == "signup", "dbt seed")
        .otherwise("dbt run")
    )
    ended = F.when(F.col("value") > 50, "failed").otherwise("succeeded")
    at = F.date_format("ts", "HH:mm:ss")
    finished = F.concat(
        at, F.lit("  Command `"), command, F.lit("` "), ended, F.lit(" at "), at, F.lit(" after 1s")
    )
    started = F.concat(at, F.lit("  Running with `"), command, F.lit("`"))
    return spark.read.parquet(f"{folder}/events.parquet").select(
        F.col("event_id").alias("line"),
        F.when(F.col("event_type") == "error", started).otherwise(finished).alias("value"),
    )


def sanitized_documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").select(
        "doc_id", display_text("text").alias("display")
    )


def checked_documents(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return apply_rules(documents, {"value": check_text("text", 1, 1000)}).select(
        "doc_id", F.col("clean_value").alias("value"), F.col("error_value").alias("error")
    )


# --- workflow ---------------------------------------------------------------


def refresh_steps(spark, folder):
    """The workflow over the landed exports; one of them is refused."""
    return refresh(
        VersionStore(spark, new_folder(spark, "store")),
        inputs.landing(spark, folder),
        new_folder(spark, "marts"),
        dt.datetime.combine(AS_OF, dt.time(12)),
    ).drop("duration_sec")


QUERIES: dict[str, Query] = {
    "staged_ledger": staged,
    "int_account_balances": balances,
    "mart_account_summary": lambda s, f: account_summary(balances(s, f)),
    "mart_transaction_details": lambda s, f: transaction_details(staged(s, f), AS_OF),
    "running_balance": running_balance,
    "running_balance_sliced": running_balance_sliced,
    "top_accounts": on_dashboard(lambda d: d.top_accounts_by_balance(10)),
    "account_summary_page": on_dashboard(lambda d: with_total(d.paginated_accounts(20, 20))),
    "transaction_page": on_dashboard(lambda d: with_total(d.paginated_transactions(500, 100))),
    "transaction_page_deep": deep_page,
    "activity_breakdown": on_dashboard(lambda d: d.account_activity_breakdown()),
    "transaction_stats": on_dashboard(lambda d: d.transaction_stats()),
    "dashboard_stats": on_dashboard(lambda d: d.dashboard_stats()),
    "monthly_trends": on_dashboard(lambda d: d.monthly_trends(12)),
    "filtered_transactions": on_dashboard(lambda d: d.filtered_transactions(FILTERS, None)),
    "source_filtered_transactions": source_filtered(
        lambda d: d.filtered_transactions(FilterSpec(), None)
    ),
    "source_filtered_accounts": source_filtered(lambda d: d.account_summary()),
    "row_source_filter": row_source_filter,
    "high_value_transactions": high_value_transactions,
    "date_range_search": date_range_search,
    "filtered_account_rollup": on_dashboard(lambda d: d.filtered_account_rollup(PERIOD)),
    "filtered_stats": on_dashboard(lambda d: d.filtered_stats(PERIOD)),
    "filtered_accounts_page": on_dashboard(
        lambda d: with_total(d.filtered_paginated_accounts(PERIOD, 40, 20))
    ),
    "filtered_transactions_page": on_dashboard(
        lambda d: with_total(d.filtered_paginated_transactions(PERIOD, 30, 15))
    ),
    "sorted_accounts": on_dashboard(lambda d: d.sorted_accounts()),
    "sorted_limited_transactions": on_dashboard(lambda d: d.limited_transactions(20)),
    "accounts_slice": on_dashboard(lambda d: with_total(d.accounts_slice(40, 20))),
    "transactions_slice": on_dashboard(lambda d: with_total(d.transactions_slice(1500, 15))),
    **{
        f"stats_by_{name}": on_dashboard(lambda d, spec=spec: d.filtered_stats(spec))
        for name, spec in ONE_CONDITION.items()
    },
    **{
        f"page_by_{name}": on_dashboard(
            lambda d, spec=spec: with_total(d.filtered_paginated_transactions(spec, 3, 15))
        )
        for name, spec in ONE_CONDITION.items()
    },
    "stats_of_all": on_dashboard(lambda d: d.filtered_stats(FilterSpec())),
    "sorted_by_account": on_dashboard(lambda d: d.sorted_accounts(ONE_CONDITION["account"])),
    "limited_by_search": on_dashboard(
        lambda d: d.limited_transactions(20, ONE_CONDITION["search"])
    ),
    "mart_counts": on_dashboard(lambda d: d.mart_counts()),
    "last_refresh": on_dashboard(lambda d: d.last_refresh_time()),
    "daily_volume": on_dashboard(lambda d: d.daily_volume()),
    "type_distribution": on_dashboard(lambda d: d.balance_type_distribution()),
    "amount_histogram": on_dashboard(lambda d: d.amount_histogram()),
    "balance_chart": on_dashboard(lambda d: d.balance_chart()),
    "version_list": on_store(lambda v: v.list_versions().select("file", "created")),
    "manifest": on_store(lambda v: v.snapshots().drop("file_size_mb")),
    "version_label": version_label,
    "version_read": on_store(lambda v: v.read(FIRST.id).select(*STORED)),
    "latest_version": on_store(lambda v: v.read_latest().select(*STORED)),
    "as_of_timestamp": on_store(
        lambda v: timetravel.query_at_timestamp(v, dt.datetime(2001, 6, 1, 12)).select(*STORED)
    ),
    "as_of_date": on_store(
        lambda v: timetravel.query_at_date(v, dt.date(1999, 2, 24)).select(*STORED)
    ),
    "as_of_batch": as_of_batch,
    "compare_versions": on_store(lambda v: timetravel.compare_versions(v, FIRST.id, SECOND.id)),
    "changes_since": on_store(lambda v: timetravel.changes_since(v, FIRST.id).drop("size_mb")),
    "relaxed_union": relaxed_union,
    "consolidated": consolidated,
    "audit_trail": on_store(audit_account),
    "audit_versions": on_store(audit_versions),
    "new_files": landed_new_files,
    "permissive_cast": permissive_cast,
    "migrate": migrate,
    "raw_load": raw_load,
    "landed_extras": landed_extras,
    "compare_landed": compare_landed,
    "declared_table": declared_table,
    "export_parquet": export_parquet,
    "conformance_report": conformance,
    "ingest_status": ingest_status,
    "quarantined": quarantined,
    "faulty_exports": faulty_exports,
    "late_parts": late_parts,
    "ingest_counts": ingest_counts,
    "incremental_ingest": incremental_ingest,
    "ingestion_log_rows": ingestion_log_rows,
    "file_inventory": inventory,
    "not_null_tests": not_null_tests,
    "unique_tests": unique_tests,
    "test_results": test_results,
    "strict_schema": strict_schema,
    "lenient_schema": lenient_schema,
    "standardize_numeric": standardize_numeric,
    "validate_amounts": checked_amounts,
    "validate_codes": checked("account_code", check_account_code),
    "validate_dates": checked(
        "transaction_date", lambda c: check_date(c, dt.date(1900, 1, 1), AS_OF)
    ),
    "validate_text": checked("description", lambda c: check_text(c, 1, 500)),
    "validate_html_text": checked("description", lambda c: check_text(c, 0, 500, True)),
    "validate_documents": checked_documents,
    "validate_emails": checked("email", check_email),
    "validate_transactions": lambda s, f: quality.validation_summary(validated(s, f)),
    "valid_transactions": valid_transactions,
    "error_counts": lambda s, f: quality.error_counts(validated(s, f)),
    "validate_accounts": lambda s, f: quality.validation_summary(validated_accounts(s, f)),
    "account_errors": lambda s, f: quality.error_counts(validated_accounts(s, f)),
    "validation_report": validation_report,
    "sanitize_display": sanitized_documents,
    "lineage_edges": lambda s, f: logs.lineage_edges(model_texts(s, f)),
    "model_list": lambda s, f: logs.model_list(model_texts(s, f)),
    "run_log_status": lambda s, f: logs.run_log_status(run_log(s, f)),
    "refresh_steps": refresh_steps,
}


def queries() -> dict[str, Query]:
    def as_shown(query: Query) -> Query:
        return lambda spark, folder: shown(query(spark, folder))

    return {name: as_shown(query) for name, query in QUERIES.items()}
