"""Reference SQL of the named queries, for an independent engine.

Written against the sample tables alone. Each text is a chain of common table
expressions ending in the query; money is decimal until the last cast.
"""

from __future__ import annotations

from ledgerloom.registry.inputs import (
    AS_JSON,
    AS_PARQUET,
    IN_TWO_ORDERS,
    REPEATED,
    VERSIONS,
    WITHOUT_CORE,
    WITHOUT_OPTIONAL,
)

AS_OF = "DATE '2001-11-04'"

# Labels, and the bounds above which (of days: up to which) they hold; the last label
# holds for all others.
VOLUME = [(100, "High Volume"), (20, "Medium Volume")], "Low Volume"
VALUE = [(10000, "High Value"), (1000, "Medium Value")], "Low Value"
AMOUNT = [(5000, "Large"), (1000, "Medium"), (100, "Small")], "Minimal"
ACTIVITY = [(30, "Active"), (90, "Recently Active")], "Inactive"
RECENCY = [(30, "Last 30 days"), (90, "Last 90 days"), (365, "Last year")], "Older than 1 year"


def labelled(value: str, comparison: str, labels: tuple[list[tuple[int, str]], str]) -> str:
    """The label of the first bound that the value compares with."""
    bounds, last = labels
    cases = " ".join(f"WHEN {value} {comparison} {bound} THEN '{label}'" for bound, label in bounds)
    return f"CASE {cases} ELSE '{last}' END"


LOADED_AT = "2002-03-01 08:00:00"
LOADED_EPOCH = 1014969600

LEDGER = """
lines AS (
  SELECT *, CAST(l_shipdate AS DATE) AS day,
         CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_discount AS DECIMAL(4,2))
              AS DECIMAL(15,2)) AS amt
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
),
ledger AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS CodeAdministratie,
         c_mktsegment AS NaamAdministratie,
         CAST(o_custkey AS VARCHAR) AS CodeGrootboekrekening,
         c_name AS NaamGrootboekrekening,
         o_orderpriority AS Code,
         l_orderkey AS Boekingsnummer,
         day AS Boekdatum,
         strftime(day, '%Y-%m') AS Periode,
         CAST(l_suppkey AS VARCHAR) AS Code1,
         CAST(l_partkey AS VARCHAR) AS Code2,
         CASE WHEN l_linenumber = 7 THEN ' ' ELSE 'line ' || l_linenumber END AS Omschrijving,
         CASE WHEN l_returnflag <> 'R' THEN amt END AS Debet,
         CASE WHEN l_returnflag = 'R' THEN amt END AS Credit,
         CAST(l_extendedprice AS DECIMAL(15,2)) AS Saldo,
         CAST(amt * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(15,2)) AS Btwbedrag,
         l_returnflag AS Btwcode,
         l_linestatus AS Boekingsstatus,
         CAST(l_linenumber AS BIGINT) AS Nummer,
         'INV' || o_orderkey AS Factuurnummer,
         (year(day) + 1) || '-02-24 00:00:00' AS _loaded_at,
         'DUMP' || year(day) || '.xlsx' AS _source_file,
         year(day) AS _data_version
  FROM lines
)"""

STAGED = """
staged AS (
  SELECT CodeAdministratie, NaamAdministratie, Code1, Code2,
         CodeGrootboekrekening AS account_code, NaamGrootboekrekening AS account_name,
         Code AS transaction_code, Boekingsnummer AS booking_number,
         Boekdatum AS transaction_date, Periode AS period, Omschrijving AS description,
         coalesce(Debet, 0.00) AS debit_amount, coalesce(Credit, 0.00) AS credit_amount,
         coalesce(Saldo, 0.00) AS balance_amount, coalesce(Btwbedrag, 0.00) AS vat_amount,
         Btwcode AS vat_code, Boekingsstatus AS booking_status, Nummer AS number,
         Factuurnummer AS invoice_number, _loaded_at AS loaded_timestamp,
         _source_file AS source_file, CAST(_data_version AS BIGINT) AS data_version,
         CAST(year(Boekdatum) AS BIGINT) AS transaction_year,
         CAST(quarter(Boekdatum) AS BIGINT) AS transaction_quarter,
         CAST(month(Boekdatum) AS BIGINT) AS transaction_month,
         CASE WHEN Debet > 0 THEN 'Debit' WHEN Credit > 0 THEN 'Credit' ELSE 'Zero' END
           AS transaction_type,
         coalesce(Debet, 0.00) - coalesce(Credit, 0.00) AS net_amount
  FROM ledger WHERE Boekdatum IS NOT NULL AND CodeGrootboekrekening IS NOT NULL
)"""

# Every figure is summed from the days of an account. The names of the result's columns.
BALANCES = f"""
account_days AS (
  SELECT account_code, account_name, transaction_date AS on_day,
         {AS_OF} - transaction_date AS age, count(*) AS n, sum(vat_amount) AS vat,
         sum(debit_amount) AS debit, sum(credit_amount) AS credit
  FROM {{rows}} GROUP BY ALL
),
named AS (
  SELECT account_code, account_name, sum(n)::BIGINT AS n, count(on_day) AS days, sum(debit) AS debit,
         sum(credit) AS credit, sum(vat) AS vat, min(on_day) AS first_day, max(on_day) AS last_day,
         min(age) AS since_last,
         coalesce(sum(debit - credit) FILTER (age <= 365), 0) AS moved_in_year,
         coalesce(sum(n) FILTER (age <= 365), 0) AS n_in_year,
         coalesce(sum(debit - credit) FILTER (age <= 270), 0) AS moved_in_quarters
  FROM account_days GROUP BY ALL
),
coded AS (
  SELECT account_code, len(list(DISTINCT year(on_day))) AS years FROM account_days GROUP BY ALL
),
balances AS (
  SELECT account_code, account_name, n AS total_transactions, days AS unique_transaction_dates,
         debit AS total_debit, credit AS total_credit, debit - credit AS net_balance,
         vat AS total_vat, first_day AS first_transaction_date, last_day AS last_transaction_date,
         CASE WHEN debit > credit THEN 'Net Debit' WHEN credit > debit THEN 'Net Credit'
              ELSE 'Balanced' END AS account_balance_type,
         {labelled("since_last", "<=", ACTIVITY)} AS activity_status,
         years AS years_active,
         sum(moved_in_year) OVER same_code AS net_amount_12m,
         (sum(n_in_year) OVER same_code)::BIGINT AS transactions_12m,
         sum(moved_in_quarters) OVER same_code AS net_amount_4q,
         n / (last_day - first_day + 1) AS avg_daily_transaction_frequency
  FROM named JOIN coded USING (account_code) WINDOW same_code AS (PARTITION BY account_code)
),
accounts AS (
  SELECT * EXCLUDE (net_amount_12m, transactions_12m, net_amount_4q),
         net_amount_12m AS net_amount_last_12_months,
         transactions_12m AS transactions_last_12_months,
         net_amount_4q AS net_amount_last_4_quarters,
         {labelled("total_transactions", ">", VOLUME)} AS transaction_volume_category,
         {labelled("abs(net_balance)", ">", VALUE)} AS balance_value_category,
         CAST({{updated}} AS VARCHAR) AS last_updated
  FROM balances
)"""
UPDATED = f"'{LOADED_AT}'"

DETAILS = f"""
details AS (
  SELECT md5(coalesce(account_code, '') || '|' || coalesce(CAST(transaction_date AS VARCHAR), '')
             || '|' || coalesce(CAST(booking_number AS VARCHAR), '') || '|'
             || coalesce(description, '') || '|' || CAST(net_amount AS VARCHAR)) AS transaction_id,
         account_code, account_name, transaction_date, booking_number, description,
         debit_amount, credit_amount, net_amount, balance_amount, vat_amount,
         transaction_type, transaction_year, transaction_quarter, transaction_month,
         transaction_code, Code1, Code2, vat_code, booking_status, number, invoice_number,
         source_file, loaded_timestamp,
         strftime(transaction_date, '%A') AS day_of_week,
         CAST(day(transaction_date) AS BIGINT) AS day_of_month,
         'Q' || quarter(transaction_date) AS quarter_label,
         {labelled("abs(net_amount)", ">", AMOUNT)} AS amount_category,
         {labelled(f"{AS_OF} - transaction_date", "<=", RECENCY)} AS recency_category,
         sum(net_amount) OVER (
           PARTITION BY account_code
           ORDER BY transaction_date, booking_number, number, Code1, Code2,
                    debit_amount, credit_amount
           ROWS UNBOUNDED PRECEDING) AS running_balance,
         CASE WHEN debit_amount = 0 AND credit_amount = 0 THEN 'Zero Amount'
              WHEN debit_amount > 0 AND credit_amount > 0 THEN 'Both Debit and Credit'
              WHEN trim(coalesce(description, '')) = '' THEN 'Missing Description'
              ELSE 'Complete' END AS data_quality_flag
  FROM staged
)"""


def _version_cte() -> str:
    parts = [
        f"""
  SELECT '{v.id}' AS version_id, '{v.created:%Y-%m-%d %H:%M:%S}' AS created,
         '{v.source}' AS version_source,
         * REPLACE (CAST(Debet * {v.factor} AS DECIMAL(15,2)) AS Debet,
                    CAST(Credit * {v.factor} AS DECIMAL(15,2)) AS Credit,
                    '{v.created:%Y-%m-%d %H:%M:%S}' AS _loaded_at)
  FROM ledger WHERE year(Boekdatum) BETWEEN {v.first} AND {v.last}"""
        for v in VERSIONS
    ]
    return "\nversions AS (" + "\n  UNION ALL".join(parts) + "\n)"


def _text_cte() -> str:
    """The records with something wrong on most lines."""
    return """
records AS (
  SELECT Boekingsnummer AS booking_number, Nummer AS number, Code1 AS code1, Code2 AS code2,
         CASE Nummer WHEN 1 THEN ' ab-' || CodeGrootboekrekening || ' '
                     WHEN 2 THEN 'a'
                     WHEN 3 THEN repeat(CodeGrootboekrekening, 21)
                     WHEN 4 THEN 'a ' || CodeGrootboekrekening
                     WHEN 5 THEN '' WHEN 6 THEN NULL
                     ELSE 'ACC.' || CodeGrootboekrekening END AS account_code,
         CASE Nummer WHEN 1 THEN strftime(Boekdatum, '%Y-%m-%d')
                     WHEN 2 THEN strftime(Boekdatum, '%d/%m/%Y')
                     WHEN 3 THEN strftime(Boekdatum, '%m/%d/%Y')
                     WHEN 4 THEN strftime(Boekdatum, '%Y-%m-%d') || ' 07:08:09'
                     WHEN 5 THEN '13/13/2020' WHEN 6 THEN '31/12/2020'
                     ELSE '1899-12-31' END AS transaction_date,
         CASE Nummer WHEN 2 THEN NULL
                     WHEN 3 THEN ' <b>"' || Omschrijving || '"</b> & ''more'' '
                     WHEN 4 THEN repeat(Omschrijving, 100)
                     ELSE Omschrijving END AS description,
         CASE Nummer WHEN 1 THEN '€ 1,' || lpad(CAST(amount AS VARCHAR), 12, '0')
                     WHEN 2 THEN '-' || CAST(amount AS VARCHAR)
                     WHEN 3 THEN 'abc' WHEN 4 THEN NULL
                     WHEN 5 THEN '10000000' || lpad(CAST(amount AS VARCHAR), 12, '0')
                     WHEN 6 THEN ' $' || CAST(amount AS VARCHAR) || ' '
                     ELSE CAST(amount AS VARCHAR) END AS debit_amount,
         CASE Nummer WHEN 4 THEN '-1e3' END AS credit_amount,
         lower(replace(NaamGrootboekrekening, '#', ''))
           || CASE Nummer WHEN 1 THEN '@' WHEN 2 THEN ' at ' ELSE '@Mail.' END
           || CASE Nummer WHEN 3 THEN 'c' ELSE 'com ' END AS email
  FROM (SELECT *, coalesce(Debet, Credit) AS amount FROM ledger)
)"""


# What each rule makes of a record, step by step.
_CHECKS = rf"""
prepared AS (
  SELECT *,
         translate(trim(debit_amount), ',$€£¥ _', '') AS debit_text,
         translate(trim(credit_amount), ',$€£¥ _', '') AS credit_text,
         upper(trim(account_code)) AS code_text,
         coalesce(CAST(try_strptime(trim(transaction_date), '%Y-%m-%d') AS DATE),
                  CAST(try_strptime(trim(transaction_date), '%d/%m/%Y') AS DATE),
                  CAST(try_strptime(trim(transaction_date), '%m/%d/%Y') AS DATE),
                  CAST(try_strptime(trim(transaction_date), '%Y-%m-%d %H:%M:%S') AS DATE))
           AS day,
         trim(coalesce(description, '')) AS text,
         lower(trim(email)) AS email_text
  FROM records
),
judged AS (
  SELECT *,
         CASE WHEN debit_amount IS NULL THEN 'Amount cannot be empty'
              WHEN TRY_CAST(debit_text AS DOUBLE) IS NULL
                THEN 'Invalid amount format: ' || debit_amount
              WHEN abs(CAST(debit_text AS DOUBLE)) > 999999999999.99
                THEN 'Amount exceeds maximum allowed value' END AS debit_error,
         CASE WHEN debit_amount IS NULL THEN 'Amount cannot be empty'
              WHEN TRY_CAST(debit_text AS DOUBLE) IS NULL
                THEN 'Invalid amount format: ' || debit_amount
              WHEN CAST(debit_text AS DOUBLE) < 0 THEN 'Negative amounts are not allowed'
              WHEN abs(CAST(debit_text AS DOUBLE)) > 999999999999.99
                THEN 'Amount exceeds maximum allowed value' END AS unsigned_error,
         CASE WHEN account_code IS NULL OR account_code = '' THEN 'Account code cannot be empty'
              WHEN NOT regexp_full_match(code_text, '[A-Z0-9.-]+')
                THEN 'Account code contains invalid characters'
              WHEN length(code_text) NOT BETWEEN 2 AND 20
                THEN 'Account code must be 2-20 characters long' END AS code_error,
         CASE WHEN transaction_date IS NULL OR transaction_date = '' THEN 'Date cannot be empty'
              WHEN day IS NULL THEN 'Invalid date format: ' || transaction_date
              WHEN day < DATE '1900-01-01' THEN 'Date cannot be before 1900-01-01'
              WHEN day > {AS_OF} THEN 'Date cannot be after 2001-11-04' END AS date_error,
         CASE WHEN length(text) < 1 THEN 'Text must be at least 1 characters long'
              WHEN length(text) > 500 THEN 'Text cannot exceed 500 characters' END AS text_error,
         CASE WHEN email IS NULL OR email = '' THEN 'Email cannot be empty'
              WHEN NOT regexp_full_match(
                     email_text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}')
                THEN 'Invalid email format' END AS email_error
  FROM prepared
)"""


def _escaped(value: str) -> str:
    for character, entity in (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;"),
    ):
        value = f"replace({value}, '{character}', '{entity}')"
    return value


_VALIDATED = f"""
validated AS (
  SELECT *, list_filter([
           CASE WHEN account_code IS NULL OR account_code = ''
                THEN 'Missing required field: account_code' END,
           CASE WHEN transaction_date IS NULL OR transaction_date = ''
                THEN 'Missing required field: transaction_date' END,
           CASE WHEN description IS NULL OR description = ''
                THEN 'Missing required field: description' END,
           'Account code: ' || code_error,
           'Transaction date: ' || date_error,
           'Description: ' || text_error,
           CASE WHEN debit_amount IS NOT NULL THEN 'debit_amount: ' || debit_error END,
           CASE WHEN credit_amount IS NOT NULL AND TRY_CAST(credit_text AS DOUBLE) IS NULL
                THEN 'credit_amount: Invalid amount format: ' || credit_amount END,
           CASE WHEN debit_error IS NOT NULL AND credit_amount IS NULL
                THEN 'At least one amount field (debit, credit, or net) must be provided' END
         ], lambda e: e IS NOT NULL) AS errors
  FROM judged
)"""

_ACCOUNT_RECORDS = """
account_records AS (
  SELECT account_code,
         CASE WHEN balance_value_category = 'Low Value' THEN ' ' ELSE account_name END
           AS account_name,
         CASE WHEN activity_status = 'Inactive' THEN 'unknown'
              ELSE CAST(total_debit AS VARCHAR) END AS total_debit
  FROM accounts
),
validated AS (
  SELECT list_filter([
           CASE WHEN length(account_code) < 2
                THEN 'Account code: Account code must be 2-20 characters long' END,
           CASE WHEN trim(account_name) = ''
                THEN 'Account name: Text must be at least 1 characters long' END,
           CASE WHEN total_debit = 'unknown'
                THEN 'total_debit: Invalid amount format: unknown' END
         ], lambda e: e IS NOT NULL) AS errors
  FROM account_records
)"""


def _with(*ctes: str, query: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + query


def on_ledger(query: str) -> str:
    return _with(LEDGER, query=query)


def on_staged(query: str) -> str:
    return _with(LEDGER, STAGED, query=query)


def on_accounts(query: str) -> str:
    return _with(LEDGER, STAGED, BALANCES.format(rows="staged", updated=UPDATED), query=query)


def on_details(query: str) -> str:
    return _with(LEDGER, STAGED, DETAILS, query=query)


def on_marts(query: str) -> str:
    return _with(LEDGER, STAGED, BALANCES.format(rows="staged", updated=UPDATED), DETAILS, query=query)


# Every record of the landed exports. ``good``: it can be stored; ``readable``: it is no broken
# record; ``swapped``: credit stands before debit.
_LANDED = f"""
landed AS (
  SELECT 'DUMP' || year(Boekdatum) || CASE year(Boekdatum)
           WHEN {AS_JSON} THEN '.json' WHEN {AS_PARQUET} THEN '.parquet' ELSE '.csv' END AS file,
         true AS good, true AS readable,
         year(Boekdatum) = {IN_TWO_ORDERS} AND Nummer % 2 = 0 AS swapped, * FROM ledger
  UNION ALL
  SELECT 'more/DUMP{REPEATED}.csv', true, true, true, * FROM ledger WHERE year(Boekdatum) = {REPEATED}
  UNION ALL
  SELECT 'UNDATED.csv', false, true, false, * FROM ledger WHERE year(Boekdatum) = {REPEATED}
  UNION ALL
  SELECT 'BROKEN.json', Nummer <> 1, Nummer <> 1, false, * FROM ledger
  WHERE year(Boekdatum) = {REPEATED}
),
landed_files AS (
  SELECT file, file = 'DUMP{WITHOUT_CORE}.csv' AS refused, count(*) AS n,
         count(*) FILTER (WHERE good) AS stored
  FROM landed GROUP BY file
)"""
_NO_CORE, _NO_OPTIONAL = f"DUMP{WITHOUT_CORE}.csv", f"DUMP{WITHOUT_OPTIONAL}.csv"


def on_landed(query: str) -> str:
    return _with(LEDGER, _LANDED, query=query)


def on_versions(query: str) -> str:
    return _with(LEDGER, _version_cte(), query=query)


def on_records(query: str) -> str:
    return _with(LEDGER, _text_cte(), _CHECKS, query=query)


def on_validated(query: str) -> str:
    return _with(LEDGER, _text_cte(), _CHECKS, _VALIDATED, query=query)


def money(*names: str) -> str:
    return ", ".join(f"CAST({name} AS DOUBLE) AS {name}" for name in names)


def text(*names: str) -> str:
    return ", ".join(f"CAST({name} AS VARCHAR) AS {name}" for name in names)


STAGED_MONEY = money("debit_amount", "credit_amount", "balance_amount", "vat_amount", "net_amount")

SHOWN_ACCOUNT = (
    "account_code, account_name, total_transactions, "
    + money("total_debit", "total_credit", "net_balance", "total_vat", "net_amount_last_12_months")
    + ", transactions_last_12_months, "
    + text("first_transaction_date", "last_transaction_date")
    + ", years_active, account_balance_type, activity_status, transaction_volume_category, "
    "balance_value_category, last_updated"
)
SHOWN_TRANSACTION = (
    "transaction_id, account_code, account_name, "
    + text("transaction_date")
    + ", booking_number, description, "
    + STAGED_MONEY
    + ", transaction_type, transaction_year, transaction_quarter, transaction_month, "
    "amount_category, recency_category, "
    + money("running_balance")
    + ", data_quality_flag, source_file"
)
SHOWN_FILTERED = (
    "transaction_id, account_code, account_name, "
    + text("transaction_date")
    + ", booking_number, description, "
    + money("debit_amount", "credit_amount", "net_amount")
    + ", transaction_type, amount_category, recency_category, source_file"
)
STORED = (
    "CodeGrootboekrekening, "
    + text("Boekdatum")
    + ", Boekingsnummer, Nummer, Code1, Code2, "
    + money("Debet", "Credit")
    + ", _loaded_at"
)

BY_BALANCE = "abs(net_balance) DESC, account_code, account_name"
NEWEST = (
    "transaction_date DESC NULLS LAST, booking_number DESC NULLS LAST, number, Code1, Code2, "
    "debit_amount, credit_amount"
)
FILTERS = (
    "transaction_year IN (1997, 1998) AND transaction_quarter IN (1, 2) "
    "AND amount_category IN ('Large', 'Medium')"
)
PERIOD = "transaction_year IN (1999) AND transaction_month IN (1, 2, 3)"
SOURCES = "source_file IN ('DUMP1997.xlsx', 'DUMP1999.xlsx')"

# Selections that name no year, quarter or month.
ONE_CONDITION = {
    "account": "account_code IN ('42', '7', '103')",
    "category": "amount_category IN ('Large')",
    "dates": "transaction_date BETWEEN DATE '1998-03-01' AND DATE '1999-02-28'",
    "search": "contains(lower(description), 'line 3')",
}

STATS = """count(*) AS total_transactions, count(DISTINCT account_code) AS unique_accounts,
  CAST(sum(debit_amount) AS DOUBLE) AS total_debit,
  CAST(sum(credit_amount) AS DOUBLE) AS total_credit,
  CAST(sum(net_amount) AS DOUBLE) AS net_total"""
STATS_RANGE = """CAST(min(transaction_date) AS VARCHAR) AS earliest_date,
  CAST(max(transaction_date) AS VARCHAR) AS latest_date,
  count(DISTINCT source_file) AS source_files"""
ASSETS = """
  CAST(coalesce(sum(CASE WHEN net_balance > 0 THEN net_balance END), 0) AS DOUBLE) AS total_assets,
  CAST(coalesce(sum(CASE WHEN net_balance < 0 THEN -net_balance END), 0) AS DOUBLE)
    AS total_liabilities"""

ROLLUP = f"""(
  SELECT account_code, account_name, count(*) AS total_transactions,
         sum(debit_amount) AS total_debit, sum(credit_amount) AS total_credit,
         sum(net_amount) AS net_balance,
         CASE WHEN sum(net_amount) > 0 THEN 'Net Debit' ELSE 'Net Credit' END
           AS account_balance_type,
         'Active' AS activity_status
  FROM details WHERE {PERIOD} GROUP BY account_code, account_name)"""
SHOWN_ROLLUP = (
    "account_code, account_name, total_transactions, "
    + money("total_debit", "total_credit", "net_balance")
    + ", account_balance_type, activity_status"
)


def not_null_test(model: str, table: str, name: str) -> str:
    return (
        f"SELECT '{model}' AS model, '{name}' AS column_name, 'not_null' AS test, "
        f"count(*) FILTER (WHERE {name} IS NULL) AS failures, "
        f"count(*) FILTER (WHERE {name} IS NULL) = 0 AS passed FROM {table}"
    )


def unique_test(model: str, table: str, name: str) -> str:
    return (
        f"SELECT '{model}' AS model, '{name}' AS column_name, 'unique' AS test, "
        f"count(*) AS failures, count(*) = 0 AS passed FROM (SELECT {name} FROM {table} "
        f"WHERE {name} IS NOT NULL GROUP BY {name} HAVING count(*) > 1)"
    )


def union(*selects: str) -> str:
    return "\nUNION ALL\n".join(selects)


def version_rows(version_id: str) -> str:
    return on_versions(f"SELECT {STORED} FROM versions WHERE version_id = '{version_id}'")


FIRST, SECOND, THIRD = VERSIONS

SUMMARY = """SELECT count(*) AS total_records,
  count(*) FILTER (WHERE len(errors) = 0) AS valid_records,
  count(*) FILTER (WHERE len(errors) > 0) AS invalid_records,
  CAST(sum(len(errors)) AS BIGINT) AS total_errors,
  CAST(count(*) FILTER (WHERE len(errors) = 0) AS DOUBLE) / count(*) AS validation_rate
FROM validated"""
ERRORS = """SELECT error, count(*) AS records
FROM (SELECT unnest(errors) AS error FROM validated) GROUP BY error"""
LINE = "booking_number, number, code1, code2"

# The account mart's columns, their types when saved and as declared.
_ACCOUNT_TYPES = [
    ("account_code", "string", "string", "VARCHAR"),
    ("account_name", "string", "string", "VARCHAR"),
    ("total_transactions", "bigint", "bigint", "BIGINT"),
    *[
        (name, "decimal(28,2)", "double", "DOUBLE")
        for name in ("total_debit", "total_credit", "net_balance", "total_vat")
    ],
    ("net_amount_last_12_months", "decimal(28,2)", "double", "DOUBLE"),
    ("transactions_last_12_months", "bigint", "bigint", "BIGINT"),
    ("first_transaction_date", "date", "date", "DATE"),
    ("last_transaction_date", "date", "date", "DATE"),
    ("years_active", "bigint", "bigint", "BIGINT"),
    ("account_balance_type", "string", "string", "VARCHAR"),
    ("activity_status", "string", "string", "VARCHAR"),
    ("transaction_volume_category", "string", "string", "VARCHAR"),
    ("balance_value_category", "string", "string", "VARCHAR"),
    ("last_updated", "timestamp_ntz", "timestamp_ntz", "TIMESTAMP"),
]

_LEDGER_COLUMNS = (
    "Boekdatum, Boekingsnummer, Boekingsstatus, Btwbedrag, Btwcode, Code, Code1, Code2, "
    "CodeAdministratie, CodeGrootboekrekening, Credit, Debet, Factuurnummer, NaamAdministratie, "
    "NaamGrootboekrekening, Nummer, Omschrijving, Periode, Saldo, _data_version, _loaded_at, "
    "_source_file"
)

_MODELS = """models AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE o_orderstatus WHEN 'F' THEN 'staging' WHEN 'O' THEN 'intermediate' ELSE 'mart' END
           AS type,
         CASE o_orderstatus WHEN 'F' THEN 'staging/' WHEN 'O' THEN 'intermediate/'
                            ELSE 'marts/' END AS folder,
         'order_' || o_orderkey AS name
  FROM orders WHERE o_orderpriority <> '5-LOW'
)"""

_RUN_LOG = """finished AS (
  SELECT event_id,
         CASE event_type WHEN 'click' THEN 'dbt debug' WHEN 'view' THEN 'dbt run --select marts'
                         WHEN 'signup' THEN 'dbt seed' ELSE 'dbt run' END AS command,
         strftime(ts, '%H:%M:%S') AS "at",
         CASE WHEN value > 50 THEN 'error' ELSE 'success' END AS status
  FROM events WHERE event_type <> 'error'
), scopes AS (
  SELECT unnest(['last', 'debug', 'run', 'test']) AS scope
), ranked AS (
  SELECT scope, command, "at", status,
         row_number() OVER (PARTITION BY scope ORDER BY event_id DESC) AS n
  FROM scopes JOIN finished
    ON scope = 'last' OR starts_with(command, 'dbt ' || scope)
)"""

ORACLES: dict[str, str] = {
    "staged_ledger": on_staged(
        f"SELECT * REPLACE ({STAGED_MONEY}, {text('transaction_date')}) FROM staged"
    ),
    "int_account_balances": on_accounts(
        "SELECT * REPLACE ("
        + money("total_debit", "total_credit", "net_balance", "total_vat",
                "net_amount_12m", "net_amount_4q")
        + ", " + text("first_transaction_date", "last_transaction_date") + ") FROM balances"
    ),
    "mart_account_summary": on_accounts(
        "SELECT * REPLACE (CAST(NULL AS VARCHAR) AS last_updated, "
        + money("total_debit", "total_credit", "net_balance", "total_vat",
                "net_amount_last_12_months", "net_amount_last_4_quarters")
        + ", " + text("first_transaction_date", "last_transaction_date") + ") FROM accounts"
    ),
    "mart_transaction_details": on_details(
        f"SELECT * REPLACE ({STAGED_MONEY}, {money('running_balance')}, "
        f"{text('transaction_date')}) FROM details"
    ),
    "top_accounts": on_accounts(
        f"SELECT account_code, account_name, {money('net_balance')}, account_balance_type, "
        "activity_status FROM (SELECT * FROM accounts "
        f"ORDER BY {BY_BALANCE} LIMIT 10)"
    ),
    "account_summary_page": on_accounts(
        f"SELECT {SHOWN_ACCOUNT}, (SELECT count(*) FROM accounts) AS total_count "
        f"FROM (SELECT * FROM accounts ORDER BY {BY_BALANCE} LIMIT 20 OFFSET 20)"
    ),
    "transaction_page": on_details(
        f"SELECT {SHOWN_TRANSACTION}, (SELECT count(*) FROM details) AS total_count "
        f"FROM (SELECT * FROM details ORDER BY {NEWEST} LIMIT 100 OFFSET 500)"
    ),
    "transaction_page_deep": on_details(
        f"SELECT transaction_id, {text('transaction_date')}, booking_number, number, Code1, Code2, "
        f"{money('debit_amount', 'credit_amount')} "
        f"FROM (SELECT * FROM details ORDER BY {NEWEST} LIMIT 50 OFFSET 3000)"
    ),
    "activity_breakdown": on_accounts(
        "SELECT activity_status, count(*) AS account_count, "
        "CAST(sum(net_balance) AS DOUBLE) AS total_balance, "
        "CAST(sum(net_balance) AS DOUBLE) / count(net_balance) AS avg_balance "
        "FROM accounts GROUP BY activity_status"
    ),
    "transaction_stats": on_details(f"SELECT {STATS}, {STATS_RANGE} FROM details"),
    "dashboard_stats": on_marts(
        f"SELECT * FROM (SELECT count(*) AS total_accounts, "
        f"count(*) FILTER (WHERE activity_status = 'Active') AS active_accounts, {ASSETS} "
        f"FROM accounts), (SELECT {STATS}, {STATS_RANGE} FROM details)"
    ),
    "monthly_trends": on_details(
        f"""SELECT transaction_year, transaction_month, count(*) AS transaction_count,
  CAST(sum(debit_amount) AS DOUBLE) AS total_debit,
  CAST(sum(credit_amount) AS DOUBLE) AS total_credit,
  CAST(sum(net_amount) AS DOUBLE) AS net_amount,
  transaction_year || '-' || lpad(CAST(transaction_month AS VARCHAR), 2, '0') AS period
FROM details WHERE transaction_date >= {AS_OF} - 12 * 30
GROUP BY transaction_year, transaction_month
ORDER BY transaction_year DESC, transaction_month DESC LIMIT 12"""
    ),
    "filtered_transactions": on_details(f"SELECT {SHOWN_FILTERED} FROM details WHERE {FILTERS}"),
    "source_filtered_transactions": on_details(
        f"SELECT {SHOWN_FILTERED} FROM details WHERE {SOURCES}"
    ),
    "source_filtered_accounts": _with(
        LEDGER, STAGED, f"\nchosen AS (SELECT * FROM staged WHERE {SOURCES})",
        BALANCES.format(rows="chosen", updated="NULL"), query=f"SELECT {SHOWN_ACCOUNT} FROM accounts",
    ),
    "row_source_filter": on_details(
        f"SELECT transaction_id, source_file FROM details WHERE {SOURCES}"
    ),
    "high_value_transactions": on_marts(
        f"SELECT transaction_id, account_code, {money('net_amount')} FROM details "
        "WHERE account_code IN (SELECT account_code FROM accounts "
        "WHERE balance_value_category = 'High Value')"
    ),
    "date_range_search": on_details(
        f"SELECT transaction_id, {text('transaction_date')}, description, {money('net_amount')} "
        "FROM details WHERE transaction_date BETWEEN DATE '1998-03-01' AND DATE '1999-02-28' "
        "AND contains(lower(description), 'line 3')"
    ),
    "filtered_account_rollup": on_details(f"SELECT {SHOWN_ROLLUP} FROM {ROLLUP}"),
    "filtered_stats": on_details(
        f"""SELECT count(*) AS total_accounts, count(*) AS active_accounts, {ASSETS},
  CAST(sum(n) AS BIGINT) AS total_transactions, count(*) AS unique_accounts,
  CAST(sum(debit) AS DOUBLE) AS total_debit, CAST(sum(credit) AS DOUBLE) AS total_credit,
  CAST(sum(net_balance) AS DOUBLE) AS net_total
FROM (SELECT account_code, count(*) AS n, sum(debit_amount) AS debit,
             sum(credit_amount) AS credit, sum(net_amount) AS net_balance
      FROM details WHERE {PERIOD} GROUP BY account_code)"""
    ),
    "filtered_accounts_page": on_details(
        f"SELECT {SHOWN_ROLLUP}, total_count FROM (SELECT *, count(*) OVER () AS total_count "
        f"FROM {ROLLUP} ORDER BY account_code, account_name LIMIT 20 OFFSET 40)"
    ),
    "filtered_transactions_page": on_details(
        f"SELECT {SHOWN_FILTERED}, total_count FROM (SELECT *, count(*) OVER () AS total_count "
        f"FROM details WHERE {PERIOD} ORDER BY {NEWEST} LIMIT 15 OFFSET 30)"
    ),
    "sorted_accounts": on_accounts(f"SELECT {SHOWN_ACCOUNT} FROM accounts"),
    "sorted_limited_transactions": on_details(
        f"SELECT {SHOWN_TRANSACTION} FROM (SELECT * FROM details ORDER BY {NEWEST} LIMIT 20)"
    ),
    "accounts_slice": on_accounts(
        f"SELECT {SHOWN_ACCOUNT}, (SELECT count(*) FROM accounts) AS total_count "
        "FROM (SELECT * FROM accounts ORDER BY account_code, account_name LIMIT 20 OFFSET 40)"
    ),
    "transactions_slice": on_details(
        f"SELECT {SHOWN_TRANSACTION}, total_count FROM (SELECT *, count(*) OVER () AS total_count "
        "FROM details ORDER BY account_code, transaction_date, booking_number DESC NULLS LAST, "
        "number, Code1, Code2, debit_amount, credit_amount LIMIT 15 OFFSET 1500)"
    ),
    **{
        f"stats_by_{name}": on_details(
            f"""SELECT count(*) AS total_accounts, count(*) AS active_accounts, {ASSETS},
  CAST(sum(n) AS BIGINT) AS total_transactions, count(*) AS unique_accounts,
  CAST(sum(debit) AS DOUBLE) AS total_debit, CAST(sum(credit) AS DOUBLE) AS total_credit,
  CAST(sum(net_balance) AS DOUBLE) AS net_total
FROM (SELECT account_code, count(*) AS n, sum(debit_amount) AS debit,
             sum(credit_amount) AS credit, sum(net_amount) AS net_balance
      FROM details WHERE {condition} GROUP BY account_code)"""
        )
        for name, condition in ONE_CONDITION.items()
    },
    **{
        f"page_by_{name}": on_details(
            f"SELECT {SHOWN_FILTERED}, total_count FROM (SELECT *, count(*) OVER () AS total_count "
            f"FROM details WHERE {condition} ORDER BY {NEWEST} LIMIT 15 OFFSET 3)"
        )
        for name, condition in ONE_CONDITION.items()
    },
    "stats_of_all": on_marts(
        f"SELECT * FROM (SELECT count(*) AS total_accounts, "
        f"count(*) FILTER (WHERE activity_status = 'Active') AS active_accounts, {ASSETS} "
        f"FROM accounts), (SELECT {STATS} FROM details)"
    ),
    "sorted_by_account": on_details(
        f"""SELECT {SHOWN_ROLLUP} FROM (
  SELECT account_code, account_name, count(*) AS total_transactions,
         sum(debit_amount) AS total_debit, sum(credit_amount) AS total_credit,
         sum(net_amount) AS net_balance,
         if(sum(net_amount) > 0, 'Net Debit', 'Net Credit') AS account_balance_type,
         'Active' AS activity_status
  FROM details WHERE {ONE_CONDITION["account"]} GROUP BY account_code, account_name)"""
    ),
    "limited_by_search": on_details(
        f"SELECT {SHOWN_FILTERED} FROM (SELECT * FROM details WHERE {ONE_CONDITION['search']} "
        f"ORDER BY {NEWEST} LIMIT 20)"
    ),
    "mart_counts": on_marts(
        "SELECT 'mart_account_summary' AS mart, count(*) AS count FROM accounts UNION ALL "
        "SELECT 'mart_transaction_details', count(*) FROM details"
    ),
    "last_refresh": on_accounts(
        f"SELECT max('{LOADED_AT}') AS last_updated FROM accounts"
    ),
    "daily_volume": on_details(
        f"SELECT {text('transaction_date')}, CAST(volume AS DOUBLE) AS volume FROM "
        "(SELECT transaction_date, sum(abs(net_amount)) AS volume FROM details "
        "GROUP BY transaction_date ORDER BY transaction_date LIMIT 10)"
    ),
    "type_distribution": on_accounts(
        "SELECT coalesce(account_balance_type, 'Other') AS account_type, "
        "count(*) AS account_count FROM accounts GROUP BY 1"
    ),
    "amount_histogram": on_details(
        union(
            *[
                f"SELECT '{label}' AS amount_range, count(*) AS n FROM details WHERE {condition}"
                for label, condition in (
                    ("0-100", "abs(net_amount) >= 0 AND abs(net_amount) < 100"),
                    ("100-500", "abs(net_amount) >= 100 AND abs(net_amount) < 500"),
                    ("500-1000", "abs(net_amount) >= 500 AND abs(net_amount) < 1000"),
                    ("1000+", "abs(net_amount) >= 1000"),
                )
            ]
        )
    ),
    "balance_chart": on_accounts(
        f"SELECT account_code, {money('net_balance')} FROM (SELECT * FROM accounts "
        "ORDER BY account_code, account_name LIMIT 10)"
    ),
    "version_list": on_versions(
        "SELECT version_id AS file, created FROM versions GROUP BY version_id, created"
    ),
    "manifest": on_versions(
        "SELECT version_id AS snapshot_id, replace(created, ' ', 'T') AS timestamp, "
        "version_source AS source_file, version_id || '.parquet' AS parquet_file, "
        "count(*) AS records_count, 'append' AS operation FROM versions GROUP BY ALL"
    ),
    "version_label": on_versions(
        "SELECT 'v20020224_000000' AS label, count(*) AS records FROM versions"
    ),
    "version_read": version_rows(FIRST.id),
    "latest_version": version_rows(THIRD.id),
    "as_of_timestamp": version_rows(SECOND.id),
    "as_of_date": version_rows(FIRST.id),
    "as_of_batch": (
        "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, CASE "
        + " ".join(
            f"WHEN o_orderdate >= TIMESTAMP '{v.created}' THEN '{v.id}'" for v in VERSIONS[::-1]
        )
        + " END AS version_id FROM orders"
    ),
    "compare_versions": on_versions(
        f"""SELECT '{FIRST.id}' AS version1, '{SECOND.id}' AS version2, a.n AS rows1, b.n AS rows2,
  CAST(22 AS BIGINT) AS columns1, CAST(22 AS BIGINT) AS columns2, b.n - a.n AS row_change,
  '' AS new_columns, '' AS removed_columns, '{_LEDGER_COLUMNS}' AS common_columns,
  a.first_day AS min_date1, a.last_day AS max_date1,
  b.first_day AS min_date2, b.last_day AS max_date2
FROM (SELECT count(*) AS n, CAST(min(Boekdatum) AS VARCHAR) AS first_day,
             CAST(max(Boekdatum) AS VARCHAR) AS last_day
      FROM versions WHERE version_id = '{FIRST.id}') a,
     (SELECT count(*) AS n, CAST(min(Boekdatum) AS VARCHAR) AS first_day,
             CAST(max(Boekdatum) AS VARCHAR) AS last_day
      FROM versions WHERE version_id = '{SECOND.id}') b"""
    ),
    "changes_since": on_versions(
        "SELECT version_id AS file, created, count(*) AS rows, "
        "CAST(min(Boekdatum) AS VARCHAR) AS min_date, CAST(max(Boekdatum) AS VARCHAR) AS max_date "
        f"FROM versions WHERE created > '{FIRST.created}' GROUP BY version_id, created"
    ),
    "consolidated": on_versions(
        f"""SELECT version_id, {STORED} FROM (
  SELECT *, row_number() OVER (
    PARTITION BY CodeGrootboekrekening, Boekdatum, Boekingsnummer
    ORDER BY _loaded_at DESC NULLS FIRST, Nummer, Code1, Code2, Debet NULLS LAST,
             Credit NULLS LAST) AS n
  FROM versions) WHERE n = 1"""
    ),
    "relaxed_union": on_ledger(
        "SELECT CodeGrootboekrekening, Boekingsnummer, CAST(Nummer AS VARCHAR) AS Nummer, "
        "CAST(Debet AS DOUBLE) AS Debet FROM ledger"
    ),
    "audit_trail": on_versions(
        f"SELECT version_id AS _version_file, created AS _version_created, {STORED} FROM versions "
        "WHERE CodeGrootboekrekening = '42' "
        "AND Boekdatum BETWEEN DATE '1997-01-01' AND DATE '2000-12-31'"
    ),
    "audit_versions": on_versions(
        "SELECT DISTINCT version_id AS _version_file FROM versions "
        "WHERE Boekdatum BETWEEN DATE '1999-01-01' AND DATE '1999-06-30'"
    ),
    "new_files": on_ledger(
        "SELECT DISTINCT _source_file AS name FROM ledger WHERE _source_file NOT IN "
        "(SELECT _source_file FROM ledger WHERE year(Boekdatum) <= 1999)"
    ),
    "permissive_cast": on_ledger(
        f"""SELECT * REPLACE (
  CASE WHEN Nummer NOT IN (1, 2) THEN CAST(Debet AS DOUBLE) END AS Debet,
  {money('Credit', 'Saldo', 'Btwbedrag')},
  CASE WHEN Nummer <> 4 THEN Boekingsnummer END AS Boekingsnummer,
  {text('Boekdatum')}, CAST(NULL AS VARCHAR) AS Factuurnummer,
  '{LOADED_AT}' AS _loaded_at, CAST({LOADED_EPOCH} AS BIGINT) AS _data_version)
FROM ledger WHERE Nummer NOT IN (5, 6)"""
    ),
    "migrate": on_ledger(
        f"""SELECT * REPLACE ({money('Debet', 'Credit', 'Saldo', 'Btwbedrag')}, {text('Boekdatum')},
  '{LOADED_AT}' AS _loaded_at, 'migration_from_existing_db' AS _source_file,
  CAST(1 AS BIGINT) AS _data_version) FROM ledger"""
    ),
    "raw_load": on_ledger(
        f"SELECT CodeGrootboekrekening, {text('Boekdatum')}, Boekingsnummer, "
        f"{money('Debet', 'Credit')}, '{LOADED_AT}' AS _loaded_at, 'manual.csv' AS _source_file, "
        f"CAST({LOADED_EPOCH} AS BIGINT) AS _data_version FROM ledger"
    ),
    "conformance_report": on_landed(
        f"""SELECT DISTINCT file,
  CASE file WHEN '{_NO_OPTIONAL}' THEN 'Btwcode' WHEN '{_NO_CORE}' THEN 'Credit' ELSE '' END
    AS missing,
  if(file = '{_NO_OPTIONAL}', 'Opmerking', '') AS extra, file <> '{_NO_CORE}' AS accepted
FROM landed"""
    ),
    "ingest_status": on_landed(
        f"""SELECT file, if(refused OR stored = 0, 'failed', 'processed') AS status,
  if(refused, NULL, stored) AS row_count, if(refused, NULL, n - stored) AS rejected,
  if(refused, 'Schema validation failed',
     if(stored = 0, 'No valid rows after cleaning', 'Ingested')) AS message
FROM landed_files"""
    ),
    "quarantined": on_ledger(
        """SELECT file, reason, count(*) AS records, sum(length(text))::BIGINT AS characters, min(text) AS first_text
FROM (
  SELECT 'FAULTY.CSV' AS file, if(Nummer = 4, 'No valid date', 'Wrong number of fields') AS reason,
    CASE Nummer
      WHEN 1 THEN CodeGrootboekrekening || ',' || Boekdatum || ',1,5,' || coalesce(Credit::VARCHAR, '') || ','
        || Omschrijving || ',' || Boekingsnummer || ',1'
      WHEN 2 THEN CodeGrootboekrekening || ',' || Boekdatum || ',' || coalesce(Debet::VARCHAR, '') END AS text
  FROM ledger WHERE Nummer IN (1, 2, 4)
  UNION ALL
  SELECT 'RECORDS.JSON', 'Not a record', 'no record of ' || Boekingsnummer FROM ledger WHERE Nummer = 1
) GROUP BY file, reason"""
    ),
    "faulty_exports": on_ledger(
        f"""SELECT file, 'processed' AS status, count(*) FILTER (good) AS row_count,
  count(*) FILTER (NOT good) AS rejected, {money("debit")}, sum(length(text) * good::INT)::BIGINT AS characters
FROM (
  SELECT 'FAULTY.CSV' AS file, Nummer NOT IN (1, 2, 4) AS good, Debet,
    if(Nummer = 3, 'line' || chr(10) || '3, more', Omschrijving) AS text FROM ledger
  UNION ALL SELECT 'RECORDS.JSON', Nummer > 1, Debet, Omschrijving FROM ledger
  UNION ALL SELECT 'DOUBLE.parquet', true, Debet, Omschrijving FROM ledger
  UNION ALL SELECT 'MIXED.parquet', true, Debet, Omschrijving FROM ledger
)
JOIN (
  SELECT file AS of_file, sum(Debet) AS debit FROM (
    SELECT 'FAULTY.CSV' AS file, Debet FROM ledger WHERE Nummer NOT IN (1, 2, 4)
    UNION ALL SELECT 'RECORDS.JSON', Debet FROM ledger WHERE Nummer > 1
    UNION ALL SELECT unnest(['DOUBLE.parquet', 'MIXED.parquet']), Debet FROM ledger
  ) GROUP BY file
) ON file = of_file GROUP BY file, debit
UNION ALL SELECT 'DAMAGED.parquet', 'failed', NULL, NULL, NULL, NULL"""
    ),
    "late_parts": on_ledger(
        f"""SELECT 'LATE.csv' AS source_file, CAST(3 AS BIGINT) AS versions, count(*) AS row_count,
  {money("total_debit")} FROM ledger, (SELECT sum(Debet) AS total_debit FROM ledger) GROUP BY total_debit"""
    ),
    "ingest_counts": on_landed(
        """SELECT CAST(0 AS BIGINT) AS processed,
  count(*) FILTER (WHERE NOT refused AND stored > 0) AS skipped,
  count(*) FILTER (WHERE refused OR stored = 0) AS failed
FROM landed_files"""
    ),
    "incremental_ingest": on_landed(
        f"""SELECT file AS source_file, count(*) AS row_count,
  CAST(sum(Debet) AS DOUBLE) AS total_debit, CAST(sum(Credit) AS DOUBLE) AS total_credit
FROM landed WHERE good AND file <> '{_NO_CORE}' GROUP BY file"""
    ),
    "landed_extras": on_landed(
        f"""SELECT Boekingsnummer, Nummer, Code1, Code2, {money("Debet", "Credit")},
  'n.v.t.' AS Opmerking FROM landed WHERE file = '{_NO_OPTIONAL}'"""
    ),
    "compare_landed": on_landed(
        f"""SELECT sum((file = 'DUMP1997.csv')::INT)::BIGINT AS rows1,
  sum((file = '{_NO_OPTIONAL}')::INT)::BIGINT AS rows2,
  CAST(22 AS BIGINT) AS columns1, CAST(23 AS BIGINT) AS columns2,
  'Opmerking' AS new_columns, '' AS removed_columns FROM landed"""
    ),
    "declared_table": on_landed(
        f"SELECT count(*) AS n_rows, {money('debit')} FROM (SELECT sum(Debet) AS debit, 1 AS x "
        f"FROM landed WHERE good AND file <> '{_NO_CORE}'), "
        f"(SELECT * FROM landed WHERE good AND file <> '{_NO_CORE}') GROUP BY debit"
    ),
    "export_parquet": on_ledger(
        f"SELECT CodeGrootboekrekening, {text('Boekdatum')}, Boekingsnummer, Nummer, "
        f"{money('Debet', 'Credit')} FROM ledger"
    ),
    "refresh_steps": on_landed(
        """SELECT unnest(['check_files', 'ingest_files', 'rebuild_models', 'data_tests']) AS step,
  unnest([true, failed = 0, true, true]) AS success,
  unnest(['Found ' || n || ' new files to process',
          (n - failed) || ' processed, ' || failed || ' failed',
          'Models rebuilt', 'Data quality tests completed']) AS message
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE refused OR stored = 0) AS failed
      FROM landed_files)"""
    ),
    "strict_schema": on_accounts(
        union(
            *[
                f"""SELECT '{name}' AS column_name, '{found}' AS found, '{wanted}' AS expected,
  {str(found == wanted).lower()} AS matches,
  count(*) FILTER (WHERE {name} IS NOT NULL AND TRY_CAST({name} AS {sql}) IS NULL) AS lost_values
FROM accounts"""
                for name, found, wanted, sql in _ACCOUNT_TYPES
            ]
        )
    ),
    "ingestion_log_rows": union(
        *[
            f"""SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS logged_at,
  '{name}' || o_orderkey || '.xlsx' AS source_file,
  '{name}' || o_orderkey || '.parquet' AS output_file, {rows} AS row_count FROM orders"""
            for name, rows in (("order", "o_custkey"), ("copy", "o_orderkey"))
        ]
    ),
    "file_inventory": on_landed(
        f"""SELECT file AS filename, CAST(if(file = '{_NO_CORE}', 18, 19) AS BIGINT) AS n_columns,
  count(*) AS n_rows,
  -- The twelfth column: where debit and credit are swapped, the credit.
  CAST(sum(if(readable, coalesce(if(swapped, Credit, Debet), 0), 0)) AS DOUBLE) AS total_debit,
  CAST(if(file = '{_NO_CORE}', 0, sum(if(readable, coalesce(Credit, 0), 0))) AS DOUBLE)
    AS total_credit,
  'Processed' AS status, 'File System Scan' AS source
FROM landed GROUP BY file"""
    ),
    "not_null_tests": _with(
        LEDGER, _text_cte(),
        query=union(
            *[
                not_null_test("dirty_transactions", "records", name)
                for name in (
                    "booking_number", "number", "code1", "code2", "account_code",
                    "transaction_date", "description", "debit_amount", "credit_amount", "email",
                )
            ]
        ),
    ),
    "unique_tests": on_details(
        union(
            unique_test("mart_transaction_details", "details", "transaction_id"),
            unique_test("mart_transaction_details", "details", "booking_number"),
        )
    ),
    "test_results": on_marts(
        union(
            not_null_test("stg_financial_transactions", "staged", "account_code"),
            not_null_test("stg_financial_transactions", "staged", "transaction_date"),
            not_null_test("int_account_balances", "balances", "account_code"),
            unique_test("int_account_balances", "balances", "account_code"),
            not_null_test("mart_account_summary", "accounts", "account_code"),
            unique_test("mart_account_summary", "accounts", "account_code"),
            not_null_test("mart_transaction_details", "details", "transaction_id"),
            unique_test("mart_transaction_details", "details", "transaction_id"),
            not_null_test("mart_transaction_details", "details", "account_code"),
            not_null_test("mart_transaction_details", "details", "transaction_date"),
        )
    ),
    "lenient_schema": on_details(
        f"""SELECT transaction_id, CAST(booking_number AS VARCHAR) AS booking_number,
  CASE WHEN number <> 1 THEN CAST(net_amount AS DOUBLE) END AS net_amount,
  {money('debit_amount')}, amount_category, vat_code,
  CASE WHEN number = 2 THEN '-' ELSE CAST(net_amount AS VARCHAR) END AS vat_reported
FROM details"""
    ),
    "standardize_numeric": on_details(
        f"""SELECT transaction_id, booking_number,
  CASE WHEN number <> 1 THEN CAST(net_amount AS DOUBLE) END AS net_amount,
  {money('debit_amount')}, amount_category, vat_code,
  CASE WHEN number <> 2 THEN CAST(net_amount AS DOUBLE) END AS vat_reported
FROM details"""
    ),
    "validate_amounts": on_records(
        f"SELECT {LINE}, CASE WHEN debit_error IS NULL THEN CAST(debit_text AS DOUBLE) END AS value, "
        "debit_error AS error, unsigned_error FROM judged"
    ),
    "validate_codes": on_records(
        f"SELECT {LINE}, CASE WHEN code_error IS NULL THEN code_text END AS value, "
        "code_error AS error FROM judged"
    ),
    "validate_dates": on_records(
        f"SELECT {LINE}, CASE WHEN date_error IS NULL THEN CAST(day AS VARCHAR) END AS value, "
        "date_error AS error FROM judged"
    ),
    "validate_text": on_records(
        f"SELECT {LINE}, CASE WHEN text_error IS NULL THEN {_escaped('text')} END AS value, "
        "text_error AS error FROM judged"
    ),
    "validate_html_text": on_records(
        f"SELECT {LINE}, CASE WHEN length(text) <= 500 THEN translate(text, '<>\"''', '') END "
        "AS value, CASE WHEN length(text) > 500 THEN 'Text cannot exceed 500 characters' END "
        "AS error FROM judged"
    ),
    "validate_documents": (
        "WITH trimmed AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text "
        f"FROM documents) SELECT doc_id, "
        f"CASE WHEN length(text) BETWEEN 1 AND 1000 THEN {_escaped('text')} END AS value, "
        "CASE WHEN length(text) < 1 THEN 'Text must be at least 1 characters long' "
        "WHEN length(text) > 1000 THEN 'Text cannot exceed 1000 characters' END AS error "
        "FROM trimmed"
    ),
    "validate_emails": on_records(
        f"SELECT {LINE}, CASE WHEN email_error IS NULL THEN email_text END AS value, "
        "email_error AS error FROM judged"
    ),
    "validate_transactions": on_validated(SUMMARY),
    "valid_transactions": on_validated(
        f"SELECT {LINE}, code_text AS account_code, CAST(day AS VARCHAR) AS transaction_date, "
        f"{_escaped('text')} AS description, CAST(debit_text AS DOUBLE) AS debit_amount, "
        "CAST(credit_text AS DOUBLE) AS credit_amount, email FROM validated WHERE len(errors) = 0"
    ),
    "error_counts": on_validated(ERRORS),
    "validate_accounts": _with(
        LEDGER, STAGED, BALANCES.format(rows="staged", updated=UPDATED), _ACCOUNT_RECORDS, query=SUMMARY
    ),
    "account_errors": _with(
        LEDGER, STAGED, BALANCES.format(rows="staged", updated=UPDATED), _ACCOUNT_RECORDS, query=ERRORS
    ),
    "validation_report": on_validated(
        f"SELECT {LINE}, array_to_string(errors, ', ') AS errors, "
        "greatest(0, (SELECT count(*) FROM validated WHERE len(errors) > 0) - 10) AS more_invalid "
        f"FROM (SELECT * FROM validated WHERE len(errors) > 0 ORDER BY {LINE}, "
        "debit_amount NULLS LAST, description NULLS LAST LIMIT 10)"
    ),
    "sanitize_display": (
        f"SELECT doc_id, coalesce({_escaped('text')}, '') AS display FROM documents"
    ),
    "lineage_edges": "WITH " + _MODELS + union(
        " SELECT name, type, 'customer_' || o_custkey AS upstream, 'ref' AS kind FROM models",
        "SELECT name, type, 'calendar', 'ref' FROM models",
        "SELECT name, type, 'sales.lines_' || o_orderkey, 'source' FROM models "
        "WHERE o_orderstatus = 'F'",
    ),
    "model_list": "WITH " + _MODELS + (
        " SELECT name, type, folder || name || '.sql' AS path, "
        "'customer_' || o_custkey || ', calendar' AS dependencies, "
        "CASE WHEN o_orderstatus = 'F' THEN 'sales.lines_' || o_orderkey ELSE 'None' END "
        "AS sources FROM models"
    ),
    "run_log_status": "WITH " + _RUN_LOG + (
        ' SELECT scope, command, "at", coalesce(status, \'info\') AS status '
        "FROM scopes LEFT JOIN (SELECT * FROM ranked WHERE n = 1) USING (scope)"
    ),
}

_RUNNING = on_details(
    f"SELECT account_code, {text('transaction_date')}, booking_number, number, Code1, Code2, "
    f"{money('net_amount', 'running_balance')} FROM details"
)
ORACLES["running_balance"] = _RUNNING
ORACLES["running_balance_sliced"] = _RUNNING


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
