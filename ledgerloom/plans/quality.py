"""Declared column tests, schema checks and record validation."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.rules import (
    CLEAN,
    ERROR,
    Rule,
    apply_rules,
    check_account_code,
    check_amount,
    check_date,
    check_text,
)
from ledgerloom.session import shared_folder

# --- declared tests ---------------------------------------------------------


@dataclass(frozen=True)
class ColumnTest:
    model: str
    column: str
    kind: str  # "not_null" or "unique"


# The tests declared for the models.
DECLARED_TESTS = (
    ColumnTest("stg_financial_transactions", "account_code", "not_null"),
    ColumnTest("stg_financial_transactions", "transaction_date", "not_null"),
    ColumnTest("int_account_balances", "account_code", "not_null"),
    ColumnTest("int_account_balances", "account_code", "unique"),
    ColumnTest("mart_account_summary", "account_code", "not_null"),
    ColumnTest("mart_account_summary", "account_code", "unique"),
    ColumnTest("mart_transaction_details", "transaction_id", "not_null"),
    ColumnTest("mart_transaction_details", "transaction_id", "unique"),
    ColumnTest("mart_transaction_details", "account_code", "not_null"),
    ColumnTest("mart_transaction_details", "transaction_date", "not_null"),
)


def _result(model: Column | str, name: Column, test: str, failures: Column) -> list[Column]:
    return [
        (F.lit(model) if isinstance(model, str) else model).alias("model"),
        name.alias("column_name"),
        F.lit(test).alias("test"),
        failures.alias("failures"),
        (failures == 0).alias("passed"),
    ]


def not_null_tests(frame: DataFrame, model: str, columns: Sequence[str]) -> DataFrame:
    """NULLs per column; all columns in one pass."""
    counts = frame.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in columns])
    rows = counts.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("name"), F.col(name).alias("failures"))
                    for name in columns
                ]
            )
        ).alias("test")
    )
    return rows.select(_result(model, F.col("test.name"), "not_null", F.col("test.failures")))


def unique_test(frame: DataFrame, model: str, name: str) -> DataFrame:
    """Number of values that occur more than once; NULLs are not values."""
    repeated = (
        frame.where(F.col(name).isNotNull())
        .groupBy(name)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .agg(F.count(F.lit(1)).alias("failures"))
    )
    return repeated.select(_result(model, F.lit(name), "unique", F.col("failures")))


def run_tests(
    models: Mapping[str, DataFrame], tests: Iterable[ColumnTest] = DECLARED_TESTS
) -> DataFrame:
    """One row per test: model, column, test, failures, passed."""
    tests = list(tests)
    results = []
    for model, frame in models.items():
        wanted = [t.column for t in tests if t.model == model and t.kind == "not_null"]
        if wanted:
            results.append(not_null_tests(frame, model, wanted))
        results += [
            unique_test(frame, model, t.column)
            for t in tests
            if t.model == model and t.kind == "unique"
        ]
    return reduce(DataFrame.unionByName, results)


# --- schemas ----------------------------------------------------------------


class SchemaMismatch(ValueError):
    """A frame's types differ from the expected ones."""


def schema_mismatches(frame: DataFrame, expected: T.StructType) -> list[str]:
    """One message per expected column that is there with another type."""
    found = {field.name: field.dataType for field in frame.schema}
    return [
        f"Column '{field.name}': found {found[field.name].simpleString()}, "
        f"expected {field.dataType.simpleString()}"
        for field in expected
        if field.name in found and found[field.name] != field.dataType
    ]


def validate_schema(
    frame: DataFrame, expected: T.StructType, strict: bool = False, source: str = "Data"
) -> DataFrame:
    """Strict: raise on any mismatch. Lenient: cast known columns, failures to NULL."""
    if strict:
        errors = schema_mismatches(frame, expected)
        if errors:
            raise SchemaMismatch(f"{source} schema validation failed:\n" + "\n".join(errors))
        return frame
    return frame.withColumns(
        {
            field.name: F.col(field.name).try_cast(field.dataType)
            for field in expected
            if field.name in frame.columns
        }
    )


def schema_report(frame: DataFrame, expected: T.StructType) -> DataFrame:
    """Per expected column: its type here, and how many values a cast would lose."""
    found = {field.name: field.dataType for field in frame.schema}
    known = [field for field in expected if field.name in found]
    lost = frame.agg(
        *[
            F.count_if(
                F.col(field.name).isNotNull() & F.col(field.name).try_cast(field.dataType).isNull()
            ).alias(field.name)
            for field in known
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(field.name).alias("column_name"),
                F.lit(found[field.name].simpleString()).alias("found"),
                F.lit(field.dataType.simpleString()).alias("expected"),
                F.lit(found[field.name] == field.dataType).alias("matches"),
                F.col(field.name).alias("lost_values"),
            )
            for field in known
        ]
    )
    return lost.select(F.inline(rows))


# Parts of column names that mark an amount.
AMOUNT_WORDS = ("debit", "credit", "balance", "amount", "vat")
LABEL_ENDINGS = ("_type", "_category", "_code", "_name")


def standardize_numeric(frame: DataFrame) -> DataFrame:
    """Amount columns, told by their names, as double.

    Text columns named as labels keep their text.
    """
    changed = {}
    for field in frame.schema:
        name = field.name.lower()
        if not any(word in name for word in AMOUNT_WORDS):
            continue
        if isinstance(field.dataType, T.NumericType):
            changed[field.name] = F.col(field.name).cast("double")
        elif isinstance(field.dataType, T.StringType) and not name.endswith(LABEL_ENDINGS):
            changed[field.name] = F.col(field.name).try_cast("double")
    return frame.withColumns(changed) if changed else frame


# --- records ----------------------------------------------------------------

# The fields that are required, and the order in which amounts are checked.
TRANSACTION_FIELDS = ("account_code", "transaction_date", "description")
TRANSACTION_AMOUNTS = ("debit_amount", "credit_amount", "net_amount")
ACCOUNT_AMOUNTS = ("total_debit", "total_credit", "net_balance")


def _judged(frame: DataFrame, rules: dict[str, Rule], errors: list[Column]) -> DataFrame:
    """``clean_`` columns, and the errors that apply as one array."""
    judged = apply_rules(frame, rules).withColumn("errors", F.array_compact(F.array(*errors)))
    return judged.drop(*[ERROR + name for name in rules])


def _message(prefix: str, name: str) -> Column:
    return F.concat(F.lit(prefix), F.col(ERROR + name))


def _amount_errors(names: list[str]) -> list[Column]:
    """An absent amount is no error."""
    return [F.when(F.col(name).isNotNull(), _message(f"{name}: ", name)) for name in names]


def validate_transactions(frame: DataFrame, today: dt.date) -> DataFrame:
    """Adds ``errors`` and a ``clean_`` value for each checked column.

    Other columns pass through.
    """
    present = dict(frame.dtypes)
    rules: dict[str, Rule] = {}
    errors: list[Column] = []
    for name in TRANSACTION_FIELDS:
        message = F.lit(f"Missing required field: {name}")
        if name in present:
            text = F.col(name).cast("string")
            message = F.when(text.isNull() | (text == ""), message)
        errors.append(message)
    if "account_code" in present:
        rules["account_code"] = check_account_code("account_code")
        errors.append(_message("Account code: ", "account_code"))
    if "transaction_date" in present:
        typed = present["transaction_date"] != "string"
        rules["transaction_date"] = check_date(
            "transaction_date", dt.date(1900, 1, 1), today, typed
        )
        errors.append(_message("Transaction date: ", "transaction_date"))
    if "description" in present:
        rules["description"] = check_text("description", 1, 500)
        errors.append(_message("Description: ", "description"))
    amounts = [name for name in TRANSACTION_AMOUNTS if name in present]
    rules.update({name: check_amount(name) for name in amounts})
    errors += _amount_errors(amounts)
    needed = F.lit("At least one amount field (debit, credit, or net) must be provided")
    if amounts:
        needed = F.when(F.coalesce(*[F.col(CLEAN + name) for name in amounts]).isNull(), needed)
    errors.append(needed)
    return _judged(frame, rules, errors)


def validate_accounts(frame: DataFrame) -> DataFrame:
    """As ``validate_transactions``, for account records."""
    present = set(frame.columns)
    rules: dict[str, Rule] = {}
    errors: list[Column] = []
    if "account_code" in present:
        rules["account_code"] = check_account_code("account_code")
        errors.append(_message("Account code: ", "account_code"))
    else:
        errors.append(F.lit("Missing required field: account_code"))
    if "account_name" in present:
        rules["account_name"] = check_text("account_name", 1, 200)
        errors.append(_message("Account name: ", "account_name"))
    amounts = [name for name in ACCOUNT_AMOUNTS if name in present]
    rules.update({name: check_amount(name) for name in amounts})
    return _judged(frame, rules, errors + _amount_errors(amounts))


def valid_records(validated: DataFrame) -> DataFrame:
    """Accepted rows with their cleaned values in place of the originals."""
    cleaned = [name for name in validated.columns if name.startswith(CLEAN)]
    originals = {name.removeprefix(CLEAN) for name in cleaned}
    return validated.where(F.size("errors") == 0).select(
        *[
            F.col(CLEAN + name).alias(name) if name in originals else F.col(name)
            for name in validated.columns
            if name not in cleaned and name != "errors"
        ]
    )


def invalid_records(validated: DataFrame) -> DataFrame:
    """Rejected rows as they came, with their errors."""
    return validated.where(F.size("errors") > 0).drop(
        *[name for name in validated.columns if name.startswith(CLEAN)]
    )


def validation_summary(validated: DataFrame) -> DataFrame:
    """Totals of valid and invalid records, of errors, and the rate of valid ones."""
    counts = validated.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(F.size("errors") == 0).alias("valid_records"),
        F.count_if(F.size("errors") > 0).alias("invalid_records"),
        F.coalesce(F.sum(F.size("errors")), F.lit(0)).cast("bigint").alias("total_errors"),
    )
    rate = F.col("valid_records").cast("double") / F.col("total_records")
    return counts.withColumn(
        "validation_rate", F.when(F.col("total_records") == 0, 0.0).otherwise(rate)
    )


def validation_report(
    validated: DataFrame, order: Sequence[Column], shown: int = 10
) -> DataFrame:
    """The first invalid records, their errors, and how many more there are.

    Records are told apart by their own columns: numbering all of them would
    sort everything to show a few. The rules are evaluated once: what they reject is written to
    the shared folder, counted and shown from there. A checkpoint keeps the columns that the
    order may be bound to.
    """
    shared_folder(validated.sparkSession)
    invalid = invalid_records(validated).checkpoint()
    more = max(0, invalid.count() - shown)
    return (
        invalid.orderBy(*order)
        .limit(shown)
        .withColumn("more_invalid", F.lit(more).cast("bigint"))
    )


def error_counts(validated: DataFrame) -> DataFrame:
    """How often each error occurs."""
    return (
        validated.select(F.explode("errors").alias("error"))
        .groupBy("error")
        .agg(F.count(F.lit(1)).alias("records"))
    )
