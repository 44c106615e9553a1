"""What the named queries start from, derived from the sample tables.

Saved tables (marts, a version store, landed exports) are written once per
session and folder, below the shared folder, and reused by the queries on them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.filters import SourceSelection
from ledgerloom.plans.dashboard import Dashboard
from ledgerloom.plans.marts import Marts, save_marts
from ledgerloom.schema import LEDGER, LOADED_LEDGER, MONEY
from ledgerloom.session import PACKED, new_folder, without_leftovers
from ledgerloom.sources.sample import AS_OF, ledger
from ledgerloom.sources.store import VersionStore

_SAVED: dict[tuple, object] = {}

LOADED_AT = dt.datetime(2002, 3, 1, 8, 0, 0)


def _once(spark: SparkSession, folder: str, what: str, build: Callable[[], object]):
    key = (spark.sparkContext.applicationId, folder, what)
    if key not in _SAVED:
        _SAVED[key] = build()
    return _SAVED[key]


# --- ledger and marts ---


def saved_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The sample ledger as a stored table.

    Its files are the partitions of the last join, which adaptive execution splits where they are
    large and joins where they are small: the finished rows, several times as wide as the
    lines they come from, are not shuffled again.
    """

    def build():
        path = new_folder(spark, "ledger")
        with without_leftovers(spark):
            ledger(spark, folder).write.options(**PACKED).parquet(path)
        return path

    path = _once(spark, folder, "ledger", build)
    return spark.read.schema(LOADED_LEDGER).parquet(path)


def marts(spark: SparkSession, folder: str) -> Marts:
    def build():
        return save_marts(
            saved_ledger(spark, folder), new_folder(spark, "marts"), AS_OF, LOADED_AT
        )

    return _once(spark, folder, "marts", build)


def dashboard(
    spark: SparkSession, folder: str, sources: SourceSelection = SourceSelection()
) -> Dashboard:
    saved = marts(spark, folder)
    return Dashboard(saved.transactions, saved.accounts, AS_OF, sources)


# --- versions ---


class Version:
    def __init__(self, name: str, first: int, last: int, factor: int, created: dt.datetime):
        self.id = f"financial_transactions_{name}_{created:%Y%m%d_%H%M%S}"
        self.source = f"{name}.xlsx"
        self.first, self.last, self.factor, self.created = first, last, factor, created


# Three loads with overlapping years; the second one restates its amounts.
VERSIONS = (
    Version("first", 1995, 1998, 1, dt.datetime(1999, 2, 24)),
    Version("second", 1997, 2000, 2, dt.datetime(2001, 2, 24)),
    Version("third", 1999, 2001, 1, dt.datetime(2002, 2, 24)),
)


def store(spark: SparkSession, folder: str) -> VersionStore:
    def build():
        result = VersionStore(spark, new_folder(spark, "store"))
        rows = saved_ledger(spark, folder)
        for version in VERSIONS:
            result.write_version(
                rows.where(F.year("Boekdatum").between(version.first, version.last)).withColumns(
                    {
                        "Debet": (F.col("Debet") * version.factor).cast(MONEY),
                        "Credit": (F.col("Credit") * version.factor).cast(MONEY),
                        "_loaded_at": F.lit(str(version.created)).cast("timestamp_ntz"),
                    }
                ),
                version.id,
                version.created,
                version.source,
            )
        return result

    return _once(spark, folder, "store", build)


# --- landed exports ---

# The years' files differ as exports do: one lacks a column and has one of its
# own, one lacks a column no ledger can do without, two are not CSV.
WITHOUT_OPTIONAL, WITHOUT_CORE, AS_JSON, AS_PARQUET = 1998, 1999, 2000, 2001
# One is in two parts that differ in the order of debit and credit. Another is there again: in
# a folder below with that order, without any date, and as records the first lines of which
# are broken.
IN_TWO_ORDERS, REPEATED = 1996, 1995
SWAP = {"Debet": "Credit", "Credit": "Debet"}
CSV = {"header": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
# Texts land packed, as exports of such a size do.
GZIPPED = {"compression": "gzip"}


def landing(spark: SparkSession, folder: str) -> str:
    def build():
        path = new_folder(spark, "landing")
        rows = saved_ledger(spark, folder).withColumn("_year", F.year("Boekdatum"))
        base = rows.select(*LEDGER.names, "_year")
        write = lambda frame, form: (
            frame.withColumn("export", F.format_string(f"DUMP%d.{form}", "_year"))
            .drop("_year")
            .write.mode("append")
            .partitionBy("export")
            .options(**(PACKED if form == "parquet" else CSV | GZIPPED))
            .format(form)
            .save(path)
        )
        write(base.where(F.col("_year") < IN_TWO_ORDERS), "csv")
        swapped = [SWAP.get(name, name) for name in base.columns]
        parts = base.where(F.col("_year") == IN_TWO_ORDERS)
        write(parts.where(F.col("Nummer") % 2 == 1), "csv")
        write(parts.where(F.col("Nummer") % 2 == 0).select(*swapped), "csv")
        write(base.where(F.col("_year").between(IN_TWO_ORDERS + 1, WITHOUT_OPTIONAL - 1)), "csv")
        again = base.where(F.col("_year") == REPEATED)
        csv = CSV | GZIPPED
        again.drop("_year").select(*[n for n in swapped if n != "_year"]).write.options(**csv).csv(
            f"{path}/more/DUMP{REPEATED}.csv"
        )
        again.drop("_year").withColumn("Boekdatum", F.lit("soon")).write.options(**csv).csv(
            f"{path}/UNDATED.csv"
        )
        record = F.to_json(F.struct(*LEDGER.names))
        # Lines as they are: Spark's writer of texts would give the parts another ending.
        bare = {"sep": "\x01", "quote": "\x02", "escape": "\x02"}
        again.select(
            F.when(F.col("Nummer") == 1, F.concat(F.lit("#"), record)).otherwise(record)
        ).write.options(**bare, **GZIPPED).csv(f"{path}/BROKEN.json")
        without = base.where(F.col("_year") == WITHOUT_OPTIONAL).drop("Btwcode")
        write(without.withColumn("Opmerking", F.lit("n.v.t.")), "csv")
        write(base.where(F.col("_year") == WITHOUT_CORE).drop("Credit"), "csv")
        write(base.where(F.col("_year") == AS_JSON), "json")
        write(base.where(F.col("_year") == AS_PARQUET), "parquet")
        return path

    return _once(spark, folder, "landing", build)


FAULTY_COLUMNS = (
    "CodeGrootboekrekening", "Boekdatum", "Debet", "Credit", "Omschrijving", "Boekingsnummer", "Nummer",
)


def faulty_landing(spark: SparkSession, folder: str) -> str:
    """Exports with what goes wrong in exports, of all rows each: lines with a surplus field, lines
    that lack fields, quoted line ends, no dates; lines that are no records; Parquet with amounts
    as doubles, and with types that differ among its files; a file that is no Parquet."""

    def build():
        path = new_folder(spark, "faulty")
        # Lines as they are, without quoting of its own.
        bare = {"sep": "\x01", "quote": "\x02", "escape": "\x02", "emptyValue": ""}
        rows = saved_ledger(spark, folder)
        text = {n: F.coalesce(F.col(n).cast("string"), F.lit("")) for n in FAULTY_COLUMNS}
        text["Debet"] = by_line("Nummer", {1: F.lit("1,5")}, text["Debet"])
        text["Boekdatum"] = by_line("Nummer", {4: F.lit("soon")}, text["Boekdatum"])
        text["Omschrijving"] = by_line("Nummer", {3: F.lit('"line\n3, more"')}, text["Omschrijving"])
        whole = F.concat_ws(",", *text.values())
        short = F.concat_ws(",", *[text[n] for n in FAULTY_COLUMNS[:3]])
        # The first line of each file is its header: the name of the only column.
        line = F.when(F.col("Nummer") == 2, short).otherwise(whole).alias(",".join(FAULTY_COLUMNS))
        rows.select(line).write.options(**bare, **GZIPPED, header="true", lineSep="\n").csv(f"{path}/FAULTY.CSV")

        record = F.to_json(F.struct(*LEDGER.names))
        broken = F.concat(F.lit("no record of "), F.col("Boekingsnummer").cast("string"))
        rows.select(F.when(F.col("Nummer") == 1, broken).otherwise(record)).write.options(**bare, **GZIPPED).csv(
            f"{path}/RECORDS.JSON"
        )
        ledger_rows = rows.select(*LEDGER.names)
        doubled = ledger_rows.withColumn("Debet", F.col("Debet").cast("double"))
        as_text = ledger_rows.withColumn("Debet", F.col("Debet").cast("string"))
        doubled.write.options(**PACKED).parquet(f"{path}/DOUBLE.parquet")
        odd = F.col("Nummer") % 2 == 1
        doubled.where(odd).write.options(**PACKED).parquet(f"{path}/MIXED.parquet")
        as_text.where(~odd).write.mode("append").options(**PACKED).parquet(f"{path}/MIXED.parquet")
        rows.select("Code").limit(1).write.options(**bare).csv(f"{path}/DAMAGED.parquet")
        return path

    return _once(spark, folder, "faulty", build)


def late_parts(spark: SparkSession, folder: str, landing: str, part: int, parts: int) -> None:
    """One of several parts of an export lands."""
    rows = saved_ledger(spark, folder).where(F.pmod(F.xxhash64("Boekingsnummer"), F.lit(parts)) == part)
    rows.select(*LEDGER.names).write.mode("append").options(**CSV, **GZIPPED).csv(f"{landing}/LATE.csv")


# --- dirty text columns ---


def by_line(number: Column | str, cases: dict[int, Column], otherwise: Column) -> Column:
    """A different rendering for each line number."""
    number = F.col(number) if isinstance(number, str) else number
    result = None
    for line, value in cases.items():
        result = (
            F.when(number == line, value) if result is None else result.when(number == line, value)
        )
    return result.otherwise(otherwise)


def dirty_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger as an export with bad values: all text, one column missing."""
    rows = saved_ledger(spark, folder)
    text = {name: F.col(name).cast("string") for name in LEDGER.names if name != "Factuurnummer"}
    text["Debet"] = by_line("Nummer", {1: F.lit("abc"), 2: F.lit("1,5")}, text["Debet"])
    text["Boekingsnummer"] = by_line("Nummer", {4: F.lit("x")}, text["Boekingsnummer"])
    text["Boekdatum"] = by_line(
        "Nummer", {5: F.lit("2024-02-30"), 6: F.lit(" ")}, text["Boekdatum"]
    )
    return rows.select("_source_file", *[value.alias(name) for name, value in text.items()])


def dirty_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions as text records, with something wrong on most lines."""
    rows = marts(spark, folder).transactions
    day = F.col("transaction_date")
    # One side of each line is 0.
    amount = (F.col("debit_amount") + F.col("credit_amount")).cast(MONEY).cast("string")
    code = F.col("account_code")
    text = F.col("description")
    return rows.select(
        "booking_number",
        "number",
        F.col("Code1").alias("code1"),
        F.col("Code2").alias("code2"),
        by_line(
            "number",
            {
                1: F.concat(F.lit(" ab-"), code, F.lit(" ")),
                2: F.lit("a"),
                3: F.repeat(code, 21),
                4: F.concat(F.lit("a "), code),
                5: F.lit(""),
                6: F.lit(None).cast("string"),
            },
            F.concat(F.lit("ACC."), code),
        ).alias("account_code"),
        by_line(
            "number",
            {
                1: F.date_format(day, "yyyy-MM-dd"),
                2: F.date_format(day, "dd/MM/yyyy"),
                3: F.date_format(day, "MM/dd/yyyy"),
                4: F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 07:08:09")),
                5: F.lit("13/13/2020"),
                6: F.lit("31/12/2020"),
            },
            F.lit("1899-12-31"),
        ).alias("transaction_date"),
        by_line(
            "number",
            {
                2: F.lit(None).cast("string"),
                3: F.concat(F.lit(" <b>\""), text, F.lit("\"</b> & 'more' ")),
                4: F.repeat(text, 100),
            },
            text,
        ).alias("description"),
        by_line(
            "number",
            {
                1: F.concat(F.lit("€ 1,"), F.lpad(amount, 12, "0")),
                2: F.concat(F.lit("-"), amount),
                3: F.lit("abc"),
                4: F.lit(None).cast("string"),
                5: F.concat(F.lit("10000000"), F.lpad(amount, 12, "0")),
                6: F.concat(F.lit(" $"), amount, F.lit(" ")),
            },
            amount,
        ).alias("debit_amount"),
        by_line("number", {4: F.lit("-1e3")}, F.lit(None).cast("string")).alias("credit_amount"),
        F.concat(
            F.lower(F.regexp_replace("account_name", "#", "")),
            by_line("number", {1: F.lit("@"), 2: F.lit(" at ")}, F.lit("@Mail.")),
            by_line("number", {3: F.lit("c")}, F.lit("com ")),
        ).alias("email"),
    )
