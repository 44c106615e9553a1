"""What lies in the landing folder: sizes, rows and amount totals per file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.files import discover, exports, read_exports
from ledgerloom.sources.store import MEGABYTE

# Names that mark debit and credit columns, the place of the debit
# column in an export, and the files shown as skipped.
DEBIT_WORDS = ("debit", "soll", "amount")
CREDIT_WORDS = ("credit", "haben", "kredit")
DEBIT_POSITION = 11
SKIPPED_WORD = "DUMP2024"

_TOTALS = "_source_file string, n_columns bigint, n_rows bigint, total_debit double, total_credit double"


def _sum(name: str) -> Column:
    return F.coalesce(F.sum(F.col(f"`{name}`").try_cast("double")), F.lit(0.0))


def _positive_sums(names: list[str]) -> Column:
    """Sum of the columns' totals, leaving out totals below zero."""
    result = F.lit(0.0)
    for name in names:
        result = result + F.greatest(_sum(name), F.lit(0.0))
    return result


def file_totals(rows: DataFrame) -> DataFrame:
    """Per source: columns, rows, debit and credit totals.

    The debit total is that of the twelfth column; only where that is 0, of the
    columns named like a debit. Credits go by name.
    """
    names = [name for name in rows.columns if name != "_source_file"]
    lower = {name: name.lower() for name in names}
    debits = [
        name
        for name in names
        if any(word in lower[name] for word in DEBIT_WORDS) and "credit" not in lower[name]
    ]
    credits = [name for name in names if any(word in lower[name] for word in CREDIT_WORDS)]
    placed = _sum(names[DEBIT_POSITION]) if len(names) > DEBIT_POSITION else F.lit(0.0)
    return rows.groupBy("_source_file").agg(
        F.lit(len(names)).cast("bigint").alias("n_columns"),
        F.count(F.lit(1)).alias("n_rows"),
        F.when(placed == 0, _positive_sums(debits)).otherwise(placed).alias("total_debit"),
        _positive_sums(credits).alias("total_credit"),
    )


def file_inventory(
    spark: SparkSession, folder: str, is_skipped: Callable[[Column], Column] | None = None
) -> DataFrame:
    """One row per source, sorted by name; an unreadable one shows zeros."""
    is_skipped = is_skipped or (lambda name: name.contains(SKIPPED_WORD))
    files = discover(spark, folder)
    sources = exports(spark, files)
    frames = [file_totals(rows) for rows in read_exports(spark, sources)]
    totals = spark.createDataFrame([], _TOTALS)
    for frame in frames:
        totals = totals.unionByName(frame)
    # Parts of one export may differ in the order of their columns.
    totals = totals.groupBy("_source_file").agg(
        F.max("n_columns").alias("n_columns"),
        *[F.sum(name).alias(name) for name in ("n_rows", "total_debit", "total_credit")],
    )
    # A readable file without rows still has columns.
    headers = spark.createDataFrame(
        [(source.name, len(source.columns or ())) for source in sources],
        "filename string, header_columns bigint",
    )
    listed = files.groupBy(F.col("name").alias("filename")).agg(
        F.sum("size").alias("bytes"),
        F.max("modified").alias("latest"),
        F.min("path").alias("path"),
    )
    joined = listed.join(headers, "filename").join(
        totals.withColumnRenamed("_source_file", "filename"), "filename", "left"
    )
    zero = F.lit(0.0)
    status = F.when(is_skipped(F.col("filename")), "Skipped").otherwise("Processed")
    return joined.select(
        "filename",
        F.round(F.col("bytes") / MEGABYTE, 2).alias("size_mb"),
        F.coalesce("n_columns", "header_columns").alias("n_columns"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.round(F.coalesce("total_debit", zero), 2).alias("total_debit"),
        F.round(F.coalesce("total_credit", zero), 2).alias("total_credit"),
        F.date_format("latest", "yyyy-MM-dd HH:mm").alias("modified"),
        status.alias("status"),
        "path",
        F.lit("File System Scan").alias("source"),
    ).orderBy("filename")
