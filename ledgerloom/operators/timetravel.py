"""Past states of the ledger: as-of reads, comparison, consolidation, audit."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.schema import BUSINESS_KEY, LINE_ORDER
from ledgerloom.sources.store import VERSION, VersionNotFound, VersionStore, timestamp

DATE = "Boekdatum"


def version_at(store: VersionStore, moment: dt.datetime) -> str:
    """Id of the newest version created at or before the moment."""
    try:
        return store.newest(store.manifest().where(F.col("created") <= timestamp(moment)))
    except VersionNotFound:
        raise VersionNotFound(f"No data available at timestamp {moment}") from None


def query_at_timestamp(store: VersionStore, moment: dt.datetime) -> DataFrame:
    return store.read(version_at(store, moment))


def query_at_date(store: VersionStore, day: dt.date) -> DataFrame:
    """As of the end of the day."""
    return query_at_timestamp(store, dt.datetime.combine(day, dt.time.max))


def versions_at(moments: DataFrame, column: str, manifest: DataFrame) -> DataFrame:
    """Adds ``version_id``, the version valid at each row's moment, NULL if none.

    A version is valid until the next one is created. Its interval is spread over
    the days it touches, so the lookup is an equi-join on the day in which a
    day's moments meet only the versions of that day. The spread side has one
    row per day and one per version; whether it is small enough to broadcast is
    the planner's decision, on its measured size.
    """
    # One row per version: metadata, small enough for one task.
    ordered = Window.partitionBy(F.lit(0)).orderBy("created", "snapshot_id")
    upper = moments.agg(F.max(F.col(column).cast("timestamp_ntz"))).first()[0]
    known = manifest.select(
        F.col("snapshot_id").alias(VERSION),
        F.col("created").alias("_from"),
        F.lead("created").over(ordered).alias("_to"),
    )
    if upper is None:
        return moments.withColumn(VERSION, F.lit(None).cast("string"))
    end = F.coalesce(F.col("_to"), F.greatest(F.col("_from"), timestamp(upper)))
    spread = known.select(
        VERSION,
        "_from",
        "_to",
        F.explode(
            F.sequence(F.col("_from").cast("date"), end.cast("date"), F.expr("interval 1 day"))
        ).alias("_day"),
    )
    moment = F.col(column).cast("timestamp_ntz")
    valid = (
        (moment.cast("date") == F.col("_day"))
        & (moment >= F.col("_from"))
        & (F.col("_to").isNull() | (moment < F.col("_to")))
    )
    return moments.join(spread, valid, "left").drop("_from", "_to", "_day")


def date_range(rows: DataFrame) -> DataFrame:
    """First and last date as text; NULL if there is no date column or no row."""
    if DATE not in rows.columns:
        return rows.agg(
            F.max(F.lit(None).cast("string")).alias("min_date"),
            F.max(F.lit(None).cast("string")).alias("max_date"),
        )
    return rows.agg(
        F.min(DATE).cast("string").alias("min_date"), F.max(DATE).cast("string").alias("max_date")
    )


def compare_versions(store: VersionStore, first: str, second: str) -> DataFrame:
    """One row: size, columns and date range of both, and what differs.

    Both versions are aggregated in one scan.
    """
    names = {version: _stored_columns(store, version) for version in (first, second)}
    rows = store.read_all({first, second})
    in_first, in_second = F.col(VERSION) == first, F.col(VERSION) == second

    def listed(values: Iterable[str]) -> Column:
        return F.array(*[F.lit(value) for value in sorted(values)]).cast("array<string>")

    counts = rows.agg(
        F.count_if(in_first).alias("rows1"),
        F.count_if(in_second).alias("rows2"),
        F.min(F.when(in_first, F.col(DATE))).cast("string").alias("min_date1"),
        F.max(F.when(in_first, F.col(DATE))).cast("string").alias("max_date1"),
        F.min(F.when(in_second, F.col(DATE))).cast("string").alias("min_date2"),
        F.max(F.when(in_second, F.col(DATE))).cast("string").alias("max_date2"),
    )
    return counts.select(
        F.lit(first).alias("version1"),
        F.lit(second).alias("version2"),
        "rows1",
        "rows2",
        F.lit(len(names[first])).cast("bigint").alias("columns1"),
        F.lit(len(names[second])).cast("bigint").alias("columns2"),
        (F.col("rows2") - F.col("rows1")).alias("row_change"),
        listed(names[second] - names[first]).alias("new_columns"),
        listed(names[first] - names[second]).alias("removed_columns"),
        listed(names[first] & names[second]).alias("common_columns"),
        "min_date1",
        "max_date1",
        "min_date2",
        "max_date2",
    )


def _stored_columns(store: VersionStore, version: str) -> set[str]:
    """The columns that a version came with, as its manifest row has them."""
    found = store.manifest().where(F.col("snapshot_id") == version).select("columns").first()
    if found is None:
        raise VersionNotFound(f"Version not found: {version}")
    return set(found[0] or [])


def changes_since(store: VersionStore, since: str) -> DataFrame:
    """Every version newer than ``since``: created, size, rows and date range.

    One scan over all of them, whatever their number.
    """
    manifest = store.manifest()
    found = manifest.where(F.col("snapshot_id") == since).select("created").first()
    if found is None:
        raise VersionNotFound(f"Version not found: {since}")
    newer = manifest.where(F.col("created") > timestamp(found.created))
    described = (
        store.read_of(newer)
        .groupBy(VERSION)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min(DATE).cast("string").alias("min_date"),
            F.max(DATE).cast("string").alias("max_date"),
        )
    )
    return (
        newer.join(described, F.col("snapshot_id") == F.col(VERSION), "left")
        .select(
            F.col("snapshot_id").alias("file"),
            "created",
            F.col("file_size_mb").alias("size_mb"),
            F.coalesce("rows", F.lit(0)).alias("rows"),
            "min_date",
            "max_date",
        )
        .orderBy(F.col("created").desc())
    )


def consolidate(
    rows: DataFrame,
    key: Sequence[str] = BUSINESS_KEY,
    tiebreak: Sequence[str] = LINE_ORDER,
    ordered: bool = False,
) -> DataFrame:
    """The last loaded row of each business key, over rows of several versions.

    NULL is a key value like any other, and a row without a load time wins.
    Without any key column nothing is dropped. Spark keeps one row per key and
    task before the shuffle, so a hot key does not gather its rows in one place.
    """
    available = [name for name in key if name in rows.columns]
    if available:
        newest = Window.partitionBy(*available).orderBy(
            F.col("_loaded_at").desc_nulls_first(),
            *[F.col(name).asc_nulls_last() for name in tiebreak if name in rows.columns],
        )
        rows = (
            rows.withColumn("_rank", F.row_number().over(newest))
            .where(F.col("_rank") == 1)
            .drop("_rank")
        )
    return rows.orderBy(*_by_date(rows)) if ordered else rows


def _by_date(rows: DataFrame) -> list[str]:
    """By date; the further columns let a sort cut through a crowded day."""
    return [name for name in (DATE, *BUSINESS_KEY, *LINE_ORDER) if name in rows.columns]


def consolidated_view(
    store: VersionStore, version_ids: Iterable[str] | None = None, ordered: bool = False
) -> DataFrame:
    """Consolidated rows of the named versions, or of all, with their version."""
    return consolidate(store.read_all(version_ids), ordered=ordered)


def audit_trail(
    store: VersionStore,
    account_code: str | None = None,
    date_from: dt.date | None = None,
    date_to: dt.date | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Matching rows of all versions, each with its version and when that was made."""
    rows = store.read_all()
    if account_code:
        rows = rows.where(F.col("CodeGrootboekrekening") == account_code)
    if date_from:
        rows = rows.where(F.col(DATE) >= F.lit(date_from))
    if date_to:
        rows = rows.where(F.col(DATE) <= F.lit(date_to))
    created = store.manifest().select(
        F.col("snapshot_id").alias(VERSION), F.col("created").alias("_version_created")
    )
    tagged = rows.join(created, VERSION).withColumnRenamed(VERSION, "_version_file")
    return tagged.orderBy("_version_created", *_by_date(tagged)) if ordered else tagged


def audited_versions(audit: DataFrame) -> DataFrame:
    """The versions an audit found rows in."""
    return audit.select("_version_file").distinct().orderBy("_version_file")
