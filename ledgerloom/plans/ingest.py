"""Ingesting exported files into the version store."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.filters import anti_join
from ledgerloom.schema import LOADED_LEDGER
from ledgerloom.session import shared_folder
from ledgerloom.sources.files import BAD, FIELDS, Export, checked, discover, exports, read_records
from ledgerloom.sources.store import EXTRA, MEGABYTE, PREFIX, QUARANTINED, VERSION, VersionStore, folded, timestamp

STATUS = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("rejected", T.LongType()),  # records read and not stored
        T.StructField("version_id", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)


_OF, _ID = "_of_source", "_id_of_source"  # source and version while records are written


def new_files(landed: DataFrame, log: DataFrame) -> DataFrame:
    """Landed files whose exact name is not in the ingestion log."""
    return anti_join(landed, log.select(F.col("source_file").alias("name")), "name")


def new_parts(landed: DataFrame, store: VersionStore) -> DataFrame:
    """Landed files that were not ingested; ``late`` if others of their export were.

    An export in the log of which no file is known was ingested whole."""
    known = store.parts()
    before = known.select("name").distinct().withColumn("late", F.lit(True))
    whole = anti_join(store.ingestion_log().select(F.col("source_file").alias("name")), before, "name")
    fresh = anti_join(anti_join(landed, known.select("path"), "path"), whole, "name")
    return fresh.join(before, "name", "left").withColumn("late", F.coalesce("late", F.lit(False)))


def ingest_folder(
    store: VersionStore, folder: str, loaded_at: dt.datetime, force: bool = False
) -> DataFrame:
    """Ingest what is new below a folder; one status row per file found."""
    spark = store.spark
    shared_folder(spark)
    landed = discover(spark, folder).checkpoint()  # what lands from here on is for the next run
    wanted = landed.withColumn("late", F.lit(False)) if force else new_parts(landed, store)
    wanted = wanted.checkpoint()
    names = wanted.select("name").distinct()
    skipped = anti_join(landed.select("name").distinct(), names, "name").select(
        F.col("name").alias("file"),
        F.lit("skipped").alias("status"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in STATUS.fields[2:5]],
        F.lit("Already processed").alias("message"),
    )
    done = ingest_exports(store, exports(spark, wanted), loaded_at, f"{loaded_at:%Y%m%d_%H%M%S}", wanted)
    return spark.createDataFrame(done, STATUS).union(skipped).orderBy("file")


def ingest_exports(
    store: VersionStore, sources: Sequence[Export], loaded_at: dt.datetime, label: str, files: DataFrame
) -> list[tuple]:
    """Store each accepted source as one version; status tuples, one per source.

    All sources are read, checked and written by one job, which parses each file once: rows that
    can be stored go to their version, all others, with reason and text, to a quarantine beside it.
    What was written is then counted from file footers, and the manifest rows of the non-empty
    versions, written together, make them visible and are their log. The same ``label`` writes the
    same versions. ``files`` lists the files, so that later ones of an export are told apart.
    """
    accepted = [source for source in sources if source.accepted]
    written: dict[str, Written] = {}
    if accepted:
        written = _write(store, accepted, loaded_at, label)
        broken = _in_quotes(store, written)
        if broken:
            # Some quoted values hold line ends: such files are read whole, if that saves records.
            again = [source for source in accepted if source.name in broken]
            for name, found in _write(store, again, loaded_at, label, lines_in_quotes=True).items():
                if found.quarantined < written[name].quarantined:
                    written[name] = found
        _commit(store, accepted, written, loaded_at, files)
    return [_status(source, written.get(source.name)) for source in sources]


@dataclass(frozen=True)
class Written:
    version: str
    stored: int
    quarantined: int
    bytes: int


def _write(
    store: VersionStore, sources: Sequence[Export], loaded_at: dt.datetime, label: str, lines_in_quotes: bool = False
) -> dict[str, Written]:
    """Write the sources' records; what was written, by source."""
    spark = store.spark
    names = spark.createDataFrame([(source.name,) for source in sources], "name string")
    mark = "-lines" if lines_in_quotes else ""
    version = lambda name: F.concat(F.lit(f"{PREFIX}_"), _version_part(name), F.lit(f"{mark}_{label}"))
    versions = {r.name: r.id for r in names.select("name", version("name").alias("id")).collect()}
    # One row per source: cheaper to look up than to make of each record's source.
    ids = F.broadcast(spark.createDataFrame(list(versions.items()), f"{_OF} string, {_ID} string"))
    frames = []
    for rows in read_records(spark, sources, lines_in_quotes):
        rows = folded(checked(rows, loaded_at), besides=(BAD,))
        rows = rows.join(ids, F.col("_source_file") == F.col(_OF), "left").drop(_OF)
        is_bad = F.col(BAD).isNotNull()
        why = F.create_map(F.lit("reason"), F.col(f"{BAD}.reason"), F.lit("text"), F.col(f"{BAD}.text"))
        place = F.concat(F.when(is_bad, QUARANTINED).otherwise(""), F.coalesce(_ID, version("_source_file")))
        kept = F.when(is_bad, why).otherwise(F.col(EXTRA))
        frames.append(rows.withColumns({EXTRA: kept, VERSION: place}).drop(BAD, _ID))
    store.write_rows(reduce(DataFrame.unionByName, frames))
    both = [place for id_ in versions.values() for place in (id_, QUARANTINED + id_)]
    present = store.written_versions(both)
    sizes = {r[VERSION]: r for r in store.version_sizes(present).collect()} if present else {}
    count = lambda id_: sizes[id_].records_count if id_ in sizes else 0
    return {
        name: Written(id_, count(id_), count(QUARANTINED + id_), sizes[id_].bytes if id_ in sizes else 0)
        for name, id_ in versions.items()
    }


def _in_quotes(store: VersionStore, written: dict[str, Written]) -> set[str]:
    """Sources with a line that has an odd number of quotes and the wrong number of fields."""
    bad = [found.version for found in written.values() if found.quarantined]
    if not bad:
        return set()
    text = F.col("text")
    quotes = F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))
    rows = store.quarantine_of(bad).where((F.col("reason") == FIELDS) & (quotes % 2 == 1))
    return {row.file for row in rows.select("file").distinct().collect()}


def _version_part(name: str) -> Column:
    """A source's name as part of a folder's name.

    Where that takes more than replacing the dot of the extension, a digest keeps
    apart names that would become alike.
    """
    plain = F.regexp_replace(name, "[^A-Za-z0-9_-]", "_")
    stem = F.substring_index(name, ".", 1)
    usual = F.concat_ws("_", stem, F.substring_index(name, ".", -1)) == plain
    digest = F.substring(F.md5(name), 1, 8)
    return F.when(usual, plain).otherwise(F.concat_ws("_", plain, digest))


def _commit(
    store: VersionStore,
    accepted: Sequence[Export],
    written: dict[str, Written],
    loaded_at: dt.datetime,
    files: DataFrame,
) -> None:
    """Publish the quarantines, the files that were read, and last the versions."""
    spark = store.spark
    listed = [(name, w.version, w.stored, w.quarantined, w.bytes) for name, w in written.items()]
    found = spark.createDataFrame(
        listed, "name string, version string, stored bigint, quarantined bigint, bytes bigint"
    )
    store.commit_quarantine(found.where("quarantined > 0"), loaded_at)
    if not any(w.stored for w in written.values()):
        return
    found = found.where("stored > 0")
    store.commit_parts(files.join(found.select("name", F.col("version").alias(VERSION)), "name"))
    # The columns of the file, and those that loading adds.
    names = spark.createDataFrame(
        [(source.name, sorted({*source.columns, *LOADED_LEDGER.names})) for source in accepted],
        "name string, columns array<string>",
    )
    store.commit(
        found.join(names, "name").select(
            F.col("version").alias("snapshot_id"),
            timestamp(loaded_at).alias("created"),
            F.col("name").alias("source_file"),
            F.concat(F.col("version"), F.lit(".parquet")).alias("parquet_file"),
            F.col("stored").alias("records_count"),
            F.round(F.col("bytes") / MEGABYTE, 2).alias("file_size_mb"),
            F.lit("append").alias("operation"),
            "columns",
            F.col("name").alias("landed"),
        )
    )


def _status(source: Export, written: Written | None) -> tuple:
    if source.columns is None:
        return (source.name, "failed", None, None, None, "Unreadable file")
    if not source.accepted:
        return (source.name, "failed", None, None, None, "Schema validation failed")
    if not written.stored:
        return (source.name, "failed", 0, written.quarantined, None, "No valid rows after cleaning")
    return (source.name, "processed", written.stored, written.quarantined, written.version, "Ingested")


def status_counts(statuses: DataFrame) -> DataFrame:
    """Files processed, skipped and failed; zeros included."""
    return statuses.agg(
        *[
            F.count_if(F.col("status") == status).alias(status)
            for status in ("processed", "skipped", "failed")
        ]
    )
