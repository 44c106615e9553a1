"""The versioned ledger: immutable Parquet partitions and a manifest.

Layout below the root::

    data/version_id=<id>/*.parquet                rows of a version
    data/version_id=quarantined_<id>/*.parquet    records of its export that could not be stored
    manifest/version_id=<id>/*.parquet            one row describing the version
    quarantine/version_id=<id>/*.parquet          one row describing what was not stored
    parts/version_id=<id>/*.parquet               the files that were read

A version exists once the manifest has its row, which is written last; the ingestion log is
a view of the manifest, so that the two cannot differ. Each write replaces the partitions of
its own versions only, so a repeated or resumed write ends in the same state. Columns that are
not the ledger's are kept as a map of texts.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ledgerloom.operators.align import add_missing, cast_ledger
from ledgerloom.schema import INGESTION_LOG, LEDGER, LOADED_LEDGER, SNAPSHOT, VERSION_MANIFEST
from ledgerloom.session import PACKED

VERSION = "version_id"
PREFIX = "financial_transactions"
NO_VERSION_LABEL = "v20251101_091324"  # fixed value: shown while there is no version
MEGABYTE = 1024 * 1024
MIGRATION_SOURCE = "migration_from_existing_db"
EXTRA = "_extra"
QUARANTINED = "quarantined_"
_PARTS = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "path")])
_SET_ASIDE = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("created", T.TimestampNTZType()),
        T.StructField("file", T.StringType()),
        T.StructField("records", T.LongType()),
    ]
)
STORED = T.StructType(
    [
        *LOADED_LEDGER.fields,
        T.StructField(EXTRA, T.MapType(T.StringType(), T.StringType())),
        T.StructField(VERSION, T.StringType()),
    ]
)


class VersionNotFound(LookupError):
    """No such version, or none at all."""


def timestamp(value: dt.datetime):
    """A zone-free timestamp literal."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


class VersionStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.data_path = f"{self.root}/data"
        self.manifest_path = f"{self.root}/manifest"
        self.quarantine_path = f"{self.root}/quarantine"
        self.parts_path = f"{self.root}/parts"
        self._declared: list[str] = []

    # --- declaring ---

    def create_table(self, name: str) -> None:
        """Declare the visible rows as a view of the catalog, over two external tables.

        What this store commits later is seen by the view; after commits of another session
        refresh the two tables.
        """
        for suffix, schema, path in (
            ("rows", STORED, self.data_path),
            ("manifest", T.StructType([*VERSION_MANIFEST.fields, STORED[VERSION]]), self.manifest_path),
        ):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name}_{suffix} ({columns}) USING parquet "
                f"OPTIONS (path '{path}')"
            )
            self._declared.append(f"{name}_{suffix}")
        self.spark.sql(
            f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {name}_rows "
            f"WHERE {VERSION} IN (SELECT snapshot_id FROM {name}_manifest)"
        )

    # --- writing ---

    def write_rows(self, rows: DataFrame) -> None:
        """Write rows tagged with ``version_id``. Nothing is visible yet.

        No shuffle: each task writes what it read, so a large file becomes many
        Parquet files in parallel. Each is sorted by account, so that an audit of
        one account can skip most row groups.
        """
        rows = folded(rows)
        local_order = [VERSION, "CodeGrootboekrekening", "Boekdatum"]
        (
            rows.sortWithinPartitions(*[name for name in local_order if name in rows.columns])
            .write.mode("overwrite")
            .options(**PACKED, partitionOverwriteMode="dynamic")
            .partitionBy(VERSION)
            .parquet(self.data_path)
        )

    def written_versions(self, version_ids: Iterable[str]) -> list[str]:
        """Those of the versions that have rows on disk, visible or not."""
        wanted = set(version_ids)
        try:
            listing = (
                self.spark.read.format("binaryFile")
                .option("recursiveFileLookup", "true")
                .option("pathGlobFilter", "*.parquet")
                .load([f"{self.data_path}/{VERSION}={version}" for version in wanted])
            )
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            # Some have no rows and hence no folder: look through what there is.
            try:
                listing = (
                    self.spark.read.format("binaryFile")
                    .option("recursiveFileLookup", "true")
                    .option("pathGlobFilter", "*.parquet")
                    .load(self.data_path)
                )
            except AnalysisException:
                return []
        found = listing.select(
            F.regexp_extract("path", f"{VERSION}=([^/]+)/", 1).alias(VERSION)
        ).distinct()
        return sorted(row[0] for row in found.collect() if row[0] in wanted)

    def version_sizes(self, version_ids: Iterable[str]) -> DataFrame:
        """Rows and bytes of written versions, from file metadata alone."""
        paths = [f"{self.data_path}/{VERSION}={version}" for version in version_ids]
        counts = (
            self.spark.read.option("basePath", self.data_path)
            .schema(STORED)
            .parquet(*paths)
            .groupBy(VERSION)
            .agg(F.count(F.lit(1)).alias("records_count"))
        )
        listing = (
            self.spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.parquet")
            .load(paths)
            .groupBy(F.regexp_extract("path", f"{VERSION}=([^/]+)/", 1).alias(VERSION))
            .agg(F.sum("length").alias("bytes"))
        )
        return counts.join(listing, VERSION)

    def commit(self, described: DataFrame) -> None:
        """Make versions visible: write their manifest rows."""
        rows = described.select(F.col("snapshot_id").alias(VERSION), *VERSION_MANIFEST.names)
        self._replace(rows, self.manifest_path)
        for table in self._declared:
            self.spark.catalog.refreshTable(table)

    def commit_quarantine(self, written: DataFrame, created: dt.datetime) -> None:
        """Make quarantined records visible: ``name, version, quarantined`` of their exports."""
        rows = written.select(
            F.col("version").alias(VERSION),
            "version",
            timestamp(created).alias("created"),
            F.col("name").alias("file"),
            F.col("quarantined").alias("records"),
        )
        self._replace(rows, self.quarantine_path)

    def commit_parts(self, files: DataFrame) -> None:
        """Note the files ``name, path`` that a version was read from."""
        rows = files.select(VERSION, "name", "path")
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(VERSION).parquet(self.parts_path)

    def write_version(
        self,
        rows: DataFrame,
        version_id: str,
        created: dt.datetime,
        source_file: str,
        operation: str = "append",
    ) -> None:
        """Write one version, in the ledger's types, and commit it."""
        aligned = cast_ledger(add_missing(rows))
        self.write_rows(aligned.withColumn(VERSION, F.lit(version_id)))
        self.commit(
            self.version_sizes([version_id]).select(
                F.col(VERSION).alias("snapshot_id"),
                timestamp(created).alias("created"),
                F.lit(source_file).alias("source_file"),
                F.concat(F.col(VERSION), F.lit(".parquet")).alias("parquet_file"),
                "records_count",
                F.round(F.col("bytes") / MEGABYTE, 2).alias("file_size_mb"),
                F.lit(operation).alias("operation"),
                F.lit([name for name in rows.columns if name != EXTRA]).alias("columns"),
                F.lit(None).cast("string").alias("landed"),
            )
        )

    def migrate(self, table: DataFrame, loaded_at: dt.datetime, version_id: str) -> None:
        """Take over an existing ledger table as the first version."""
        self.write_version(
            migrated(table, loaded_at),
            version_id,
            loaded_at,
            MIGRATION_SOURCE,
            "migrate",
        )

    def load_raw(self, rows: DataFrame, source_name: str, loaded_at: dt.datetime) -> str:
        """Append rows unfiltered, with load metadata. Returns the version, a new one each time."""
        part = re.sub("[^A-Za-z0-9-]+", "-", source_name)
        version_id = f"{PREFIX}_{part}-{uuid.uuid4().hex[:12]}_{loaded_at:%Y%m%d_%H%M%S}"
        stamped = rows.withColumns(load_metadata(F.lit(source_name), loaded_at))
        self.write_version(stamped, version_id, loaded_at, source_name)
        return version_id

    # --- reading ---

    def manifest(self) -> DataFrame:
        """One row per visible version."""
        return self._described(self.manifest_path, VERSION_MANIFEST)

    def parts(self) -> DataFrame:
        """The files ``name, path`` that visible versions were read from."""
        try:
            rows = self.spark.read.schema(T.StructType([*_PARTS.fields, STORED[VERSION]])).parquet(self.parts_path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _PARTS)
        ids = self.manifest().select(F.col("snapshot_id").alias(VERSION))
        return rows.join(ids, VERSION, "left_semi").select(*_PARTS.names)

    def quarantines(self) -> DataFrame:
        """``version, created, file, records``: how many records of an export were not stored."""
        return self._described(self.quarantine_path, _SET_ASIDE)

    def quarantine(self) -> DataFrame:
        """All records that were read and not stored: ``version_id, file, reason, text``."""
        if self.quarantines().isEmpty():
            return self.spark.createDataFrame([], f"{VERSION} string, file string, reason string, text string")
        rows = self.spark.read.schema(STORED).parquet(self.data_path)
        ids = self.quarantines().select(F.concat(F.lit(QUARANTINED), "version").alias(VERSION))
        return self._set_aside(rows.join(ids, VERSION, "left_semi"))

    def quarantine_of(self, version_ids: Iterable[str]) -> DataFrame:
        """Of some versions' exports, committed or not."""
        paths = [f"{self.data_path}/{VERSION}={QUARANTINED}{version}" for version in version_ids]
        return self._set_aside(
            self.spark.read.option("basePath", self.data_path).schema(STORED).parquet(*paths)
        )

    @staticmethod
    def _set_aside(rows: DataFrame) -> DataFrame:
        return rows.select(
            F.substr(VERSION, F.lit(len(QUARANTINED) + 1)).alias(VERSION),
            F.col("_source_file").alias("file"),
            F.try_element_at(EXTRA, F.lit("reason")).alias("reason"),
            F.try_element_at(EXTRA, F.lit("text")).alias("text"),
        )

    def ingestion_log(self) -> DataFrame:
        """One row per ingested export: what the manifest says of it."""
        ingested = self.manifest().where(F.col("landed").isNotNull())
        columns = (
            F.col("created").alias("logged_at"),
            F.col("landed").alias("source_file"),
            F.col("parquet_file").alias("output_file"),
            F.col("records_count").alias("row_count"),
        )
        return ingested.select(*columns)

    def snapshots(self) -> DataFrame:
        """The manifest in the declared snapshot schema."""
        stamp = F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss")
        return self.manifest().withColumn("timestamp", stamp).select(*SNAPSHOT.names)

    def list_versions(self) -> DataFrame:
        """Newest first."""
        return (
            self.manifest()
            .select(
                F.col("snapshot_id").alias("file"),
                F.concat(F.lit(f"{self.data_path}/{VERSION}="), "snapshot_id").alias("path"),
                F.col("file_size_mb").alias("size_mb"),
                "created",
                F.col("created").alias("modified"),
            )
            .where(F.col("file").contains(PREFIX))
            .orderBy(F.col("created").desc(), F.col("file").desc())
        )

    def has(self, version_id: str) -> bool:
        return not self.manifest().where(F.col("snapshot_id") == version_id).isEmpty()

    def read(self, version_id: str) -> DataFrame:
        """Rows of a version; only its own folder is listed and read."""
        if not self.has(version_id):
            raise VersionNotFound(f"Version not found: {version_id}")
        return self._rows_of(version_id)

    def read_some(self, version_id: str, limit: int | None = None) -> DataFrame:
        """As ``read``, limited, and empty if there is no such version."""
        if not self.has(version_id):
            return self.spark.createDataFrame([], LOADED_LEDGER)
        rows = self._rows_of(version_id)
        return rows if limit is None else rows.limit(limit)

    def latest_version(self) -> str:
        """Id of the newest version."""
        return self.newest(self.manifest())

    def read_latest(self) -> DataFrame:
        return self._rows_of(self.latest_version())

    def read_all(self, version_ids: Iterable[str] | None = None) -> DataFrame:
        """Rows of all visible versions, or of the named ones, with ``version_id`` and the
        columns of their own as ``_extra``."""
        visible = self.manifest()
        if version_ids is not None:
            wanted = sorted(version_ids)
            visible = visible.where(F.col("snapshot_id").isin(wanted))
            found = {row.snapshot_id for row in visible.select("snapshot_id").collect()}
            if missing := sorted(set(wanted) - found):
                raise VersionNotFound(f"Version not found: {missing[0]}")
        return self.read_of(visible)

    def read_of(self, manifest: DataFrame) -> DataFrame:
        """Rows of the versions in (a part of) the manifest.

        A join on the partition column: versions that it does not name, such as those of an
        unfinished write, are pruned and not read.
        """
        try:
            rows = self.spark.read.schema(STORED).parquet(self.data_path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], STORED)
        ids = manifest.select(F.col("snapshot_id").alias(VERSION))
        return rows.join(ids, VERSION, "left_semi").select(*STORED.names)

    def data_label(self) -> str:
        """``v<date>_<time>`` of the newest version, from its name."""
        newest = self.manifest().agg(
            F.max_by("snapshot_id", F.struct("created", "snapshot_id")).alias("newest")
        )
        label = F.regexp_extract("newest", r"([^_]+_[^_]+)$", 1)
        return newest.select(
            F.coalesce(F.concat(F.lit("v"), label), F.lit(NO_VERSION_LABEL))
        ).first()[0]

    @staticmethod
    def newest(manifest: DataFrame) -> str:
        newest = manifest.agg(F.max_by("snapshot_id", F.struct("created", "snapshot_id"))).first()[0]
        if newest is None:
            raise VersionNotFound("No data available")
        return newest

    # --- details ---

    def _rows_of(self, version_id: str) -> DataFrame:
        """A version with its own columns, in its folder alone."""
        path = f"{self.data_path}/{VERSION}={version_id}"
        rows = self.spark.read.option("basePath", self.data_path).schema(STORED).parquet(path)
        known = self.manifest().where(F.col("snapshot_id") == version_id).select("columns")
        extras = [name for name in known.first()[0] or [] if name not in LOADED_LEDGER.names]
        return rows.select(
            *LOADED_LEDGER.names, *[F.try_element_at(F.col(EXTRA), F.lit(n)).alias(n) for n in extras]
        )

    def _described(self, path: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path).select(*schema.names)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _replace(self, rows: DataFrame, path: str) -> None:
        (
            rows.coalesce(1)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(VERSION)
            .parquet(path)
        )


def load_metadata(source_file, loaded_at: dt.datetime) -> dict:
    """Load columns; the data version is the load time in epoch seconds."""
    return {
        "_loaded_at": timestamp(loaded_at),
        "_source_file": source_file,
        "_data_version": F.lit(int(loaded_at.replace(tzinfo=dt.timezone.utc).timestamp())).cast(
            "bigint"
        ),
    }


def folded(rows: DataFrame, besides: tuple[str, ...] = ()) -> DataFrame:
    """Columns that are not the ledger's, and not ``besides``, as one map of texts, without nulls."""
    extras = [n for n in rows.columns if n not in (*LOADED_LEDGER.names, VERSION, EXTRA, *besides)]
    if EXTRA in rows.columns and not extras:
        return rows
    pairs = [part for n in extras for part in (F.lit(n), F.col(f"`{n}`").cast("string"))]
    folded_map = F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string, string>)")
    given = F.map_filter(folded_map, lambda _, value: value.isNotNull())
    return rows.withColumn(EXTRA, given).drop(*extras)


def migrated(table: DataFrame, loaded_at: dt.datetime) -> DataFrame:
    """An existing table's rows in the ledger's columns and types, as version 1."""
    metadata = load_metadata(F.lit(MIGRATION_SOURCE), loaded_at)
    metadata["_data_version"] = F.lit(1).cast("bigint")
    return table.select(
        *[F.col(field.name).try_cast(field.dataType).alias(field.name) for field in LEDGER]
    ).withColumns(metadata)
