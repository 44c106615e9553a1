"""Incremental ingestion: files are picked up as they land."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.ingest import ingest_exports, new_parts
from ledgerloom.session import shared_folder
from ledgerloom.sources.files import FILE_GLOB, exports, path_part, source_name
from ledgerloom.sources.store import VersionStore

# The columns of Spark's binary file source.
FILE = "path string, modificationTime timestamp, length bigint, content binary"


def ingest_available(
    store: VersionStore,
    folder: str,
    checkpoint: str,
    stream: str = "landing",
    clock: Callable[[], dt.datetime] = dt.datetime.now,
) -> None:
    """Ingest everything that landed since the last run, then stop.

    The stream carries file names, not contents. All that is new is one batch, so that an
    export in many parts becomes one version, and is ingested as one job, whatever the
    headers. Files that visible versions were read from, here or in a batch run, are left out; those
    of an export that land later become a further version of it. A batch repeated after a failure writes the same version ids and so replaces what it left.
    """
    query = (
        _arrivals(store, folder)
        .writeStream.foreachBatch(_ingest_batch(store, stream, clock))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _arrivals(store: VersionStore, folder: str) -> DataFrame:
    return (
        store.spark.readStream.format("binaryFile")
        .schema(FILE)
        .option("pathGlobFilter", FILE_GLOB)
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select(
            source_name(F.col("path"), path_part(store.spark, folder)).alias("name"),
            "path",
            F.lit(path_part(store.spark, folder)).alias("root"),
        )
    )


def _ingest_batch(store: VersionStore, stream: str, clock: Callable[[], dt.datetime]):
    def ingest(files: DataFrame, batch: int) -> None:
        shared_folder(store.spark)
        wanted = new_parts(files, store).checkpoint()
        sources = exports(store.spark, wanted)
        if sources:
            ingest_exports(store, sources, clock(), f"{stream}_b{batch}", wanted)

    return ingest
