"""Session settings, the shared folder for checkpoints and tables, and tables saved there for a while."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
# Of saved tables: about two thirds of the default's bytes.
PACKED = {"compression": "zstd"}

_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str, master: str | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution on; ``settings`` use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", "128m")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master is not None:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, every executor's only common ground.

    Where none is set, a folder in the warehouse, which all executors share as well.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or context.getCheckpointDir()
    if folder is None:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/ledgerloom/{name}-{uuid.uuid4().hex}"


@contextmanager
def without_leftovers(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs run inside go as soon as their job has ended."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def saved(frame: DataFrame, name: str, **options: str) -> DataFrame:
    """The frame, written once to the shared folder and read again.

    Lost executors cannot change what later steps see, and the planner knows its size.
    """
    spark = frame.sparkSession
    path = new_folder(spark, name)
    with without_leftovers(spark):
        frame.write.options(**options).parquet(path)
    result = spark.read.schema(frame.schema).parquet(path)
    _folders[result] = path
    return result


def forget(*frames: DataFrame) -> None:
    """Delete the tables behind frames that ``saved`` returned; nothing may read them any more."""
    for frame in frames:
        path = _folders.pop(frame, None)
        if path is not None:
            jvm = frame.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            settings = frame.sparkSession._jsparkSession.sessionState().newHadoopConf()
            where.getFileSystem(settings).delete(where, True)
