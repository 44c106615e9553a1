"""What the text operators share: words, and helpers for writing and rereading."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import _folders, forget, new_folder, saved, without_leftovers  # noqa: F401

# A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def text_of(name: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


class Bucketed:
    """A frame written to the shared folder by the hash of a column, so that joins and groups by
    that column need not shuffle it."""

    def __init__(self, frame: DataFrame, column: str, least: int = 32):
        self.spark = frame.sparkSession
        self.name = f"bucketed_{uuid.uuid4().hex}"
        path = new_folder(self.spark, "bucketed")
        buckets = max(least, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        with without_leftovers(self.spark):
            writer = frame.write.bucketBy(buckets, column).option("path", path).format("parquet")
            writer.saveAsTable(self.name)
        self._rows = self.spark.table(self.name)
        _folders[self._rows] = path

    def table(self) -> DataFrame:
        return self._rows

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        forget(self._rows)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/embeddings.parquet")
