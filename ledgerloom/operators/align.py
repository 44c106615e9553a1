"""Bringing frames of differing columns and types together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.schema import LEDGER, LOADED_LEDGER


def add_missing(rows: DataFrame) -> DataFrame:
    """Absent ledger columns as NULL; the ledger's columns first, extras kept."""
    extras = [name for name in rows.columns if name not in LEDGER.names]
    return rows.select(
        *[
            F.col(field.name) if field.name in rows.columns else _null(field)
            for field in LEDGER
        ],
        *extras,
    )


def _null(field: T.StructField) -> Column:
    return F.lit(None).cast(field.dataType).alias(field.name)


def cast_ledger(rows: DataFrame) -> DataFrame:
    """The ledger's types; a value that does not fit becomes NULL."""
    return rows.withColumns(
        {field.name: F.col(field.name).try_cast(field.dataType) for field in LEDGER}
    )


def union_aligned(frames: list[DataFrame]) -> DataFrame:
    """All rows; columns only some frames have are text, and NULL in the others."""
    known = set(LOADED_LEDGER.names)
    as_text = [
        frame.withColumns(
            {name: F.col(name).cast("string") for name in frame.columns if name not in known}
        )
        if set(frame.columns) - known
        else frame
        for frame in frames
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), as_text)


def union_relaxed(*frames: DataFrame) -> DataFrame:
    """All rows of frames with the same columns, whatever their order.

    A column that is text in one frame is text in the result; numbers of
    different types meet in the wider one.
    """
    names = set(frames[0].columns)
    for frame in frames[1:]:
        if set(frame.columns) != names:
            raise ValueError(f"columns differ: {sorted(names ^ set(frame.columns))}")
    text = {
        field.name
        for frame in frames
        for field in frame.schema
        if isinstance(field.dataType, T.StringType)
    }
    alike = [
        frame.withColumns({name: F.col(name).cast("string") for name in text}) if text else frame
        for frame in frames
    ]
    return reduce(DataFrame.unionByName, alike)
