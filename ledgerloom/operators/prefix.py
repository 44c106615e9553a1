"""Running totals that survive hot groups.

A window over a key puts every row of the key into one task. That is the right
plan while groups are small, and it stays the plan for them here. Rows of a hot
key are instead cut into ordered slices by range partitioning, summed inside
each slice, and shifted by the totals of the slices before.

The slices must not move between the two passes over them, even if an executor
is lost in between, so they are saved in the shared folder. A salt is
saved first: it lets range partitioning cut through rows equal in every
ordering column, and once saved it cannot change on a retry. The rows are saved
with all columns they have: give only those that are wanted.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import PACKED, forget, saved, shared_folder, without_leftovers

HOT_ROWS = 20_000_000
SLICE_ROWS = 5_000_000
MAX_SLICES = 20_000
BROADCAST_ROWS = 200_000

_SALT = "_salt"
_SLICE = "_slice"


def running_total(
    frame: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    value: str,
    out: str,
    result_type: T.DataType,
    hot_rows: int = HOT_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Sum of ``value`` from the first row of the key to the current one.

    A key with more than ``hot_rows`` rows takes the sliced way. Finding such
    keys costs one aggregate over the key columns alone.
    """
    if not keys:
        rows = frame.count()
        if rows <= hot_rows:
            return _plain(frame, keys, order, value, out, result_type)
        return _sliced(frame, keys, order, value, out, result_type, rows, slice_rows)

    shared_folder(frame.sparkSession)
    counted = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    with without_leftovers(frame.sparkSession):
        hot = counted.where(F.col("_rows") > hot_rows).checkpoint()
    found = hot.agg(F.count(F.lit(1)), F.sum("_rows")).first()
    if found[0] == 0:
        return _plain(frame, keys, order, value, out, result_type)

    # At most (all rows / hot_rows) keys, and counted: the hint depends on it.
    hot_keys = hot.select([F.col(key).alias(f"_hot_{key}") for key in keys])
    if found[0] <= BROADCAST_ROWS:
        hot_keys = F.broadcast(hot_keys)
    same = reduce(
        lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"_hot_{key}")) for key in keys]
    )
    ordinary = frame.join(hot_keys, same, "left_anti")
    crowded = frame.join(hot_keys, same, "left_semi")
    return _plain(ordinary, keys, order, value, out, result_type).unionByName(
        _sliced(crowded, keys, order, value, out, result_type, found[1], slice_rows)
    )


def _plain(frame, keys, order, value, out, result_type) -> DataFrame:
    window = (
        Window.partitionBy(*keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return frame.withColumn(out, F.sum(value).over(window).cast(result_type))


def _sliced(frame, keys, order, value, out, result_type, rows, slice_rows) -> DataFrame:
    slices = int(min(MAX_SLICES, max(2, -(-rows // slice_rows))))
    salted = saved(frame.withColumn(_SALT, F.monotonically_increasing_id()), "salted", **PACKED)
    ranges = salted.repartitionByRange(slices, *keys, *order, F.col(_SALT))
    cut = saved(ranges.withColumn(_SLICE, F.spark_partition_id()), "slices", **PACKED)
    forget(salted)

    # One row per key and slice it touches: at most keys + slices rows, and no
    # key has more than ``slices`` of them.
    totals = cut.groupBy(*keys, _SLICE).agg(F.sum(value).alias("_part"))
    if keys:
        before = Window.partitionBy(*keys)
    else:
        before = Window.partitionBy()
    before = before.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(key).alias(f"_of_{key}") for key in keys],
        F.col(_SLICE).alias("_of_slice"),
        F.sum("_part").over(before).alias("_offset"),
    ).where(F.col("_offset").isNotNull())
    # Within a slice only its first key can have begun earlier, so there is at
    # most one offset per slice.
    if slices <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)

    same = reduce(
        lambda a, b: a & b,
        [F.col(key).eqNullSafe(F.col(f"_of_{key}")) for key in keys],
        F.col(_SLICE) == F.col("_of_slice"),
    )
    inside = (
        Window.partitionBy(_SLICE, *keys)
        .orderBy(*order, _SALT)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = F.sum(value).over(inside) + F.coalesce(F.col("_offset"), F.lit(0))
    return (
        cut.join(offsets, same, "left")
        .withColumn(out, running.cast(result_type))
        .select(*frame.columns, out)
    )
