"""Small relational helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beside(*one_row_frames: DataFrame) -> DataFrame:
    """One row holding the columns of several one-row frames.

    Stacks the rows and takes each column's only value, so nothing is joined.
    """
    stacked = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), one_row_frames
    )
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])
