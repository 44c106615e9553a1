"""Ordered limit / offset pages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = 20_000  # rows that a page may have to skip or leave; a larger group is looked into


@dataclass(frozen=True)
class Level:
    """What rows are grouped by to find a page, coarsest first; nulls come last.

    The order of a page must begin with the order of the levels: each of them is one of its
    columns, or made from one so that it never turns back, such as the first letters of a text.
    """

    column: Column
    descending: bool = False

    def is_(self, value: object) -> Column:
        return self.column.isNull() if value is None else self.column == F.lit(value)

    def before(self, value: object) -> Column:
        if value is None:
            return self.column.isNotNull()
        return self.column > F.lit(value) if self.descending else self.column < F.lit(value)

    def after(self, value: object) -> Column:
        if value is None:
            return F.lit(False)
        beyond = self.column < F.lit(value) if self.descending else self.column > F.lit(value)
        return beyond | self.column.isNull()


Path = list[tuple[Level, object]]


def page(
    frame: DataFrame,
    order: Sequence[Column],
    limit: int | None = None,
    offset: int = 0,
    levels: Sequence[Level] = (),
    year: str | None = None,
) -> DataFrame:
    """Rows ``offset`` .. ``offset + limit`` of the order; no limit means all.

    ``order`` must be total, or which of the tied rows fall on a page is open.
    With ``levels``, rows are counted by the first of them; the group that the page begins in, and the
    one that it ends in, are counted by the next level, until a group is small. Only the rows
    from the one group to the other are then read and sorted, so that a deep page costs no more
    than a shallow one. ``year`` names the column of the year of the first level, a date, if
    the rows are stored by it.
    """
    if limit is None and not offset:
        return frame.orderBy(*order)
    if levels:
        frame, offset = _narrowed(frame, levels, limit, offset, year)
    rows = frame.orderBy(*order).offset(offset)
    return rows if limit is None else rows.limit(limit)


def _narrowed(
    frame: DataFrame, levels: Sequence[Level], limit: int | None, offset: int, year: str | None
) -> tuple[DataFrame, int]:
    """Rows of the groups that the page lies on, and how many of them come before it."""
    places = [offset] if limit is None else [offset, offset + max(limit, 1) - 1]
    paths: list[Path] = [[] for _ in places]
    open_ = list(range(len(places)))
    for level in levels:
        together = {}
        for end in open_:
            together.setdefault(tuple(value for _, value in paths[end]), []).append(end)
        open_ = []
        for ends in together.values():
            group = frame.where(_all(a.is_(value) for a, value in paths[ends[0]]))
            for end, found in zip(ends, _groups(group, level, [places[end] for end in ends])):
                if found is None:  # behind the last row
                    if end == 0:
                        return frame.limit(0), 0
                    continue
                paths[end].append((level, found["value"]))
                places[end] -= found["before"]
                if found["rows"] > SLICE:
                    open_.append(end)
    first, last = paths[0], paths[-1] if limit is not None else []
    rows = frame.where(_from(first) & _to(last))
    if year is not None and last and first[0][1] is not None and last[0][1] is not None:
        rows = rows.where(F.col(year).between(*sorted((first[0][1].year, last[0][1].year))))
    return rows, places[0]


def _groups(frame: DataFrame, level: Level, places: list[int]) -> list:
    """Of each place in the order: value, rows before and rows of the group that it lies in.

    Counting takes one column and leaves one row per group; one group per place returns."""
    value = F.col("_value")
    order = Window.orderBy(value.desc_nulls_last() if level.descending else value.asc_nulls_last())
    so_far = F.sum("_rows").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = frame.groupBy(level.column.alias("_value")).agg(F.count(F.lit(1)).alias("_rows"))
    counted = counted.withColumn("_end", so_far)
    group = F.struct(
        "_end", (F.col("_end") - F.col("_rows")).alias("before"), F.col("_rows").alias("rows"), value.alias("value")
    )
    found = counted.agg(
        *[F.min(F.when(F.col("_end") > place, group)).alias(f"at{k}") for k, place in enumerate(places)]
    ).first()
    return list(found)


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _from(path: Path) -> Column:
    """Rows of the group or after it."""
    if not path:
        return F.lit(True)
    level, value = path[0]
    return level.after(value) | (level.is_(value) & _from(path[1:]))


def _to(path: Path) -> Column:
    """Rows of the group or before it."""
    if not path:
        return F.lit(True)
    level, value = path[0]
    return level.before(value) | (level.is_(value) & _to(path[1:]))
