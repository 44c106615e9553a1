"""Sliced running totals against a plain loop, with hot keys and copies."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators import paging
from ledgerloom.operators.paging import Level, page
from ledgerloom.operators.prefix import running_total


def skewed(seed, rows=600):
    """A third of the rows are copies of one row, another third has one key."""
    draw = random.Random(seed)
    result = []
    for i in range(rows):
        if i % 3 == 0:
            result.append(("hot", 5, 7))
        elif i % 3 == 1:
            result.append(("hot", draw.randrange(50), draw.randrange(-9, 9)))
        else:
            key = draw.choice(["a", "b", None])
            result.append((key, draw.choice([None, *range(9)]), draw.randrange(-9, 9)))
    draw.shuffle(result)
    return result


def expected(rows):
    result = []
    for key in {k for k, _, _ in rows}:
        total = 0
        for at, value in sorted(
            ((at, v) for k, at, v in rows if k == key),
            key=lambda pair: (pair[0] is None, pair[0] or 0, pair[1]),
        ):
            total += value
            result.append((key, at, value, total))
    return sorted(result, key=repr)


@pytest.mark.parametrize(
    "hot_rows, slice_rows", [(10_000, 100), (100, 40), (100, 1_000), (0, 7)]
)
def test_same_totals_whichever_way(spark, hot_rows, slice_rows):
    rows = skewed(hot_rows + slice_rows)
    frame = spark.createDataFrame(rows, "k string, at int, v bigint").repartition(5)
    order = [F.col("at").asc_nulls_last(), F.col("v").asc()]
    found = running_total(
        frame, ["k"], order, "v", "total", T.LongType(), hot_rows, slice_rows
    ).select("k", "at", "v", "total")
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected(rows)


def test_copies_are_cut_into_several_slices(spark):
    frame = spark.range(1000).select(F.lit("x").alias("k"), F.lit(1).cast("bigint").alias("v"))
    found = running_total(
        frame, ["k"], [F.col("v").asc()], "v", "total", T.LongType(), hot_rows=0, slice_rows=100
    )
    assert sorted(r.total for r in found.collect()) == list(range(1, 1001))


def test_pages(spark):
    frame = spark.range(50).repartition(3)
    order = [F.col("id").desc()]

    def ids(*args):
        return [r.id for r in page(frame, order, *args).collect()]

    assert [len(ids(20, start)) for start in (0, 20, 40)] == [20, 20, 10]
    assert ids(20, 20) == list(range(29, 9, -1))
    assert ids(5, 60) == []
    assert ids(None, 45) == [4, 3, 2, 1, 0]
    assert ids(None, 0) == list(range(49, -1, -1))


@pytest.mark.parametrize("limit, offset", [(3, 0), (3, 4), (5, 9), (50, 0), (2, 11), (None, 7), (4, 12)])
def test_old_days_are_left_out_of_a_page(spark, limit, offset):
    days = ["2024-01-03"] * 5 + ["2023-01-02"] * 4 + [None] * 3
    frame = spark.createDataFrame(list(enumerate(days)), "id int, day string")
    frame = frame.withColumn("day", F.col("day").cast("date"))
    order = [F.col("day").desc_nulls_last(), F.col("id").asc()]
    frame = frame.withColumn("y", F.year("day"))
    found = page(frame, order, limit, offset, [Level(F.col("day"), descending=True)], "y").collect()
    assert [r.id for r in found] == list(range(12))[offset:][:limit]


def test_pages_of_crowded_groups_read_a_slice(spark, monkeypatch):
    """A third of the rows has one account, another third is undated; pages anywhere."""
    monkeypatch.setattr(paging, "SLICE", 10)
    draw = random.Random(3)
    rows = []
    for k in range(400):
        code = "hot" if k % 3 == 0 else draw.choice(["ha", "hb", "x", None])
        day = None if k % 3 == 1 else draw.randrange(3)
        rows.append((code, day, draw.choice([None, *range(-9000, 9000, 3000)]), k))
    frame = spark.createDataFrame(rows, "code string, day int, booking bigint, id int").repartition(3).cache()
    code, day, booking = F.col("code"), F.col("day"), F.col("booking")
    levels = [
        Level(F.substring(code, 1, 1)),
        Level(code),
        Level(day),
        Level(F.shiftright(booking, 12), descending=True),
        Level(booking, descending=True),
    ]
    order = [code.asc_nulls_last(), day.asc_nulls_last(), booking.desc_nulls_last(), F.col("id")]
    last = lambda v, sign=1: (v is None, sign * v if v is not None else 0)
    expected = sorted(rows, key=lambda r: (r[0] is None, r[0] or "", last(r[1]), last(r[2], -1), r[3]))
    for offset in (0, 1, 57, 130, 131, 260, 399, 400):
        for limit in (1, 25):
            found = page(frame, order, limit, offset, levels).collect()
            assert [tuple(r) for r in found] == expected[offset : offset + limit], (offset, limit)
    narrowed, skipped = paging._narrowed(frame, levels, 5, 60, None)
    assert narrowed.count() <= 60 and skipped < 60


def test_a_page_prunes_years(spark, tmp_path):
    rows = spark.range(400).select(F.expr("date_add(date'2020-01-01', cast(id * 5 as int)) as day"), "id")
    rows.withColumn("y", F.year("day")).write.partitionBy("y").parquet(str(tmp_path / "t"))
    frame = spark.read.parquet(str(tmp_path / "t"))
    order = [F.col("day").desc_nulls_last(), F.col("id")]
    found = page(frame, order, 3, 200, [Level(F.col("day"), descending=True)], "y")
    assert [r.id for r in found.collect()] == [199, 198, 197]
    assert "(y#" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
