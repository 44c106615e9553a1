import datetime as dt

import pytest

from ledgerloom.operators.filters import FilterSpec, SourceSelection, anti_join, is_among


@pytest.fixture(scope="module")
def rows(spark):
    return spark.sql(
        "select * from values "
        "(1, 2021, 1, 3, '80', 'Large', date'2021-03-01', 'Rent March', 'a'), "
        "(2, 2022, 2, 4, '81', 'Small', date'2022-04-01', 'rent April', 'b'), "
        "(3, 2022, 3, 7, '80', 'Medium', date'2022-07-01', cast(null as string), 'c') "
        "as t(id, transaction_year, transaction_quarter, transaction_month, account_code, "
        "amount_category, transaction_date, description, source_file)"
    )


def ids(frame):
    return sorted(r.id for r in frame.collect())


@pytest.mark.parametrize(
    "spec, kept",
    [
        (FilterSpec(), [1, 2, 3]),
        (FilterSpec(years=[2022]), [2, 3]),
        (FilterSpec(years={2022}, months={7}, account_codes={"80"}), [3]),
        (FilterSpec(quarters={1, 2}), [1, 2]),
        (FilterSpec(amount_categories={"Large", "Medium"}), [1, 3]),
        (FilterSpec(search_term=" RENT "), [1, 2]),
        (FilterSpec(search_term="   "), [1, 2, 3]),
        (FilterSpec(date_range=(dt.date(2021, 3, 1), dt.date(2022, 4, 1))), [1, 2]),
        (FilterSpec(account_codes={"'; DROP TABLE t; --"}), []),
    ],
)
def test_parts_are_combined(rows, spec, kept):
    assert ids(spec.apply(rows)) == kept


def test_emptiness():
    assert FilterSpec().is_empty() and FilterSpec(search_term=" ").is_empty()
    for spec in (
        FilterSpec(years={2023}),
        FilterSpec(account_codes={"80"}),
        FilterSpec(amount_categories={"Large"}),
        FilterSpec(search_term="x"),
    ):
        assert not spec.is_empty()


@pytest.mark.parametrize(
    "bad", [{"years": [1899]}, {"months": [13]}, {"quarters": [0]}, {"years": [2020, "x"]}]
)
def test_arguments_are_checked(bad):
    with pytest.raises(ValueError):
        FilterSpec(**bad)


def test_selecting_no_source_differs_between_query_and_rows(rows):
    some = SourceSelection.of(["a", "b"], ["a", "b", "c"])
    everything = SourceSelection.of(["a", "b", "c"], ["a", "b", "c"])
    nothing = SourceSelection.of([], ["a", "b", "c"])
    assert ids(some.apply(rows)) == ids(some.keep_rows(rows)) == [1, 2]
    assert ids(everything.apply(rows)) == ids(everything.keep_rows(rows)) == [1, 2, 3]
    assert ids(nothing.apply(rows)) == [1, 2, 3]
    assert ids(nothing.keep_rows(rows)) == []
    assert ids(nothing.keep_rows(rows.drop("source_file"))) == [1, 2, 3]


def test_long_lists_are_joined(rows):
    found = is_among(rows, "account_code", [str(n) for n in range(79, 5000)])
    assert ids(found) == [1, 2, 3]
    assert "Join" in found._jdf.queryExecution().optimizedPlan().toString()


def test_names_are_compared_whole(spark):
    landed = spark.createDataFrame([("a.xlsx",), ("data.xlsx",)], "name string")
    known = spark.createDataFrame([("data.xlsx",)], "name string")
    assert [r.name for r in anti_join(landed, known, "name").collect()] == ["a.xlsx"]
