import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import classify
from ledgerloom.plans.accounts import account_balances, account_summary
from ledgerloom.plans.marts import save_marts
from ledgerloom.plans.staging import stage
from ledgerloom.plans.transactions import transaction_details, with_running_balance
from ledgerloom.schema import MONEY

AS_OF = dt.date(2024, 6, 30)


def ago(days):
    return AS_OF - dt.timedelta(days=days)


def line(**changes):
    return {"CodeGrootboekrekening": "80", "NaamGrootboekrekening": "Costs",
            "Boekdatum": AS_OF, "Omschrijving": "text", **changes}


def labels(spark, values, expression, kind=MONEY):
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(
        F.col("v"), F.col("v").cast(kind).alias("x")
    )
    found = {r.v: r.label for r in rows.select("v", expression("x").alias("label")).collect()}
    return [found[v] for v in values]


def test_amount_classes_at_their_bounds(spark):
    values = ["100", "-100.01", "1000", "1000.01", "-5000", "5000.01"]
    assert labels(spark, values, classify.amount_category) == [
        "Minimal", "Small", "Small", "Medium", "Medium", "Large",
    ]


def test_value_and_volume_classes_at_their_bounds(spark):
    assert labels(spark, ["1000", "1000.01", "-10000", "10000.01"], classify.value_category) == [
        "Low Value", "Medium Value", "Medium Value", "High Value",
    ]
    assert labels(spark, ["20", "21", "100", "101"], classify.volume_category, "bigint") == [
        "Low Volume", "Medium Volume", "Medium Volume", "High Volume",
    ]


def test_recency_and_activity_at_their_bounds(spark):
    days = [str(ago(n)) for n in (30, 31, 90, 91, 365, 366)]
    assert labels(spark, days, lambda c: classify.recency_category(c, AS_OF), "date") == [
        "Last 30 days", "Last 90 days", "Last 90 days", "Last year", "Last year",
        "Older than 1 year",
    ]
    assert labels(spark, days[:4], lambda c: classify.activity_status(c, AS_OF), "date") == [
        "Active", "Recently Active", "Recently Active", "Inactive",
    ]


def test_quality_flag_takes_the_first_that_applies(spark):
    rows = spark.sql(
        "select * from values (1, 0, 0, 'x'), (2, 1, 1, ''), (3, 1, 0, cast(null as string)), "
        "(4, 1, 0, '  '), (5, 0, 1, 'x') as t(n, d, c, text)"
    )
    found = rows.select("n", classify.quality_flag("d", "c", "text").alias("flag")).orderBy("n")
    assert [r.flag for r in found.collect()] == [
        "Zero Amount", "Both Debit and Credit", "Missing Description", "Missing Description",
        "Complete",
    ]


def test_row_id_ignores_nulls_and_repeats_for_identical_rows(spark):
    rows = spark.sql("select * from values ('a', 1), ('a', 1), ('a', null), (null, 1) as t(x, y)")
    ids = [r.id for r in rows.select(classify.row_id("x", "y").alias("id")).collect()]
    assert None not in ids and ids[0] == ids[1] and len(set(ids)) == 3


def test_account_with_two_names_shares_the_trend_of_its_code(ledger_rows):
    rows = ledger_rows(
        line(Debet=10, Boekdatum=ago(365)),
        line(Debet=20, Boekdatum=ago(366), NaamGrootboekrekening="Old name"),
        line(Debet=40, Boekdatum=ago(270)),
        line(Debet=80, Boekdatum=ago(271)),
        line(Credit=5, Boekdatum=ago(270)),
    )
    found = {r.account_name: r for r in account_balances(stage(rows), AS_OF).collect()}
    assert set(found) == {"Costs", "Old name"}
    for row in found.values():
        assert row.net_amount_12m == Decimal("125.00") and row.transactions_12m == 4
        assert row.net_amount_4q == Decimal("35.00") and row.years_active == 1
    assert found["Costs"].unique_transaction_dates == 3
    assert found["Costs"].avg_daily_transaction_frequency == pytest.approx(4 / 96)
    assert found["Old name"].avg_daily_transaction_frequency == 1.0


def test_equal_sums_are_balanced_and_high_volume_is_reached(ledger_rows):
    rows = ledger_rows(*[line(Debet=1, Credit=1, Nummer=n) for n in range(101)])
    row = account_summary(account_balances(stage(rows), AS_OF)).first()
    assert row.account_balance_type == "Balanced"
    assert row.transaction_volume_category == "High Volume"
    assert row.balance_value_category == "Low Value"


def test_last_running_balance_is_the_net_balance(ledger_rows):
    rows = ledger_rows(
        line(Debet=1, Boekingsnummer=2, Nummer=1),
        line(Credit=3, Boekingsnummer=1, Nummer=2),
        line(Debet=9, Boekingsnummer=None, Nummer=3),
        line(Debet=5, Boekdatum=ago(1), Boekingsnummer=9, Nummer=4),
        line(Debet=7, CodeGrootboekrekening="81", Nummer=5),
    )
    found = with_running_balance(stage(rows)).collect()
    by_line = {r.number: r.running_balance for r in found}
    assert by_line == {
        4: Decimal("5.00"), 2: Decimal("2.00"), 1: Decimal("3.00"), 3: Decimal("12.00"),
        5: Decimal("7.00"),
    }


def test_details_labels(ledger_rows):
    rows = stage(ledger_rows(line(Debet=1, Boekdatum=dt.date(2024, 3, 3))))
    row = transaction_details(rows, AS_OF).first()
    assert (row.day_of_week, row.day_of_month, row.quarter_label) == ("Sunday", 3, "Q1")


def test_saved_marts_agree_with_each_other(spark, ledger_rows, tmp_path):
    rows = ledger_rows(
        line(Debet=10, Boekdatum=dt.date(2023, 1, 1)),
        line(Credit=4),
        line(Debet=3, CodeGrootboekrekening="81"),
    )
    stamp = dt.datetime(2024, 7, 1, 8)
    saved = save_marts(rows, str(tmp_path), AS_OF, stamp)
    assert saved.transactions.agg(F.sum("net_amount")).first()[0] == Decimal("9.00")
    assert saved.accounts.agg(F.sum("net_balance")).first()[0] == Decimal("9.00")
    assert {r.last_updated for r in saved.accounts.collect()} == {stamp}
    assert len(list(tmp_path.glob("*/mart_transaction_details/transaction_year=2023"))) == 1
    again = save_marts(rows, str(tmp_path), AS_OF, stamp)  # readers of the first are not disturbed
    assert saved.transactions.count() == again.transactions.count() == 3
