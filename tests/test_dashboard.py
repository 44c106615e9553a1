import datetime as dt
from decimal import Decimal

import pytest

from ledgerloom.operators.filters import FilterSpec, SourceSelection
from ledgerloom.plans.dashboard import Dashboard
from ledgerloom.plans.marts import marts

AS_OF = dt.date(2024, 6, 30)


@pytest.fixture(scope="module")
def rows(ledger_rows):
    def line(code, date, number=1, **amounts):
        return {
            "CodeGrootboekrekening": code, "NaamGrootboekrekening": f"name {code}",
            "Boekdatum": dt.date.fromisoformat(date), "Boekingsnummer": number,
            "_source_file": f"DUMP{date[:4]}.xlsx", **amounts,
        }

    return ledger_rows(
        line("8513", "2024-03-14", Debet=100),
        line("1300", "2024-03-14", Credit=20000),
        line("1520", "2024-02-23", Debet=499.99),
        line("1520", "2024-03-14", Debet=500),
        line("1700", "2022-01-05", Debet=5, Credit=5),
        line("1700", "2024-06-30", 2, Debet=999.99),
        line("1700", "2024-06-30", 2, Credit=999.99),
    )


@pytest.fixture(scope="module")
def board(rows):
    saved = marts(rows, AS_OF)
    return Dashboard(saved.transactions.cache(), saved.accounts.cache(), AS_OF)


def codes(frame):
    return [r.account_code for r in frame.collect()]


def test_accounts_by_balance_and_by_code(board):
    assert codes(board.account_summary()) == ["1300", "1520", "8513", "1700"]
    assert codes(board.top_accounts_by_balance(2)) == ["1300", "1520"]
    assert codes(board.sorted_accounts()) == ["1300", "1520", "1700", "8513"]


def test_a_page_is_cut_by_balance_and_shown_by_code(board):
    page = board.paginated_accounts(1, 2)
    assert codes(page.rows) == ["1520", "8513"] and page.total == 4
    assert codes(board.accounts_slice(1, 2).rows) == ["1520", "1700"]


def test_transactions_newest_first_then_by_account(board):
    rows = board.transaction_details(3).collect()
    assert [str(r.transaction_date) for r in rows] == ["2024-06-30", "2024-06-30", "2024-03-14"]
    limited = board.limited_transactions(6).collect()
    assert [(r.account_code, str(r.transaction_date)) for r in limited] == [
        ("1300", "2024-03-14"), ("1520", "2024-02-23"), ("1520", "2024-03-14"),
        ("1700", "2024-06-30"), ("1700", "2024-06-30"), ("8513", "2024-03-14"),
    ]
    assert board.paginated_transactions(6, 5).rows.count() == 1
    assert board.transactions_slice(2, 2).total == 7


def test_zero_balance_differs_between_mart_and_rollup(board):
    kinds = {r.account_code: r.account_balance_type for r in board.account_summary().collect()}
    assert kinds["1700"] == "Balanced"
    rollup = board.filtered_account_rollup(FilterSpec(years={2024}))
    found = {r.account_code: r for r in rollup.collect()}
    assert found["1700"].account_balance_type == "Net Credit"
    assert found["1700"].net_balance == Decimal("0.00")
    assert found["8513"].account_balance_type == "Net Debit"


def test_dashboard_figures(board):
    row = board.dashboard_stats().first()
    assert (row.total_accounts, row.active_accounts, row.source_files) == (4, 1, 2)
    assert row.total_assets == Decimal("1099.99") and row.total_liabilities == Decimal("20000.00")
    assert (row.total_transactions, row.unique_accounts) == (7, 4)
    assert str(row.earliest_date) == "2022-01-05"


def test_filtered_figures(board):
    row = board.filtered_stats(FilterSpec(months={3})).first()
    assert (row.total_accounts, row.active_accounts, row.total_transactions) == (3, 3, 3)
    assert row.total_assets == Decimal("600.00") and row.total_liabilities == Decimal("20000.00")
    nothing = board.filtered_stats(FilterSpec(years={1999})).first()
    assert set(nothing) == {0, Decimal("0.00")}
    unfiltered = board.filtered_stats(FilterSpec()).first()
    assert unfiltered.total_transactions == 7 and "source_files" not in unfiltered.asDict()


def test_filtered_pages(board):
    spec = FilterSpec(years={2024})
    accounts = board.filtered_paginated_accounts(spec, 1, 2)
    assert codes(accounts.rows) == ["1520", "1700"] and accounts.total == 4
    lines = board.filtered_paginated_transactions(spec, 4, 10)
    assert lines.rows.count() == 2 and lines.total == 6
    assert board.filtered_paginated_accounts(FilterSpec(), 0, 9).total == 4
    assert board.filtered_transactions(FilterSpec(amount_categories={"Large"})).count() == 1


def test_charts(board):
    bins = {r.amount_range: r.n for r in board.amount_histogram().collect()}
    assert bins == {"0-100": 1, "100-500": 2, "500-1000": 3, "1000+": 1}
    empty = Dashboard(board.transactions.limit(0), board.accounts.limit(0), AS_OF)
    assert [r.n for r in empty.amount_histogram().collect()] == [0, 0, 0, 0]
    assert [float(r.volume) for r in board.daily_volume(2).collect()] == [0.0, 499.99]
    kinds = {r.account_type: r.account_count for r in board.balance_type_distribution().collect()}
    assert kinds == {"Balanced": 1, "Net Credit": 1, "Net Debit": 2}
    assert codes(board.balance_chart(3)) == ["1300", "1520", "1700"]


def test_monthly_trends_keep_window_and_limit(board):
    rows = board.monthly_trends(12).collect()
    assert [(r.period, r.transaction_count) for r in rows] == [
        ("2024-06", 2), ("2024-03", 3), ("2024-02", 1),
    ]
    assert [r.period for r in board.monthly_trends(1).collect()] == ["2024-06"]


def test_source_selection_changes_account_figures(rows):
    saved = marts(rows, AS_OF)
    only = SourceSelection.of(["DUMP2022.xlsx"], ["DUMP2022.xlsx", "DUMP2024.xlsx"])
    board = Dashboard(saved.transactions, saved.accounts, AS_OF, only)
    row = board.account_summary().first()
    assert (row.account_code, row.total_transactions) == ("1700", 1)
    assert board.mart_counts().collect()[1]["count"] == 1


def test_last_refresh(rows, board):
    assert board.last_refresh_time().first()[0] is None
    stamp = dt.datetime(2024, 7, 1, 8)
    saved = marts(rows, AS_OF, stamp)
    assert Dashboard(*saved, AS_OF).last_refresh_time().first()[0] == stamp
