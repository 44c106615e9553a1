import datetime as dt
from decimal import Decimal

from ledgerloom.plans.staging import stage

D = dt.date(2024, 2, 29)


def line(**changes):
    return {"CodeGrootboekrekening": "0080", "Boekdatum": D, **changes}


def test_null_amounts_become_zero_and_types_fall_through(ledger_rows):
    rows = ledger_rows(
        line(Nummer=1),
        line(Nummer=2, Debet=5),
        line(Nummer=3, Credit=7),
        line(Nummer=4, Debet=5, Credit=7),
        line(Nummer=5, Debet=0, Credit=0),
        line(Nummer=6, Debet=-3),
    )
    found = {r.number: r for r in stage(rows).collect()}
    assert [found[i].transaction_type for i in range(1, 7)] == [
        "Zero", "Debit", "Credit", "Debit", "Zero", "Zero",
    ]
    assert [found[i].net_amount for i in range(1, 7)] == [
        Decimal(v) for v in ("0.00", "5.00", "-7.00", "-2.00", "0.00", "-3.00")
    ]
    assert found[1].debit_amount == found[1].vat_amount == Decimal("0.00")


def test_rows_without_date_or_account_are_left_out(ledger_rows):
    rows = ledger_rows(line(), line(Boekdatum=None), line(CodeGrootboekrekening=None))
    assert stage(rows).count() == 1


def test_period_parts_and_leading_zeros(ledger_rows):
    row = stage(ledger_rows(line())).first()
    assert (row.transaction_year, row.transaction_quarter, row.transaction_month) == (2024, 1, 2)
    assert row.account_code == "0080"
