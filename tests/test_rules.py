import datetime as dt

import pytest

from ledgerloom.functions.rules import (
    apply_rules,
    check_account_code,
    check_amount,
    check_date,
    check_email,
    check_text,
    display_text,
)
from ledgerloom.plans import quality

TODAY = dt.date(2024, 6, 30)


def judged(spark, values, rule):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    found = apply_rules(rows, {"x": rule}).orderBy("i").collect()
    return [(r.clean_x, r.error_x) for r in found]


def test_amounts(spark):
    values = [
        "€ 1,234.50", "-5", "abc", None, "1000000000000", "999999999999.99", " $ 1 000 ", "1e3",
        "", ".5", "5.", "1e40", "-inf", "nan", "1_000", "0.001", "1.2.3",
    ]
    found = judged(spark, values, check_amount("x"))
    too_large = "Amount exceeds maximum allowed value"
    errors = {
        2: "Invalid amount format: abc", 3: "Amount cannot be empty", 4: too_large,
        8: "Invalid amount format: ", 11: too_large, 12: too_large,
        13: "Invalid amount format: nan", 16: "Invalid amount format: 1.2.3",
    }
    assert {i: e for i, (_, e) in enumerate(found) if e} == errors
    good = {i: float(v) for i, (v, e) in enumerate(found) if e is None}
    assert good == {
        0: 1234.5, 1: -5, 5: 999999999999.99, 6: 1000, 7: 1000, 9: 0.5, 10: 5, 14: 1000, 15: 0.001,
    }
    assert all(v is None for v, e in found if e)


def test_negative_amounts_can_be_refused(spark):
    found = judged(spark, ["-5", "-0", "5", "-1e40"], check_amount("x", allow_negative=False))
    negative = "Negative amounts are not allowed"
    assert [e for _, e in found] == [negative, None, None, negative]


def test_codes(spark):
    values = [" ab-1 ", "a", "x" * 21, "a b", "", None, "  ", "80.1", "y" * 20]
    assert judged(spark, values, check_account_code("x")) == [
        ("AB-1", None),
        (None, "Account code must be 2-20 characters long"),
        (None, "Account code must be 2-20 characters long"),
        (None, "Account code contains invalid characters"),
        (None, "Account code cannot be empty"),
        (None, "Account code cannot be empty"),
        (None, "Account code contains invalid characters"),
        ("80.1", None),
        ("Y" * 20, None),
    ]


def test_dates(spark):
    values = [
        "2020-12-31", "31/12/2020", "12/31/2020", "2020-12-31 23:59:59", "13/13/2020", "5/4/2020",
        " 2020-1-2 ", "2024-02-30", "2024-07-01", "1899-12-31", "", None, "20-01-01", "x",
    ]
    found = judged(spark, values, check_date("x", dt.date(1900, 1, 1), TODAY))
    last = dt.date(2020, 12, 31)
    assert [v for v, _ in found] == [
        last, last, last, last, None, dt.date(2020, 4, 5), dt.date(2020, 1, 2), None, None, None,
        None, None, None, None,
    ]
    assert [e for _, e in found[7:]] == [
        "Invalid date format: 2024-02-30", "Date cannot be after 2024-06-30",
        "Date cannot be before 1900-01-01", "Date cannot be empty", "Date cannot be empty",
        "Invalid date format: 20-01-01", "Invalid date format: x",
    ]


def test_texts(spark):
    values = [" <b>\"R&D\"</b> 'x' ", None, " \t", "abcdef"]
    assert judged(spark, values, check_text("x", 0, 100))[:3] == [
        ("&lt;b&gt;&quot;R&amp;D&quot;&lt;/b&gt; &#x27;x&#x27;", None), ("", None), ("", None),
    ]
    assert judged(spark, values, check_text("x", 1, 100, allow_html=True))[0] == ("bR&D/b x", None)
    errors = [e for _, e in judged(spark, values, check_text("x", 1, 5))]
    short = "Text must be at least 1 characters long"
    assert errors == ["Text cannot exceed 5 characters", short, short,
                      "Text cannot exceed 5 characters"]


def test_emails(spark):
    values = [" Ann@Mail.COM ", "a@b", "a b@c.de", "", None]
    assert judged(spark, values, check_email("x")) == [
        ("ann@mail.com", None), (None, "Invalid email format"), (None, "Invalid email format"),
        (None, "Email cannot be empty"), (None, "Email cannot be empty"),
    ]


def test_display_text(spark):
    rows = spark.createDataFrame([("<i>'&",), (None,)], "x string")
    assert [r[0] for r in rows.select(display_text("x")).collect()] == ["&lt;i&gt;&#x27;&amp;", ""]


@pytest.fixture(scope="module")
def transactions(spark):
    return spark.createDataFrame(
        [
            (1, "ab", "2024-01-02", "ok", "1.00", None, "k"),
            (2, None, "", None, None, None, "k"),
            (3, "a b", "2025-01-01", "  ", "x", "2", "k"),
            (4, "80", "2024-01-02", "<b>", "x", None, "k"),
        ],
        "id int, account_code string, transaction_date string, description string, "
        "debit_amount string, credit_amount string, other string",
    )


def test_transaction_rules(transactions):
    checked = quality.validate_transactions(transactions, TODAY)
    errors = {r.id: r.errors for r in checked.collect()}
    assert errors == {
        1: [],
        2: [
            "Missing required field: account_code",
            "Missing required field: transaction_date",
            "Missing required field: description",
            "Account code: Account code cannot be empty",
            "Transaction date: Date cannot be empty",
            "Description: Text must be at least 1 characters long",
            "At least one amount field (debit, credit, or net) must be provided",
        ],
        3: [
            "Account code: Account code contains invalid characters",
            "Transaction date: Date cannot be after 2024-06-30",
            "Description: Text must be at least 1 characters long",
            "debit_amount: Invalid amount format: x",
        ],
        4: [
            "debit_amount: Invalid amount format: x",
            "At least one amount field (debit, credit, or net) must be provided",
        ],
    }
    valid = quality.valid_records(checked)
    assert valid.columns == transactions.columns
    row = valid.first()
    assert (row.account_code, row.transaction_date, row.other) == ("AB", dt.date(2024, 1, 2), "k")
    invalid = quality.invalid_records(checked)
    assert invalid.columns == [*transactions.columns, "errors"] and invalid.count() == 3


def test_summary_adds_up_and_knows_nothing(transactions):
    checked = quality.validate_transactions(transactions, TODAY)
    row = quality.validation_summary(checked).first()
    assert tuple(row) == (4, 1, 3, 13, 0.25)
    assert tuple(quality.validation_summary(checked.where("id > 9")).first()) == (0, 0, 0, 0, 0.0)
    counts = {r.error: r.records for r in quality.error_counts(checked).collect()}
    assert sum(counts.values()) == 13


def test_report_shows_the_first_and_counts_the_rest(transactions):
    checked = quality.validate_transactions(transactions, TODAY)
    shown = quality.validation_report(checked, [checked.id.asc()], shown=2).collect()
    assert [(r.id, r.more_invalid) for r in shown] == [(2, 1), (3, 1)]


def test_filters_on_errors_do_not_repeat_the_rules(transactions):
    valid = quality.valid_records(quality.validate_transactions(transactions, TODAY))
    plan = valid._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate"):]
    assert below.count("gettimestamp") == 4


def test_missing_columns_are_errors(spark):
    rows = spark.createDataFrame([("80", "n")], "account_code string, account_name string")
    errors = quality.validate_transactions(rows, TODAY).first().errors
    assert errors == [
        "Missing required field: transaction_date", "Missing required field: description",
        "At least one amount field (debit, credit, or net) must be provided",
    ]
    assert quality.validate_accounts(rows.drop("account_code")).first().errors == [
        "Missing required field: account_code"
    ]


def test_account_rules(spark):
    rows = spark.createDataFrame(
        [("80", "n" * 201, "1", None), ("8", None, "x", "1"), ("80", "ok", None, "5")],
        "account_code string, account_name string, total_debit string, net_balance string",
    )
    assert [r.errors for r in quality.validate_accounts(rows).collect()] == [
        ["Account name: Text cannot exceed 200 characters"],
        [
            "Account code: Account code must be 2-20 characters long",
            "Account name: Text must be at least 1 characters long",
            "total_debit: Invalid amount format: x",
        ],
        [],
    ]
