"""Record rules as column expressions.

A rule reads one column. ``apply_rules`` adds, for each named rule, the cleaned
value, NULL if the rule is broken, and the error, NULL if it is kept.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import column

# Limits, patterns and messages of the rules.
MAX_AMOUNT = "999999999999.99"
AMOUNT_TYPE = "decimal(38,10)"
AMOUNT_NOISE = ",$€£¥ _"
AMOUNT_SYNTAX = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
AMOUNT_INFINITE = r"^[+-]?(?i:inf|infinity)$"
CODE_SYNTAX = r"^[A-Z0-9.-]+$"
EMAIL_SYNTAX = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
DATE_FORMATS = (
    (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "yyyy-M-d"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d/M/yyyy"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/yyyy"),
    (
        r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$",
        "yyyy-M-d H:m:s",
    ),
)
HTML_ENTITIES = (
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    ('"', "&quot;"),
    ("'", "&#x27;"),
)


# What counts as white space at either end of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

CLEAN, ERROR = "clean_", "error_"


@dataclass(frozen=True)
class Rule:
    """How to prepare a column's text, parse it, and judge the outcome."""

    raw: Column
    text: Column
    parse: Callable[[Column], Column]
    judge: Callable[[Column, Column, Column], Column]  # raw, text, parsed -> error


def apply_rules(frame: DataFrame, rules: Mapping[str, Rule]) -> DataFrame:
    """Adds ``clean_<name>`` and ``error_<name>`` for each rule.

    Each step is a projection of its own, which the optimizer leaves apart where
    a result is used more than once. The last step goes through a one-element
    array: a filter on the errors would otherwise be pushed below all steps and
    repeat their expressions, once per use.
    """
    text = {f"_text_{name}": rule.text for name, rule in rules.items()}
    parsed = {f"_parsed_{name}": rule.parse(F.col(f"_text_{name}")) for name, rule in rules.items()}
    errors = {
        f"_error_{name}": rule.judge(rule.raw, F.col(f"_text_{name}"), F.col(f"_parsed_{name}"))
        for name, rule in rules.items()
    }
    outcome = []
    for name in rules:
        kept = F.when(F.col(f"_error_{name}").isNull(), F.col(f"_parsed_{name}"))
        outcome += [
            kept.alias(f"{CLEAN}{name}"),
            F.col(f"_error_{name}").alias(f"{ERROR}{name}"),
        ]
    return (
        frame.withColumns(text)
        .withColumns(parsed)
        .withColumns(errors)
        .select(
            *[F.col(f"`{name}`") for name in frame.columns],
            F.inline(F.array(F.struct(*outcome))),
        )
    )


def stripped(value: Column | str) -> Column:
    """Without white space, of any kind, at either end."""
    return F.btrim(column(value).cast("string"), F.lit(WHITE_SPACE))


def _is_empty(raw: Column) -> Column:
    return raw.isNull() | (raw.cast("string") == "")


def check_amount(value: Column | str, allow_negative: bool = True) -> Rule:
    raw = column(value).cast("string")

    def judge(raw: Column, text: Column, amount: Column) -> Column:
        infinite = text.rlike(AMOUNT_INFINITE)
        # Well-formed but wider than the type is too large as well.
        largest = F.lit(MAX_AMOUNT).cast(AMOUNT_TYPE)
        error = F.when(raw.isNull(), "Amount cannot be empty").when(
            ~(text.rlike(AMOUNT_SYNTAX) | infinite),
            F.concat(F.lit("Invalid amount format: "), raw),
        )
        if not allow_negative:
            below = (amount < 0) | (amount.isNull() & text.startswith("-"))
            error = error.when(below, "Negative amounts are not allowed")
        return error.when(
            infinite | amount.isNull() | (F.abs(amount) > largest),
            "Amount exceeds maximum allowed value",
        )

    return Rule(
        raw,
        F.translate(stripped(raw), AMOUNT_NOISE, ""),
        lambda text: text.try_cast(AMOUNT_TYPE),
        judge,
    )


def check_account_code(value: Column | str) -> Rule:
    raw = column(value).cast("string")

    def judge(raw: Column, text: Column, code: Column) -> Column:
        return (
            F.when(_is_empty(raw), "Account code cannot be empty")
            .when(~code.rlike(CODE_SYNTAX), "Account code contains invalid characters")
            .when(~F.length(code).between(2, 20), "Account code must be 2-20 characters long")
        )

    return Rule(raw, F.upper(stripped(raw)), lambda text: text, judge)


def check_date(
    value: Column | str,
    earliest: dt.date | None = None,
    latest: dt.date | None = None,
    typed: bool = False,
) -> Rule:
    """``typed`` columns hold dates or timestamps, others text in one of four formats."""
    raw = column(value)

    def parse(text: Column) -> Column:
        if typed:
            return raw.cast("date")
        return F.coalesce(
            *[
                F.when(text.rlike(syntax), F.try_to_timestamp(text, F.lit(form)).cast("date"))
                for syntax, form in DATE_FORMATS
            ]
        )

    def judge(raw: Column, text: Column, day: Column) -> Column:
        error = F.when(_is_empty(raw), "Date cannot be empty").when(
            day.isNull(), F.concat(F.lit("Invalid date format: "), raw.cast("string"))
        )
        if earliest is not None:
            error = error.when(day < F.lit(earliest), f"Date cannot be before {earliest}")
        if latest is not None:
            error = error.when(day > F.lit(latest), f"Date cannot be after {latest}")
        return error

    return Rule(raw, stripped(raw), parse, judge)


def check_text(
    value: Column | str, shortest: int = 0, longest: int = 1000, allow_html: bool = False
) -> Rule:
    raw = column(value).cast("string")

    def judge(raw: Column, text: Column, clean: Column) -> Column:
        length = F.length(text)
        return F.when(
            length < shortest, f"Text must be at least {shortest} characters long"
        ).when(length > longest, f"Text cannot exceed {longest} characters")

    return Rule(
        raw,
        F.coalesce(stripped(raw), F.lit("")),
        lambda text: without_markup(text if allow_html else escape_html(text)),
        judge,
    )


def check_email(value: Column | str) -> Rule:
    raw = column(value).cast("string")

    def judge(raw: Column, text: Column, email: Column) -> Column:
        return F.when(_is_empty(raw), "Email cannot be empty").when(
            ~email.rlike(EMAIL_SYNTAX), "Invalid email format"
        )

    return Rule(raw, F.lower(stripped(raw)), lambda text: text, judge)


def escape_html(value: Column) -> Column:
    for character, entity in HTML_ENTITIES:
        value = F.replace(value, F.lit(character), F.lit(entity))
    return value


def without_markup(value: Column) -> Column:
    return F.translate(value, "<>\"'", "")


def display_text(value: Column | str) -> Column:
    """Safe to show in a page; NULL shows as nothing."""
    return F.coalesce(without_markup(escape_html(column(value).cast("string"))), F.lit(""))
