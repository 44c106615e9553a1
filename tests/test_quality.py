import pytest
from pyspark.sql import types as T

from ledgerloom.plans import quality


@pytest.fixture(scope="module")
def rows(spark):
    return spark.sql("select * from values (1, 'a'), (1, null), (2, null), (null, null) as t(k, v)")


def test_declared_tests(rows):
    tests = [
        quality.ColumnTest("m", "k", "not_null"), quality.ColumnTest("m", "v", "not_null"),
        quality.ColumnTest("m", "k", "unique"), quality.ColumnTest("m", "v", "unique"),
        quality.ColumnTest("other", "k", "unique"),
    ]
    found = quality.run_tests({"m": rows}, tests).collect()
    assert {(r.column_name, r.test): (r.failures, r.passed) for r in found} == {
        ("k", "not_null"): (1, False), ("v", "not_null"): (3, False),
        ("k", "unique"): (1, False), ("v", "unique"): (0, True),
    }


def test_strict_lists_every_mismatch(rows):
    expected = T.StructType().add("k", "string").add("v", "long").add("absent", "integer")
    with pytest.raises(quality.SchemaMismatch) as error:
        quality.validate_schema(rows, expected, strict=True, source="Rows")
    assert str(error.value).splitlines() == [
        "Rows schema validation failed:",
        "Column 'k': found int, expected string", "Column 'v': found string, expected bigint",
    ]
    same = T.StructType().add("k", "integer")
    assert quality.validate_schema(rows, same, strict=True) is rows


def test_lenient_casts_what_it_can(spark):
    rows = spark.sql("select * from values ('1000', 'x'), ('n/a', 'y') as t(amount, other)")
    expected = T.StructType().add("amount", "double").add("absent", "integer")
    found = quality.validate_schema(rows, expected)
    assert [tuple(r) for r in found.collect()] == [(1000.0, "x"), (None, "y")]
    report = quality.schema_report(rows, expected).collect()
    assert [tuple(r) for r in report] == [("amount", "string", "double", False, 1)]


def test_amounts_become_double_and_labels_stay(spark):
    rows = spark.sql(
        "select cast(9348770.89 as decimal(15,2)) as total_debit, '12.5' as vat_text, "
        "'Large' as amount_category, 'H' as vat_code, 'Net Debit' as account_balance_type, "
        "cast(1 as bigint) as balance, 'x' as name"
    )
    found = quality.standardize_numeric(rows)
    assert tuple(found.first()) == (9348770.89, 12.5, "Large", "H", "Net Debit", 1.0, "x")
    assert dict(found.dtypes)["balance"] == "double"
