import datetime as dt
import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from ledgerloom.schema import LOADED_LEDGER  # noqa: E402
from ledgerloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="ledgerloom-tests-"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def ledger_rows(spark):
    """Ledger rows from dicts of ledger columns; the rest is NULL."""
    from decimal import Decimal

    def build(*rows):
        def value(field, row):
            given = row.get(field.name)
            if given is not None and field.dataType.typeName() == "decimal":
                return Decimal(str(given))
            return given

        return spark.createDataFrame(
            [tuple(value(field, row) for field in LOADED_LEDGER) for row in rows], LOADED_LEDGER
        )

    return build


@pytest.fixture
def day():
    return lambda text: dt.date.fromisoformat(text)
