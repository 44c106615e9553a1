"""What is shuffled and saved on the way: narrow rows, once, and no longer than needed."""

import datetime as dt
import glob
import gzip
import json

import pytest

from ledgerloom.plans.ingest import ingest_folder
from ledgerloom.plans.staging import stage
from ledgerloom.registry import inputs, queries
from ledgerloom.session import new_folder, shared_folder
from ledgerloom.sources import files
from ledgerloom.sources.sample import ledger
from ledgerloom.sources.store import VersionStore


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Order lines of seven years, one without an order; some values are null."""
    folder = str(tmp_path_factory.mktemp("tables"))
    write = lambda rows, columns, name: spark.createDataFrame(rows, columns).coalesce(1).write.parquet(
        f"{folder}/{name}.parquet"
    )
    customers = [(k, f"Customer#{k}", k % 3, "BUILDING") for k in range(1, 4)]
    write(customers, "c_custkey long, c_name string, c_nationkey long, c_mktsegment string", "customer")
    orders = [(k, 1 + k % 3, "1-URGENT" if k % 2 else None) for k in range(30)]
    write(orders, "o_orderkey long, o_custkey long, o_orderpriority string", "orders")
    lines = [
        (k, 10 * k, k, n, 100.0 + k, 0.05, None if k == 3 else 0.02, "R" if n == 2 else "N", "O", dt.datetime(1995 + k % 7, 1 + n, 3))
        for k in range(31)
        for n in range(1, 8)
    ]
    write(
        lines,
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_discount double,"
        " l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
        "lineitem",
    )
    return folder


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_joined_once(spark, tables):
    rows = ledger(spark, tables)
    assert rows.count() == 210
    last_join = next(line for line in plan(rows).splitlines() if "Join" in line)
    assert "l_orderkey" in last_join


def test_saved_ledger_is_what_was_derived(spark, tables):
    saved, derived = inputs.saved_ledger(spark, tables), ledger(spark, tables)
    assert saved.exceptAll(derived).isEmpty() and derived.exceptAll(saved).isEmpty()


def test_mart_shuffles_no_ids_and_classes(spark, tables):
    """They are added to the rows that the running balance was made of."""
    details = queries.transaction_details(stage(inputs.saved_ledger(spark, tables)), queries.AS_OF)
    shown = plan(details)
    above, _, below = shown.partition("Window [")
    assert below, shown
    assert all(name in above and name not in below for name in ("transaction_id", "day_of_week")), shown


def test_slices_have_the_wanted_columns_and_salted_rows_go(spark, tables):
    base = shared_folder(spark).removeprefix("file:")
    found = lambda kind: {p for p in glob.glob(f"{base}/**/{kind}-*", recursive=True)}
    before = found("slices"), found("rdd")
    rows = queries.running_balance_sliced(spark, tables)
    assert rows.count() == 210
    slices = found("slices") - before[0]
    assert len(slices) == 1 and not found("salted")
    assert "account_name" not in spark.read.parquet(slices.pop()).columns
    assert len(found("rdd") - before[1]) <= 1  # the hot accounts


def test_exports_packed_by_gzip(spark, tmp_path):
    """As single files and as parts, with their names in any case, beside plain ones."""
    head = "CodeGrootboekrekening,Boekdatum,Debet,Credit\n"
    (tmp_path / "A.CSV.gz").write_bytes(gzip.compress(f"{head}1,2020-01-02,1.5,\n".encode()))
    (tmp_path / "a.csv").write_text(f"{head}2,2020-01-02,2.5,\n2,soon,1,1\n")
    (tmp_path / "b.json").mkdir()
    record = '{"CodeGrootboekrekening": "3", "Boekdatum": "2020-01-02", "Debet": 3, "Credit": 1%s}\n'
    lines = (record % "") + (record % ', "Own": "x"') + "broken\n"
    (tmp_path / "b.json" / "part-0.json.gz").write_bytes(gzip.compress(lines.encode()))
    store = VersionStore(spark, new_folder(spark, "store"))
    found = {r.file: r for r in ingest_folder(store, str(tmp_path), dt.datetime(2021, 1, 1)).collect()}
    assert {k: (r.status, r.row_count, r.rejected) for k, r in found.items()} == {
        "A.CSV.gz": ("processed", 1, 0), "a.csv": ("processed", 1, 1), "b.json": ("processed", 2, 1),
    }
    rows = {(r._source_file, r.CodeGrootboekrekening, float(r.Debet)) for r in store.read_all().collect()}
    assert rows == {("A.CSV.gz", "1", 1.5), ("a.csv", "2", 2.5), ("b.json", "3", 3.0)}
    undated = store.quarantine().where("reason = 'No valid date'").collect()
    assert [json.loads(r.text)["Boekdatum"] for r in undated] == ["soon"]
    assert ingest_folder(store, str(tmp_path), dt.datetime(2021, 1, 2)).where("status <> 'skipped'").isEmpty()


def test_landed_texts_are_packed(spark, tables):
    faulty = inputs.faulty_landing(spark, tables).removeprefix("file:")
    landing = inputs.landing(spark, tables).removeprefix("file:")
    texts = [p for f in (faulty, landing) for p in glob.glob(f"{f}/**/part-*", recursive=True) if ".parquet" not in p]
    assert texts and all(p.endswith(".gz") for p in texts)
    # Nobody waits for a single task: as many parts as the rows have.
    parts = spark.read.parquet(f"{faulty}/DOUBLE.parquet").inputFiles()
    assert len(glob.glob(f"{faulty}/FAULTY.CSV/part-*")) == len(parts)


def test_keys_are_of_all_records(spark, tmp_path):
    (tmp_path / "a.json").write_text("".join('{"a": %d, "b": %d}\n' % (k, k) for k in range(5000)) + '{"c": 1}\nx\n')
    [export] = files.exports(spark, files.discover(spark, str(tmp_path)))
    assert export.columns == ("a", "b", "c")
