import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import timetravel as tt
from ledgerloom.operators.align import union_relaxed
from ledgerloom.schema import LEDGER, LOADED_LEDGER, SNAPSHOT
from ledgerloom.sources.store import VersionNotFound, VersionStore, migrated

JAN, FEB, MAR = (dt.datetime(2024, month, 1, 12) for month in (1, 2, 3))


def line(**changes):
    return {
        "CodeGrootboekrekening": "80", "Boekdatum": dt.date(2023, 5, 1), "Boekingsnummer": 1,
        "_loaded_at": JAN, **changes,
    }


@pytest.fixture(scope="module")
def store(spark, ledger_rows, tmp_path_factory):
    result = VersionStore(spark, str(tmp_path_factory.mktemp("store")))
    first = ledger_rows(
        line(Nummer=1, Debet=1),
        line(Nummer=2, Debet=2),
        line(Boekingsnummer=None, Debet=3),
        line(CodeGrootboekrekening="90", Debet=4),
    )
    second = ledger_rows(
        line(Nummer=7, Debet=10, _loaded_at=FEB),
        line(Boekingsnummer=None, Debet=30, _loaded_at=FEB),
        line(CodeGrootboekrekening="90", Debet=40, _loaded_at=None, Boekdatum=dt.date(2023, 6, 1)),
    )
    result.write_version(first, "financial_transactions_a_20240101_120000", JAN, "a.csv")
    result.write_version(second, "financial_transactions_b_20240201_120000", FEB, "b.csv")
    result.write_version(
        second.limit(0).unionByName(first.limit(1)),
        "financial_transactions_c_20240301_120000", MAR, "c.csv",
    )
    return result


A, B, C = (f"financial_transactions_{n}_2024{m}01_120000" for n, m in
           (("a", "01"), ("b", "02"), ("c", "03")))


def test_versions_are_listed_newest_first(store):
    assert [r.file for r in store.list_versions().collect()] == [C, B, A]
    assert store.latest_version() == C
    assert store.data_label() == "v20240301_120000"
    snapshots = store.snapshots()
    assert snapshots.schema.simpleString() == SNAPSHOT.simpleString()
    assert {r.snapshot_id: r.records_count for r in snapshots.collect()} == {A: 4, B: 3, C: 1}


def test_reading_versions(store):
    assert store.read(A).count() == 4
    assert store.read(A).columns == LOADED_LEDGER.names
    assert store.read_some(A, 2).count() == 2
    assert store.read_some("nope").count() == 0
    with pytest.raises(VersionNotFound):
        store.read("nope")
    with pytest.raises(VersionNotFound):
        store.read_all([A, "nope"])


def test_an_empty_store(spark, tmp_path):
    empty = VersionStore(spark, str(tmp_path / "none"))
    assert empty.manifest().count() == empty.read_all().count() == 0
    assert empty.data_label() == "v20251101_091324"
    assert tt.audit_trail(empty).count() == 0
    with pytest.raises(VersionNotFound):
        empty.latest_version()


def test_rows_without_a_manifest_row_are_not_seen(store, ledger_rows):
    before = store.read_all().count()
    store.write_rows(ledger_rows(line()).withColumn("version_id", F.lit("zz_unfinished")))
    assert store.read_all().count() == before
    assert store.manifest().count() == 3


def test_writing_a_version_again_replaces_it(spark, ledger_rows, tmp_path):
    again = VersionStore(spark, str(tmp_path))
    for _ in range(2):
        again.write_version(ledger_rows(line(), line()), A, JAN, "a.csv")
    assert again.read_all().count() == 2 and again.manifest().count() == 1


@pytest.mark.parametrize(
    "moment, version",
    [(JAN, A), (JAN + dt.timedelta(days=3), A), (FEB, B), (MAR + dt.timedelta(days=99), C)],
)
def test_as_of(store, moment, version):
    assert tt.version_at(store, moment) == version


def test_before_the_first_version_there_is_nothing(store):
    with pytest.raises(VersionNotFound):
        tt.query_at_timestamp(store, JAN - dt.timedelta(seconds=1))
    assert tt.query_at_date(store, JAN.date()).count() == 4


def test_as_of_for_many_moments(spark, store):
    moments = [JAN - dt.timedelta(hours=1), JAN, JAN + dt.timedelta(hours=1), FEB, MAR, None,
               FEB - dt.timedelta(seconds=1), MAR + dt.timedelta(days=400)]
    rows = spark.createDataFrame(list(enumerate(moments)), "i int, at timestamp_ntz")
    found = tt.versions_at(rows, "at", store.manifest()).orderBy("i").collect()
    assert [r.version_id for r in found] == [None, A, A, B, C, None, A, C]


def test_comparison(store):
    row = tt.compare_versions(store, A, B).first()
    assert (row.rows1, row.rows2, row.row_change, row.columns1) == (4, 3, -1, 22)
    assert (row.new_columns, row.removed_columns) == ([], [])
    assert (row.max_date1, row.max_date2) == ("2023-05-01", "2023-06-01")


def test_changes_since(store):
    rows = tt.changes_since(store, A).collect()
    assert [(r.file, r.rows, r.max_date) for r in rows] == [
        (C, 1, "2023-05-01"), (B, 3, "2023-06-01"),
    ]
    assert tt.changes_since(store, C).count() == 0
    with pytest.raises(VersionNotFound):
        tt.changes_since(store, "nope")


def test_date_range(store, spark):
    assert tuple(tt.date_range(store.read(B)).first()) == ("2023-05-01", "2023-06-01")
    assert tuple(tt.date_range(store.read(B).limit(0)).first()) == (None, None)
    assert tuple(tt.date_range(spark.range(3)).first()) == (None, None)


def test_consolidation_keeps_the_last_load_of_each_key(store):
    rows = tt.consolidated_view(store, [A, B]).collect()
    kept = {(r.CodeGrootboekrekening, r.Boekdatum, r.Boekingsnummer): float(r.Debet) for r in rows}
    assert len(rows) == len(kept) == 4
    may, june = dt.date(2023, 5, 1), dt.date(2023, 6, 1)
    assert kept == {
        ("80", may, 1): 10, ("80", may, None): 30, ("90", may, 1): 4, ("90", june, 1): 40,
    }


def test_a_row_without_load_time_wins_and_columns_may_lack(ledger_rows):
    rows = ledger_rows(line(Debet=1), line(Debet=2, _loaded_at=None), line(Debet=3, _loaded_at=MAR))
    assert float(tt.consolidate(rows).first().Debet) == 2
    assert tt.consolidate(rows.drop("Boekingsnummer", "Boekdatum")).count() == 1
    keyless = rows.drop("Boekingsnummer", "Boekdatum", "CodeGrootboekrekening")
    assert tt.consolidate(keyless).count() == 3


def test_consolidation_reduces_before_the_shuffle(store):
    plan = tt.consolidated_view(store)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan[plan.index("Exchange"):]


def test_audit(store):
    trail = tt.audit_trail(store, "80")
    assert [r._version_file for r in trail.collect()] == [A] * 3 + [B] * 2 + [C]
    assert [r._version_file for r in tt.audited_versions(trail).collect()] == [A, B, C]
    june = tt.audit_trail(store, date_from=dt.date(2023, 6, 1), date_to=dt.date(2023, 6, 1))
    assert [float(r.Debet) for r in june.collect()] == [40.0]
    assert tt.audit_trail(store, "none").count() == 0


def test_audit_filters_reach_the_scan(store):
    plan = tt.audit_trail(store, "80")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(CodeGrootboekrekening,80)" in plan


def test_migration(spark, ledger_rows, tmp_path):
    table = ledger_rows(line(Debet=1.5, Nummer=3)).select(*LEDGER.names)
    table = table.withColumn("Nummer", F.col("Nummer").cast("string"))
    row = migrated(table, MAR).first()
    assert (row.Nummer, row._source_file, row._data_version) == (3, "migration_from_existing_db", 1)
    store = VersionStore(spark, str(tmp_path))
    store.migrate(table, MAR, A)
    assert store.manifest().first().operation == "migrate" and store.read(A).count() == 1


def test_raw_load_and_declared_table(spark, ledger_rows, tmp_path):
    store = VersionStore(spark, str(tmp_path))
    version = store.load_raw(ledger_rows(line()).select(*LEDGER.names), "x.csv", MAR)
    other = store.load_raw(ledger_rows(line()).select(*LEDGER.names), "x.csv", MAR)
    assert version != other and store.read_all().count() == 2  # in one second
    assert version.startswith("financial_transactions_x-csv-")
    assert version.endswith("_20240301_120000")
    assert store.read(version).first()._data_version == 1709294400
    store.create_table("ledger_declared")
    assert spark.table("ledger_declared").count() == 2
    store.load_raw(ledger_rows(line()).select(*LEDGER.names), "y.csv", MAR)
    assert spark.table("ledger_declared").count() == 3
    spark.sql("DROP VIEW ledger_declared")
    for suffix in ("rows", "manifest"):
        spark.sql(f"DROP TABLE ledger_declared_{suffix}")


def test_raw_types_are_aligned_at_write(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path))
    raw = spark.sql("select '80' as CodeGrootboekrekening, 1.5D as Debet, 'x' as Nummer, 7 as own")
    row = store.read(store.load_raw(raw, "x.csv", MAR)).first()
    assert (float(row.Debet), row.Nummer, row.Boekdatum, row.own) == (1.5, None, None, "7")


def test_relaxed_union(spark):
    first = spark.sql("select 1 as a, 'x' as b")
    second = spark.sql("select 2.5D as b, 3L as a")
    found = union_relaxed(first, second)
    assert dict(found.dtypes) == {"a": "bigint", "b": "string"}
    assert sorted(tuple(r) for r in found.collect()) == [(1, "x"), (3, "2.5")]
    with pytest.raises(ValueError):
        union_relaxed(first, second.drop("a"))
