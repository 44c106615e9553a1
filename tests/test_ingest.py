import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.timetravel import compare_versions
from ledgerloom.plans.ingest import ingest_folder, status_counts
from ledgerloom.plans.marts import current_marts
from ledgerloom.plans.refresh import refresh
from ledgerloom.schema import FILE_METADATA, LEDGER
from ledgerloom.sources import files
from ledgerloom.sources.inventory import file_inventory, file_totals
from ledgerloom.sources.store import VersionStore
from ledgerloom.streaming.incremental import ingest_available

NOW = dt.datetime(2024, 7, 1, 9, 30)
HEADER = LEDGER.names


def quoted(value):
    return f'"{value}"' if "," in str(value) else str(value)


def csv(path, rows, header=HEADER):
    text = [",".join(header)]
    text += [",".join(quoted(row.get(name, "")) for name in header) for row in rows]
    path.write_text("\n".join(text) + "\n")


def line(**changes):
    return {"CodeGrootboekrekening": "0080", "NaamGrootboekrekening": "Costs",
            "Boekdatum": "2023-05-01", "Debet": "10.50", "Boekingsnummer": 1, **changes}


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    csv(folder / "data.csv", [line(), line(Debet="x", Credit="1,5"), line(Boekdatum="2024-02-30"),
                              line(Boekdatum="")])
    # Other order, one column less and one more: matched by name.
    header = ["Extra", *[n for n in reversed(HEADER) if n != "Btwcode"]]
    csv(folder / "DUMP2024.csv", [line(Extra="note", Credit="2.00")], header)
    csv(folder / "broken.csv", [{"Debet": 1}], ["Debet", "Other"])
    csv(folder / "undated.csv", [line(Boekdatum="soon")])
    (folder / "lines.json").write_text(
        json.dumps(line(Debet="3.25")) + "\n" + json.dumps({**line(), "Credit": "1"}) + "\n"
    )
    (folder / "notes.txt").write_text("not an export")
    return folder


@pytest.fixture
def store(spark, tmp_path):
    return VersionStore(spark, str(tmp_path / "store"))


def test_files_are_found_by_extension(spark, landing):
    names = [r.name for r in files.discover(spark, str(landing)).collect()]
    assert names == ["DUMP2024.csv", "broken.csv", "data.csv", "lines.json", "undated.csv"]
    assert files.discover(spark, str(landing / "none")).count() == 0


def test_conformance(spark, landing):
    sources = files.exports(spark, files.discover(spark, str(landing)))
    found = {r.file: r for r in files.conformance_report(spark, sources).collect()}
    assert found["data.csv"].missing == [] and found["data.csv"].accepted
    assert (found["DUMP2024.csv"].missing, found["DUMP2024.csv"].extra) == (["Btwcode"], ["Extra"])
    assert found["DUMP2024.csv"].accepted and not found["broken.csv"].accepted
    assert found["broken.csv"].extra == ["Other"]


def test_ingest_reports_each_file_and_keeps_what_fits(store, landing):
    status = {r.file: r for r in ingest_folder(store, str(landing), NOW).collect()}
    assert {name: (r.status, r.row_count) for name, r in status.items()} == {
        "data.csv": ("processed", 2),
        "DUMP2024.csv": ("processed", 1),
        "lines.json": ("processed", 2),
        "broken.csv": ("failed", None),
        "undated.csv": ("failed", 0),
    }
    rows = store.read_all().where(F.col("_source_file") == "data.csv").collect()
    assert sorted((r.Debet is None, r.Credit) for r in rows) == [(False, None), (True, None)]
    assert {r.CodeGrootboekrekening for r in rows} == {"0080"}
    moved = store.read(status["DUMP2024.csv"].version_id).first()
    assert (float(moved.Debet), float(moved.Credit), moved.Btwcode) == (10.5, 2.0, None)
    assert moved._loaded_at == NOW and moved._data_version == 1719826200
    log = {r.source_file: r.row_count for r in store.ingestion_log().collect()}
    assert log == {"data.csv": 2, "DUMP2024.csv": 1, "lines.json": 2}


def test_second_run_skips_and_force_repeats(store, landing):
    ingest_folder(store, str(landing), NOW)
    again = ingest_folder(store, str(landing), NOW + dt.timedelta(days=1))
    assert tuple(status_counts(again).first()) == (0, 3, 2)
    csv(landing / "a.csv", [line()])  # a part of "data.csv", and new all the same
    later = ingest_folder(store, str(landing), NOW + dt.timedelta(days=2))
    assert {r.file for r in later.where("status = 'processed'").collect()} == {"a.csv"}
    forced = ingest_folder(store, str(landing), NOW + dt.timedelta(days=3), force=True)
    assert tuple(status_counts(forced).first()) == (4, 0, 2)


def test_reading_without_ingesting(spark, landing, tmp_path):
    (landing / "damaged.parquet").write_text("no parquet")
    rows = files.read_ledger(spark, str(landing))
    assert rows.columns[:19] == HEADER and {"_source_file", "Extra", "Other"} <= set(rows.columns)
    assert rows.groupBy("_source_file").count().count() == 5
    files.write_rows(rows.select(*HEADER), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.count() == 9
    assert files.read_ledger(spark, str(tmp_path / "nothing")).count() == 0


def test_empty_landing(store, tmp_path):
    statuses = ingest_folder(store, str(tmp_path / "nothing"), NOW)
    assert statuses.count() == 0 and tuple(status_counts(statuses).first()) == (0, 0, 0)


def test_exports_written_in_parts_are_one_source(spark, store, tmp_path, ledger_rows):
    rows = spark.range(8).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in LEDGER if f.name != "Boekdatum"],
        F.lit(dt.date(2023, 1, 1)).alias("Boekdatum"),
    ).select(*HEADER)
    rows.repartition(3).write.parquet(str(tmp_path / "in" / "big.parquet"))
    status = ingest_folder(store, str(tmp_path / "in"), NOW).collect()
    assert [(r.file, r.status, r.row_count) for r in status] == [("big.parquet", "processed", 8)]


def test_stream_ingests_each_file_once(store, landing, tmp_path):
    checkpoint = str(tmp_path / "checkpoint")
    run = lambda: ingest_available(store, str(landing), checkpoint, clock=lambda: NOW)
    run()
    assert store.read_all().count() == 5
    run()
    assert store.read_all().count() == 5 and store.manifest().count() == 3
    csv(landing / "later.csv", [line(), line()])
    run()
    assert store.read_all().count() == 7
    assert store.manifest().where("snapshot_id like '%_landing_b1'").count() == 1


def test_refresh_runs_all_steps(spark, store, landing, tmp_path):
    steps = refresh(store, str(landing), str(tmp_path / "marts"), NOW).collect()
    assert [(s.step, s.success) for s in steps] == [
        ("check_files", True), ("ingest_files", False), ("rebuild_models", True),
        ("data_tests", True),
    ]
    assert steps[1].message == "3 processed, 2 failed"
    assert steps[3].message == "Data quality tests completed"
    details = current_marts(spark, str(tmp_path / "marts")).transactions
    # Lines with the same account, date and booking collapse into one.
    assert details.count() == 1


def test_refresh_makes_nothing_again_of_the_same_versions(spark, store, landing, tmp_path):
    marts = str(tmp_path / "marts")
    refresh(store, str(landing), marts, NOW).collect()
    before = current_marts(spark, marts).transactions.inputFiles()
    for name in ("broken.csv", "undated.csv"):
        (landing / name).unlink()
    steps = refresh(store, str(landing), marts, NOW).collect()
    assert [(s.step, s.success, s.message) for s in steps] == [
        ("check_files", True, "Found 0 new files to process"),
        ("ingest_files", True, "No new files to process"),
        ("rebuild_models", True, "Models are up to date"),
        ("data_tests", True, "No new models to test"),
    ]
    assert current_marts(spark, marts).transactions.inputFiles() == before
    csv(landing / "later.csv", [line(Boekingsnummer=9)])
    steps = refresh(store, str(landing), marts, NOW + dt.timedelta(minutes=1)).collect()
    assert steps[2].message == "Models rebuilt" and steps[3].message == "Data quality tests completed"
    assert current_marts(spark, marts).transactions.count() == 2
    # Another day, other classes of age.
    steps = refresh(store, str(landing), marts, NOW + dt.timedelta(1)).collect()
    assert steps[2].message == "Models rebuilt"


def test_inventory(spark, landing):
    (landing / "damaged.parquet").write_text("no parquet")
    rows = file_inventory(spark, str(landing))
    assert rows.columns == [
        "filename", "size_mb", "n_columns", "n_rows", "total_debit", "total_credit", "modified",
        "status", "path", "source",
    ]
    assert sorted(rows.columns) == sorted(FILE_METADATA.names)
    found = {r.filename: r for r in rows.collect()}
    assert list(found) == sorted(found)
    assert found["DUMP2024.csv"].status == "Skipped" and found["data.csv"].status == "Processed"
    assert (found["data.csv"].n_columns, found["data.csv"].n_rows) == (19, 4)
    assert found["data.csv"].total_debit == 31.5 and found["data.csv"].total_credit == 0
    damaged = found["damaged.parquet"]
    assert (damaged.n_columns, damaged.n_rows, damaged.total_debit) == (0, 0, 0.0)


def test_totals_by_name_and_by_place(spark):
    named = spark.sql(
        "select 'f' as _source_file, * from values (1, 100.0, 50.0), (2, 200.0, -25.0), "
        "(3, 300.0, 225.0) as t(col1, `Debit Amount`, `Credit Amount`)"
    )
    row = file_totals(named).first()
    assert (row.n_columns, row.n_rows, row.total_debit, row.total_credit) == (3, 3, 600.0, 250.0)
    placed = spark.range(3).select(
        F.lit("f").alias("_source_file"),
        *[F.lit(0).alias(f"col_{i}") if i != 11 else ((F.col("id") + 1) * 1000).alias("col_11")
          for i in range(15)],
    )
    assert file_totals(placed).first().total_debit == 6000.0
    negative = spark.sql("select 'f' as _source_file, 'x' as debit, -5 as soll, 7 as credit_debit")
    assert file_totals(negative).first().total_debit == 0.0


def test_names_with_odd_characters_are_kept_apart(store, tmp_path):
    names = ["my file+1%.csv", "a.b.csv", "a_b.csv", "x=y.csv", "é.csv"]
    folder = tmp_path / "odd"
    folder.mkdir()
    for count, name in enumerate(names, 1):
        csv(folder / name, [line()] * count)
    status = {r.file: r for r in ingest_folder(store, str(folder), NOW).collect()}
    assert {n: r.row_count for n, r in status.items()} == {n: i for i, n in enumerate(names, 1)}
    assert len({r.version_id for r in status.values()}) == 5
    assert status["a_b.csv"].version_id == "financial_transactions_a_b_csv_20240701_093000"
    stored = store.read_all().groupBy("_source_file").count().collect()
    assert {r._source_file: r["count"] for r in stored} == {n: i for i, n in enumerate(names, 1)}
    assert store.read(status["my file+1%.csv"].version_id).count() == 1
    assert {r.status for r in ingest_folder(store, str(folder), NOW).collect()} == {"skipped"}


def test_each_file_is_bound_by_its_own_header(store, tmp_path):
    folder = tmp_path / "in" / "year.csv"
    folder.mkdir(parents=True)
    swapped = list(HEADER)
    d, c = swapped.index("Debet"), swapped.index("Credit")
    swapped[d], swapped[c] = "Credit", "Debet"
    csv(folder / "part-0.csv", [line(Debet="7", Credit="0")])
    csv(folder / "part-1.csv", [line(Debet="0", Credit="9", Boekingsnummer=2)], swapped)
    status = ingest_folder(store, str(tmp_path / "in"), NOW).collect()
    assert [(r.file, r.status, r.row_count, r.rejected) for r in status] == [
        ("year.csv", "processed", 2, 0)
    ]
    found = {r.Boekingsnummer: (int(r.Debet), int(r.Credit)) for r in store.read_all().collect()}
    assert found == {1: (7, 0), 2: (0, 9)}


def test_equal_names_in_two_folders_are_two_sources(store, tmp_path):
    for name in ("a", "b"):
        (tmp_path / "in" / name).mkdir(parents=True)
        csv(tmp_path / "in" / name / "same.csv", [line()] if name == "a" else [line(), line()])
    status = ingest_folder(store, str(tmp_path / "in"), NOW).collect()
    assert [(r.file, r.row_count) for r in status] == [("a/same.csv", 1), ("b/same.csv", 2)]
    assert store.manifest().count() == 2


def test_rejected_records_are_counted(store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    csv(folder / "some.csv", [line(), line(Boekdatum="soon"), line(Boekdatum="")])
    (folder / "lines.json").write_text(json.dumps(line(Credit="1")) + "\n{broken\n")
    status = {r.file: (r.row_count, r.rejected) for r in ingest_folder(store, str(folder), NOW).collect()}
    assert status == {"some.csv": (1, 2), "lines.json": (1, 1)}


def test_the_stream_knows_what_a_batch_ingested(store, landing, tmp_path):
    ingest_folder(store, str(landing), NOW)
    ingest_available(store, str(landing), str(tmp_path / "checkpoint"), clock=lambda: NOW)
    assert store.read_all().count() == 5


def test_a_failure_before_the_commit_leaves_nothing_twice(store, landing, monkeypatch):
    def fails(described):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(store, "commit", fails)
        with pytest.raises(RuntimeError):
            ingest_folder(store, str(landing), NOW)
    assert store.read_all().count() == 0 and store.ingestion_log().count() == 0
    ingest_folder(store, str(landing), NOW + dt.timedelta(hours=1))
    assert store.read_all().count() == 5


def test_columns_of_its_own_stay_with_a_version(store, landing):
    status = {r.file: r for r in ingest_folder(store, str(landing), NOW).collect()}
    assert store.read(status["DUMP2024.csv"].version_id).first().Extra == "note"
    assert "Extra" not in store.read(status["data.csv"].version_id).columns
    found = compare_versions(store, status["data.csv"].version_id, status["DUMP2024.csv"].version_id).first()
    assert found.new_columns == ["Extra"] and (found.columns1, found.columns2) == (22, 23)


FEW = ["CodeGrootboekrekening", "Boekdatum", "Debet", "Credit", "Omschrijving"]


def test_records_that_do_not_fit_are_quarantined(store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "fields.csv").write_text(
        ",".join(FEW) + "\n80,2020-01-01,1.5,0,ok\n80,2020-01-01,1,5,0,x\n80,2020-01-01,1\n80,soon,1,0,late\n"
    )
    (folder / "records.json").write_text(json.dumps(line(Credit="1")) + "\n{broken\n")
    status = {r.file: (r.row_count, r.rejected) for r in ingest_folder(store, str(folder), NOW).collect()}
    assert status == {"fields.csv": (1, 3), "records.json": (1, 1)}
    found = {(r.file, r.reason, r.text) for r in store.quarantine().collect() if r.reason != files.DATE}
    assert found == {
        ("fields.csv", files.FIELDS, "80,2020-01-01,1,5,0,x"),
        ("fields.csv", files.FIELDS, "80,2020-01-01,1"),
        ("records.json", files.RECORD, "{broken"),
    }
    undated = store.quarantine().where(F.col("reason") == files.DATE).first()
    assert json.loads(undated.text)["Boekdatum"] == "soon"
    assert store.quarantines().where("file = 'fields.csv'").first().records == 3
    assert [float(r.Debet) for r in store.read_all().where("_source_file = 'fields.csv'").collect()] == [1.5]


def test_a_file_without_a_good_record_is_quarantined_whole(store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "bad.csv").write_text(",".join(FEW) + "\n80,soon,1,0,x\n1,2\n")
    status = ingest_folder(store, str(folder), NOW).first()
    assert (status.status, status.row_count, status.rejected) == ("failed", 0, 2)
    assert store.quarantine().count() == 2 and store.manifest().count() == 0


def test_quoted_values_may_hold_line_ends(store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "lines.csv").write_text(
        ",".join(FEW) + '\n80,2020-01-01,1,0,"two\nlines, quoted"\n81,2020-01-01,2,0,one\n82,2020-01-01,2\n'
    )
    (folder / "plain.csv").write_text(",".join(FEW) + "\n80,2020-01-01,1,0,x\n")
    status = {r.file: (r.row_count, r.rejected) for r in ingest_folder(store, str(folder), NOW).collect()}
    assert status == {"lines.csv": (2, 1), "plain.csv": (1, 0)}
    texts = {r.CodeGrootboekrekening: r.Omschrijving for r in store.read_all().where("_source_file = 'lines.csv'").collect()}
    assert texts == {"80": "two\nlines, quoted", "81": "one"}
    # A quote that nothing closes would swallow what follows: then lines stay lines.
    (folder / "open.csv").write_text(
        ",".join(FEW) + '\n80,"2020-01-01,1,0,x\n81,2020-01-01,2,0,one\n82,2020-01-01,2,0,two\n'
    )
    later = ingest_folder(store, str(folder), NOW + dt.timedelta(1)).where("status = 'processed'").first()
    assert (later.file, later.row_count, later.rejected) == ("open.csv", 2, 1)


def test_parquet_exports_of_other_types_and_damaged_ones_fail_alone(spark, store, tmp_path):
    rows = spark.sql(
        "select '80' CodeGrootboekrekening, date'2020-01-01' Boekdatum, 1.5D Debet, 0D Credit, id Nummer from range(3)"
    )
    text = rows.withColumn("Debet", F.col("Debet").cast("string"))
    rows.write.parquet(str(tmp_path / "in" / "double.parquet"))
    text.write.parquet(str(tmp_path / "in" / "text.parquet"))
    rows.write.parquet(str(tmp_path / "in" / "both.parquet"))
    text.write.mode("append").parquet(str(tmp_path / "in" / "both.parquet"))
    (tmp_path / "in" / "damaged.parquet").write_text("no parquet")
    csv(tmp_path / "in" / "GOOD.CSV", [line()])
    status = {r.file: (r.status, r.row_count) for r in ingest_folder(store, str(tmp_path / "in"), NOW).collect()}
    assert status == {
        "double.parquet": ("processed", 3), "text.parquet": ("processed", 3), "both.parquet": ("processed", 6),
        "damaged.parquet": ("failed", None), "GOOD.CSV": ("processed", 1),
    }
    assert store.read_all().where("_source_file like '%.parquet'").agg(F.sum("Debet")).first()[0] == 18


def test_parts_that_land_later_become_a_further_version(store, tmp_path):
    folder = tmp_path / "in" / "year.csv"
    folder.mkdir(parents=True)
    csv(folder / "part-0.csv", [line()])
    ingest_folder(store, str(tmp_path / "in"), NOW)
    csv(folder / "part-1.csv", [line(Boekingsnummer=2), line(Boekingsnummer=3)])
    later = ingest_folder(store, str(tmp_path / "in"), NOW + dt.timedelta(1)).collect()
    assert [(r.file, r.status, r.row_count) for r in later] == [("year.csv", "processed", 2)]
    csv(folder / "part-2.csv", [line(Boekingsnummer=4)])
    ingest_available(store, str(tmp_path / "in"), str(tmp_path / "checkpoint"), clock=lambda: NOW + dt.timedelta(2))
    assert sorted(r.Boekingsnummer for r in store.read_all().collect()) == [1, 2, 3, 4]
    assert store.manifest().count() == 3
    again = ingest_folder(store, str(tmp_path / "in"), NOW + dt.timedelta(3)).collect()
    assert [r.status for r in again] == ["skipped"]
