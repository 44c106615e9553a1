import datetime as dt

from ledgerloom.sources import logs


def test_ingestion_log_records(spark, tmp_path):
    path = tmp_path / "log.txt"
    path.write_text(
        "2024-01-02T03:04:05.678 | a b.xlsx | out_1.parquet | 12 rows\\n"
        "2024-01-03T03:04:05 | c.xlsx | out_2.parquet | 7 rows\\n\n"
        "no record\n"
    )
    rows = logs.parse_ingestion_log(spark.read.text(str(path))).orderBy("source_file").collect()
    assert [(r.source_file, r.output_file, r.row_count) for r in rows] == [
        ("a b.xlsx", "out_1.parquet", 12), ("c.xlsx", "out_2.parquet", 7),
    ]
    assert rows[0].logged_at == dt.datetime(2024, 1, 2, 3, 4, 5, 678000)


def model(folder, path, text):
    target = folder / "models" / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text)


def test_lineage(spark, tmp_path):
    model(tmp_path, "staging/stg_a.sql", "select * from {{ source('raw', \"a\") }}")
    model(tmp_path, "intermediate/int_b.sql", "from {{ ref('stg_a') }}\njoin {{ ref(\"x\") }}")
    model(tmp_path, "marts/mart_c.sql", "select 1")
    model(tmp_path, "example/my_first.sql", "from {{ ref('stg_a') }}")
    models = logs.read_models(spark, str(tmp_path / "models"))
    listed = {r.name: (r.type, r.path, r.dependencies, r.sources) for r in
              logs.model_list(models).collect()}
    assert listed == {
        "stg_a": ("staging", "staging/stg_a.sql", "None", "raw.a"),
        "int_b": ("intermediate", "intermediate/int_b.sql", "stg_a, x", "None"),
        "mart_c": ("mart", "marts/mart_c.sql", "None", "None"),
    }
    edges = {(r.name, r.upstream, r.kind) for r in logs.lineage_edges(models).collect()}
    assert edges == {
        ("stg_a", "raw.a", "source"), ("int_b", "stg_a", "ref"), ("int_b", "x", "ref"),
    }


def test_run_log(spark, tmp_path):
    path = tmp_path / "run.log"
    path.write_text(
        "10:00:00 Command `dbt run` failed at 10:00:01 after 1s\n"
        "10:00:00 Command `dbt debug` succeeded at 10:00:05 after 1s\n"
        "10:01:00 Command `dbt run --select x` succeeded at 10:01:02 after 1s\n"
        "10:02:00 Running with dbt=1.0\n"
        "10:02:00 Command `dbt seed` failed at 10:02:03 after 1s\n"
        "10:03:00 Command `dbt run` succeeded without a time\n"
    )
    lines = logs.numbered_lines(spark, str(path))
    found = {r.scope: (r.command, r.at, r.status) for r in logs.run_log_status(lines).collect()}
    assert found == {
        "last": ("dbt seed", "10:02:03", "error"),
        "debug": ("dbt debug", "10:00:05", "success"),
        "run": ("dbt run --select x", "10:01:02", "success"),
        "test": (None, None, "info"),
    }
    nothing = logs.run_log_status(lines.limit(0)).collect()
    assert {r.status for r in nothing} == {"info"} and len(nothing) == 4
