"""Benchmark: seconds per named query, first and second run, as one JSON line.

``BENCH_SF_DIR`` is the folder of tables, ``BENCH_CPUS`` the number of threads.
Results go to a sink that reads every row and column and keeps nothing.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerloom.operators.timetravel import consolidated_view  # noqa: E402
from ledgerloom.plans.staging import stage  # noqa: E402
from ledgerloom.plans.transactions import with_running_balance  # noqa: E402
from ledgerloom.registry import inputs  # noqa: E402
from ledgerloom.registry.queries import queries  # noqa: E402
from ledgerloom.session import build_session  # noqa: E402

# Written once, before the queries that read them.
SAVED = {
    "save_ledger": inputs.saved_ledger,
    "save_marts": inputs.marts,
    "save_versions": inputs.store,
    "land_exports": inputs.landing,
}


def run(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = set(sys.argv[1:])
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="20g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="ledgerloom-bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    warm_up = timed(lambda: spark.range(1000).selectExpr("sum(id)").collect())

    saved = {name: timed(lambda: build(spark, folder)) for name, build in SAVED.items()}
    first, second = {}, {}
    for name, query in queries().items():
        if only and name not in only:
            continue
        first[name] = timed(lambda: run(query(spark, folder)))
        second[name] = timed(lambda: run(query(spark, folder)))
        print(f"{name}: {first[name]} {second[name]}", file=sys.stderr, flush=True)

    ledger = inputs.saved_ledger(spark, folder)
    lines = ledger.count()
    versions = inputs.store(spark, folder)
    stored = versions.read_all().count()
    rates = {
        "staging": (lines, lambda: run(stage(ledger))),
        "running_balance": (lines, lambda: run(with_running_balance(stage(ledger)))),
        "consolidation": (stored, lambda: run(consolidated_view(versions))),
    }
    rows_per_second = {
        name: round(rows / min(timed(action) for _ in range(2)))
        for name, (rows, action) in rates.items()
    }
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "sum of first runs of all queries",
                "value": round(sum(first.values()), 3),
                "unit": "sec",
                "queries": first,
                "second_run": second,
                "saved_tables": saved,
                "rows_per_second": rows_per_second,
                "session_start": warm_up,
                "cpus": int(cpus),
                "sf": float(scale.group(1)) if scale else folder,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
