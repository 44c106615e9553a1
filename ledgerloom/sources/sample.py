"""A ledger derived from order-line tables, for tests and benchmarks.

Every order line becomes one booking line: the customer is the account, the
order the booking, returned lines are credits and all others debits.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.schema import LOADED_LEDGER, MONEY

AS_OF = dt.date(2001, 11, 4)  # the day of the last line


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Loaded ledger rows, one per order line.

    Orders meet their customers first, so that the lines, as they are stored, are shuffled once.
    """
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    customers = spark.read.parquet(f"{folder}/customer.parquet")

    sold = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    joined = lines.join(sold, F.col("l_orderkey") == F.col("o_orderkey"))

    rate = "decimal(4,2)"
    day = F.col("l_shipdate").cast("date")
    price = F.col("l_extendedprice").cast(MONEY)
    amount = (price * F.col("l_discount").cast(rate)).cast(MONEY)
    year = F.year(day)
    line = F.col("l_linenumber").cast("string")
    returned = F.col("l_returnflag") == "R"
    columns = {
        "CodeAdministratie": F.col("c_nationkey").cast("string"),
        "NaamAdministratie": F.col("c_mktsegment"),
        "CodeGrootboekrekening": F.col("o_custkey").cast("string"),
        "NaamGrootboekrekening": F.col("c_name"),
        "Code": F.col("o_orderpriority"),
        "Boekingsnummer": F.col("l_orderkey"),
        "Boekdatum": day,
        "Periode": F.date_format(day, "yyyy-MM"),
        "Code1": F.col("l_suppkey").cast("string"),
        "Code2": F.col("l_partkey").cast("string"),
        "Omschrijving": F.when(F.col("l_linenumber") == 7, " ").otherwise(
            F.concat(F.lit("line "), line)
        ),
        "Debet": F.when(~returned, amount),
        "Credit": F.when(returned, amount),
        "Saldo": price,
        "Btwbedrag": (amount * F.col("l_tax").cast(rate)).cast(MONEY),
        "Btwcode": F.col("l_returnflag"),
        "Boekingsstatus": F.col("l_linestatus"),
        "Nummer": F.col("l_linenumber").cast("bigint"),
        "Factuurnummer": F.concat(F.lit("INV"), F.col("o_orderkey").cast("string")),
        "_loaded_at": F.make_date(year + 1, F.lit(2), F.lit(24)).cast("timestamp_ntz"),
        "_source_file": F.concat(F.lit("DUMP"), year.cast("string"), F.lit(".xlsx")),
        "_data_version": year.cast("bigint"),
    }
    return joined.select([columns[name].alias(name) for name in LOADED_LEDGER.names])
