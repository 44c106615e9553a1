"""General-ledger analytics as Spark DataFrame plans."""
