"""Text inputs: the ingestion log, model texts and the run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The command log's wording and the calls in model texts.
FINISHED = r"Command `(dbt [^`]+)`"
FINISHED_AT = r"at (\d{2}:\d{2}:\d{2})"
COMMANDS = ("debug", "run", "test")
REF = r"""ref\(['"]([^'"]+)['"]\)"""
SOURCE = r"""source\(['"]([^'"]+)['"],\s*['"]([^'"]+)['"]\)"""
EXAMPLE_PREFIX = "my_"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file with a key that grows along the file."""
    return spark.read.text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("line"),
    )


# --- ingestion log ---


def parse_ingestion_log(text: DataFrame) -> DataFrame:
    """Rows of ``time | source | output | n rows`` records.

    Records end at a line break or at the two characters ``\\n``, which is what
    the log's writer puts between them.
    """
    records = text.select(F.explode(F.split("value", r"\\n")).alias("record"))
    parts = F.split("record", r"\|")
    part = lambda i: F.trim(F.get(parts, F.lit(i)))
    return records.where(F.contains("record", F.lit("|"))).select(
        part(0).try_cast("timestamp_ntz").alias("logged_at"),
        part(1).alias("source_file"),
        part(2).alias("output_file"),
        F.regexp_extract(part(3), r"^(\d+)", 1).try_cast("bigint").alias("row_count"),
    )


# --- model texts ---


def read_models(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` relative to the folder and whole ``text`` of each model."""
    rows = spark.read.option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.sql"
    ).text(folder, wholetext=True)
    below = F.split(F.col("_metadata.file_path"), "/models/")
    return rows.select(F.element_at(below, -1).alias("path"), F.col("value").alias("text"))


def _layer(path: Column) -> Column:
    return (
        F.when(path.contains("staging"), "staging")
        .when(path.contains("intermediate"), "intermediate")
        .otherwise("mart")
    )


def _parsed_models(models: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]+?)(?:\.sql)?$", 1)
    pairs = F.arrays_zip(
        F.regexp_extract_all("text", F.lit(SOURCE), 1).alias("group"),
        F.regexp_extract_all("text", F.lit(SOURCE), 2).alias("table"),
    )
    return models.select(
        name.alias("name"),
        _layer(F.col("path")).alias("type"),
        "path",
        F.regexp_extract_all("text", F.lit(REF), 1).alias("refs"),
        F.transform(pairs, lambda p: F.concat(p["group"], F.lit("."), p["table"])).alias("sources"),
    ).where(~F.col("name").startswith(EXAMPLE_PREFIX))


def model_list(models: DataFrame) -> DataFrame:
    """One row per model; what it reads as text, ``None`` if nothing."""
    listed = lambda name: F.when(F.size(name) == 0, "None").otherwise(
        F.array_join(name, ", ")
    )
    return _parsed_models(models).select(
        "name",
        "type",
        "path",
        listed("refs").alias("dependencies"),
        listed("sources").alias("sources"),
    )


def lineage_edges(models: DataFrame) -> DataFrame:
    """One row per reference: ``upstream`` model or source -> ``name``."""
    parsed = _parsed_models(models)
    return parsed.select(
        "name", "type", F.explode("refs").alias("upstream"), F.lit("ref").alias("kind")
    ).unionByName(
        parsed.select(
            "name", "type", F.explode("sources").alias("upstream"), F.lit("source").alias("kind")
        )
    )


# --- run log ---


def finished_commands(lines: DataFrame) -> DataFrame:
    """Completed commands: ``line``, ``command``, ``at`` and ``status``."""
    text = F.col("value")
    said = text.contains("failed at") | text.contains("succeeded at")
    return (
        lines.where(text.contains("Command `dbt") & said)
        .select(
            "line",
            F.regexp_extract(text, FINISHED, 1).alias("command"),
            F.regexp_extract(text, FINISHED_AT, 1).alias("at"),
            F.when(text.contains("succeeded"), "success").otherwise("error").alias("status"),
        )
        .where((F.col("command") != "") & (F.col("at") != ""))
    )


def run_log_status(lines: DataFrame) -> DataFrame:
    """The latest command of all and of each type; ``info`` where there is none.

    Grouping keeps one row per type and task, so the log may be of any length.
    """
    command = F.col("command")
    kind = F.coalesce(
        *[F.when(command.startswith(f"dbt {name}"), name) for name in COMMANDS], F.lit("other")
    )
    newest = F.max_by(F.struct("line", "command", "at", "status"), "line").alias("newest")
    by_kind = finished_commands(lines).groupBy(kind.alias("kind")).agg(newest)
    scoped = (
        by_kind.select(F.explode(F.array("kind", F.lit("last"))).alias("scope"), "newest.*")
        .groupBy("scope")
        .agg(newest)
    )
    scopes = lines.sparkSession.createDataFrame(
        [("last",), *[(name,) for name in COMMANDS]], "scope string"
    )
    return scopes.join(scoped, "scope", "left").select(
        "scope",
        "newest.command",
        "newest.at",
        F.coalesce("newest.status", F.lit("info")).alias("status"),
    )
