"""Exported ledger files: finding them, reading them, checking and cleaning them.

An export is a CSV (with header), JSON-lines or Parquet file of the ledger's
columns, or a folder of such parts written by Spark. CSV and JSON may be packed by gzip. Its path
below the landing folder is the source of its rows.
"""

from __future__ import annotations

import csv
import datetime as dt
import json
from collections import defaultdict
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.money import column
from ledgerloom.operators.align import add_missing, cast_ledger, union_aligned
from ledgerloom.schema import CORE_COLUMNS, LEDGER
from ledgerloom.sources.store import load_metadata

FORMATS = ("csv", "json", "parquet")
GZIP = ".gz"
FILE_GLOB = "*.{[cC][sS][vV],[jJ][sS][oO][nN],[pP][aA][rR][qQ][uU][eE][tT],[cC][sS][vV].gz,[jJ][sS][oO][nN].gz}"
HEADER_JOBS = 16

_SOURCE_FILE = T.StructField("_source_file", T.StringType())
BAD = "_bad"  # of a record that cannot be stored: why, and its text
BAD_TYPE = "struct<reason:string,text:string>"
FIELDS, RECORD, DATE = "Wrong number of fields", "Not a record", "No valid date"  # reasons
_LISTING = "name string, path string, size bigint, modified timestamp_ntz, root string"


def path_part(spark: SparkSession, folder: str) -> str:
    """The folder's path without scheme and host."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath()
    return path.rstrip("/")


def _is_export(folder: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(folder).endswith(f".{form}") for form in FORMATS])


def source_name(path: Column | str, root: Column | str) -> Column:
    """The export a file belongs to: its path below the landing folder, without the file's own
    name if that is a part, and without the name of a partition column.

    Computed per row, hence without a pattern to search for.
    """
    path = column(path)
    root = F.lit(root) if isinstance(root, str) else root
    below = F.substr(path, F.position(root, path) + F.length(root) + 1)
    file = F.substring_index(below, "/", -1)
    folder = F.substring_index(F.substring_index(below, "/", -2), "/", 1)
    is_part = file.startswith("part-") & (file != below)
    in_export = _is_export(folder)
    taken = F.when(is_part & in_export, F.length(folder) + F.length(file) + 1).otherwise(
        F.length(file)
    )
    above = F.substr(below, F.lit(1), F.length(below) - taken)
    own = F.when(is_part & in_export, F.substring_index(folder, "=", -1)).otherwise(file)
    return F.concat(above, own)


def export_path(path: Column | str) -> Column:
    """The path of the export: its folder for a part, else the file itself."""
    path = column(path)
    folder = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    is_part = F.substring_index(path, "/", -1).startswith("part-")
    in_export = _is_export(folder)
    parent = F.substr(
        path, F.lit(1), F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1
    )
    return F.when(is_part & in_export, parent).otherwise(path)


def _decoded(encoded: Column) -> Column:
    """A row's path is URL-encoded, but for ``+``."""
    plain = F.replace(encoded, F.lit("+"), F.lit("%2B"))
    return F.when(encoded.contains("%"), F.url_decode(plain)).otherwise(encoded)


def discover(spark: SparkSession, folder: str, glob: str = FILE_GLOB) -> DataFrame:
    """Files below a folder, sorted by path; contents are not read."""
    try:
        listing = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", glob)
            .option("recursiveFileLookup", "true")
            .load(folder)
        )
    except PySparkException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LISTING)
    root = path_part(spark, folder)
    return listing.select(
        source_name("path", root).alias("name"),
        "path",
        F.col("length").alias("size"),
        F.col("modificationTime").cast("timestamp_ntz").alias("modified"),
        F.lit(root).alias("root"),
    ).orderBy("path")


@dataclass(frozen=True)
class Part:
    """Files of an export that carry the same columns, each in its own order."""

    columns: tuple[str, ...] | None  # None: unreadable
    paths: tuple[str, ...]
    schema: str | None = None  # of Parquet files, as JSON


@dataclass(frozen=True)
class Export:
    """One source: its files, grouped by the columns they carry."""

    name: str
    root: str
    parts: tuple[Part, ...]

    @property
    def format(self) -> str:
        return self.name.removesuffix(GZIP).rsplit(".", 1)[-1].lower()

    @property
    def columns(self) -> tuple[str, ...] | None:
        """Of all parts together; None if one is unreadable."""
        if any(part.columns is None for part in self.parts):
            return None
        return tuple(dict.fromkeys(name for part in self.parts for name in part.columns))

    @property
    def missing(self) -> list[str]:
        return sorted(set(LEDGER.names) - set(self.columns or ()))

    @property
    def extra(self) -> list[str]:
        return sorted(set(self.columns or ()) - set(LEDGER.names))

    @property
    def accepted(self) -> bool:
        """Readable, and each part with the columns no ledger can do without."""
        return self.columns is not None and all(
            set(CORE_COLUMNS) <= set(part.columns) for part in self.parts
        )


def exports(spark: SparkSession, files: DataFrame) -> list[Export]:
    """Sources of the listed files, with their columns.

    Of a CSV file the first line is read, of a Parquet export the footers; one job reads the keys of
    all JSON records. Files of one export that agree come to the driver as its folder, others one by
    one, as do those that ``files`` calls ``late``: others of their export were ingested before.
    """
    late = F.col("late") if "late" in files.columns else F.lit(False)
    listed = files.select("name", "path", "root", export_path("path").alias("export"), late.alias("late"))
    grouped: dict[tuple[str, str], list[Part]] = defaultdict(list)
    for read, form in ((_csv_headers, "csv"), (_json_keys, "json"), (_parquet_schemas, "parquet")):
        unpacked = F.when(F.endswith("name", F.lit(GZIP)), F.substring_index("name", ".gz", 1)).otherwise(F.col("name"))
        found = listed.where(F.lower(unpacked).endswith(f".{form}"))
        for name, root, part in read(spark, found):
            grouped[name, root].append(part)
    return [Export(name, root, tuple(parts)) for (name, root), parts in sorted(grouped.items())]


def _named(path: Column | str) -> Column:
    """The files of an export as its folder, unless only some of them are wanted."""
    return F.when(F.col("late"), F.col("path")).otherwise(column(path))


def _first_line(spark: SparkSession, path: str) -> str | None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(system.getConf()).getCodec(where)
    stream = system.open(where) if codec is None else codec.createInputStream(system.open(where))
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
    try:
        return reader.readLine()
    finally:
        reader.close()


def _csv_headers(spark: SparkSession, listed: DataFrame) -> list[tuple[str, str, Part]]:
    """Per export and header: its columns, and the export's folder or the files with it."""
    files = listed.collect()
    with ThreadPoolExecutor(HEADER_JOBS) as pool:
        headers = list(pool.map(lambda row: _first_line(spark, row.path), files))
    alike = defaultdict(set)
    for row, header in zip(files, headers):
        alike[row.name, row.root, row.export].add(header)
    grouped = defaultdict(set)
    for row, header in zip(files, headers):
        single = row.late or len(alike[row.name, row.root, row.export]) > 1
        grouped[row.name, row.root, header].add(row.path if single else row.export)
    return [
        (name, root, Part(tuple(next(csv.reader([header]))) if header else None, tuple(sorted(paths))))
        for (name, root, header), paths in sorted(grouped.items(), key=repr)
    ]


def _json_keys(spark: SparkSession, listed: DataFrame) -> list[tuple[str, str, Part]]:
    """Per export: all keys of its records; records that are not JSON have none."""
    grouped = (
        listed.withColumn("place", _named("export")).groupBy("name", "root").agg(F.collect_set("place").alias("paths"))
    )
    found = grouped.collect()
    if not found:
        return []
    root = found[0].root
    # Records of a file with the same keys are one row before their keys are taken apart.
    alike = (
        spark.read.text([path for row in found for path in row.paths])
        .select(F.col("_metadata.file_path").alias("file"), F.json_object_keys("value").alias("keys"))
        .distinct()
    )
    lines = alike.select(source_name(_decoded(F.col("file")), root).alias("name"), F.explode_outer("keys").alias("key"))
    keys = {r.name: tuple(sorted(r.keys)) for r in lines.groupBy("name").agg(F.collect_set("key").alias("keys")).collect()}
    return [(r.name, r.root, Part(keys.get(r.name) or None, tuple(sorted(r.paths)))) for r in found]


def _parquet_schemas(spark: SparkSession, listed: DataFrame) -> list[tuple[str, str, Part]]:
    """Per export, or per file where its files' types do not go together: the columns and types."""

    def schema(*paths: str) -> T.StructType | None:
        try:
            return spark.read.option("mergeSchema", "true").parquet(*paths).schema
        except (PySparkException, Py4JJavaError):
            return None

    def part(read: T.StructType | None, paths: tuple[str, ...]) -> Part:
        return Part(tuple(read.names) if read else None, paths, read.json() if read else None)

    found = (
        listed.withColumn("place", _named("export"))
        .groupBy("name", "root")
        .agg(F.collect_set("place").alias("places"), F.collect_set("path").alias("paths"))
        .collect()
    )
    with ThreadPoolExecutor(HEADER_JOBS) as pool:
        merged = list(pool.map(lambda row: schema(*row.places), found))
        result = []
        for row, whole in zip(found, merged):
            if whole is not None or len(row.paths) == 1:
                result.append((row.name, row.root, part(whole, tuple(sorted(row.places)))))
                continue
            alike = defaultdict(list)
            for path, own in zip(row.paths, pool.map(schema, row.paths)):
                alike[own.json() if own else None].append(path)
            for own, paths in sorted(alike.items(), key=repr):
                read = T.StructType.fromJson(json.loads(own)) if own else None
                result.append((row.name, row.root, part(read, tuple(sorted(paths)))))
    return result


def conformance_report(spark: SparkSession, sources: Iterable[Export]) -> DataFrame:
    """Per source: missing and extra columns, and whether it is accepted."""
    return spark.createDataFrame(
        [(s.name, s.missing, s.extra, s.accepted) for s in sources],
        "file string, missing array<string>, extra array<string>, accepted boolean",
    )


def read_exports(spark: SparkSession, sources: Iterable[Export]) -> list[DataFrame]:
    """Rows with ``_source_file``: one frame per format, set of columns and types.

    Files alike in these are one scan. Each CSV file is read with the header it has.
    """
    return [rows.drop(BAD) for rows in read_records(spark, sources)]


def read_records(
    spark: SparkSession, sources: Iterable[Export], lines_in_quotes: bool = False
) -> list[DataFrame]:
    """As ``read_exports``, and with ``_bad``, which says what is wrong with a record and gives its
    text: a line that has more or fewer fields than its header, or is no JSON record.

    ``lines_in_quotes`` reads CSV files whole, so that a quoted value may hold line ends.
    """
    alike = defaultdict(list)
    for source in sources:
        if source.columns is None:
            continue
        for part in source.parts:
            alike[source.format, part.columns, part.schema, source.root].extend(part.paths)
    frames = []
    for (form, columns, schema, root), paths in alike.items():
        bad = F.lit(None).cast(BAD_TYPE)
        if form == "parquet":
            rows = spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*paths)
        else:
            corrupt = next(n for k in range(len(columns) + 1) if (n := f"_corrupt_{k}") not in columns)
            fields = [T.StructField(name, T.StringType()) for name in (*columns, corrupt)]
            reader = spark.read.schema(T.StructType(fields)).option("columnNameOfCorruptRecord", corrupt)
            if form == "csv":
                reader = reader.option("header", "true").option("multiLine", str(lines_in_quotes).lower())
            rows = reader.option("mode", "PERMISSIVE").format(form).load(paths)
            reason = F.lit(FIELDS if form == "csv" else RECORD)
            given = F.struct(reason.alias("reason"), F.col(f"`{corrupt}`").alias("text"))
            bad = F.when(F.col(f"`{corrupt}`").isNotNull(), given)
        name = source_name(_decoded(F.col("_metadata.file_path")), root)
        names = [F.col(f"`{name}`") for name in columns]
        frames.append(rows.select(*names, name.alias("_source_file"), bad.alias(BAD)))
    return frames


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all readable exports below a folder, in the ledger's types.

    Values that do not fit are NULL, extra columns kept as text, and unreadable
    exports left out; with none readable the result is empty.
    """
    frames = read_exports(spark, exports(spark, discover(spark, folder)))
    if not frames:
        return spark.createDataFrame([], T.StructType([*LEDGER.fields, _SOURCE_FILE]))
    return union_aligned([cast_ledger(add_missing(rows)) for rows in frames])


def clean(rows: DataFrame, loaded_at: dt.datetime, source: Column | None = None) -> DataFrame:
    """Ledger rows ready to store: aligned, cast, stamped, and dated.

    ``source`` defaults to the rows' own ``_source_file``.
    """
    return _stamped(rows, loaded_at, source).where(F.col("Boekdatum").isNotNull())


def checked(rows: DataFrame, loaded_at: dt.datetime) -> DataFrame:
    """As ``clean``, but with all records; ``_bad`` tells those apart that cannot be stored."""
    record = F.to_json(F.struct(*[F.col(f"`{n}`") for n in rows.columns if n not in (BAD, "_source_file")]))
    if "Boekdatum" in rows.columns:  # the text is made of the records that it is kept of
        record = F.when(F.col("Boekdatum").try_cast(LEDGER["Boekdatum"].dataType).isNull(), record)
    undated = F.struct(F.lit(DATE).alias("reason"), F.col("_record").alias("text"))
    stamped = _stamped(rows.withColumn("_record", record), loaded_at)
    bad = F.coalesce(BAD, F.when(F.col("Boekdatum").isNull(), undated))
    return stamped.withColumn(BAD, bad).drop("_record")


def _stamped(rows: DataFrame, loaded_at: dt.datetime, source: Column | None = None) -> DataFrame:
    source = F.col("_source_file") if source is None else source
    return cast_ledger(add_missing(rows)).withColumns(load_metadata(source, loaded_at))


def write_rows(rows: DataFrame, path: str) -> None:
    """Export a result to Parquet."""
    rows.write.mode("overwrite").parquet(path)
