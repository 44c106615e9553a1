"""Shards in random order, by a shuffle in two passes.

First every record is scattered by seeded hashes: to a shard, which the key and the number of
shards decide, and within it to a bucket. Then each bucket is shuffled and written: its records are
sorted and ranked, the ranks are shuffled (Spark's ``shuffle`` of an array is Fisher-Yates), and each
record takes the place of its rank. Records are only sorted and joined, which can spill; the
arrays hold one number per record. Nothing but the buckets' counts is needed to number the
records of a shard without gaps.

Each bucket is a partition of its own, whose number is that of shard and bucket. Spark seeds a shuffle by the given seed and the number of the
partition, so the order follows from the seed, whatever the session's settings, and a task that
is run again gives the same order.

The shard is the one of largest seeded hash (rendezvous hashing), so that one more shard
takes rows only into itself. Copies of a text differ in their keys and are spread over
buckets; only rows alike in key, size and text share one.

Defined results: a null text has size 1 and the checksum of an empty one, and is written as
null; a null key is a key. Repeated rows each get a slot. Extra columns are written too; a
column with the name of a result is replaced by the result.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.words import text_of
from ledgerloom.session import new_folder

LAW = "key"
SEED = 20
BUCKET_BYTES = 32 * 1024 * 1024


def rendezvous(key: str, shards: int) -> Column:
    """The shard with the largest hash of shard and key."""
    drawn = [
        F.struct(F.xxhash64(F.lit(SEED), F.col(key), F.lit(shard)).alias("h"), F.lit(shard).alias("s"))
        for shard in range(shards)
    ]
    return F.greatest(*drawn)["s"]


def sized(text: str) -> dict[str, Column]:
    return {
        "size": (F.octet_length(text_of(text)) + 1).cast("bigint"),
        "text_crc32": F.crc32(text_of(text).cast("binary")),
    }


def write_shards(
    docs: DataFrame,
    path: str,
    shards: int = 8,
    bucket_bytes: int = BUCKET_BYTES,
    key: str = "doc_id",
    text: str = "text",
) -> None:
    """Write the rows in folders ``shard=<n>``, in files by bucket, in their new order.

    Adds ``size``, ``text_crc32``, ``grown_shard``, ``bucket`` and ``place`` (in the bucket).
    """
    total = docs.agg(F.sum(sized(text)["size"])).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    columns = [
        *[name for name in docs.columns if name not in RESULTS],
        "size",
        "text_crc32",
        "grown_shard",
    ]
    # Of rows that agree in these, the other columns decide; maps have no hash.
    others = [f.name for f in docs.schema if f.name not in RESULTS and "map<" not in f.dataType.simpleString()]
    scattered = (
        docs.withColumns(sized(text))
        .withColumns(
            {
                "shard": rendezvous(key, shards),
                "grown_shard": rendezvous(key, shards + 1),
                "_order": F.xxhash64(F.lit(SEED + 1), F.col(key), "size", "text_crc32"),
                "_tie": F.xxhash64(F.lit(SEED + 1), *others),
            }
        )
        .withColumn(
            "_bucket",
            F.col("shard") * buckets + F.pmod(F.xxhash64(F.lit(SEED + 2), "_order"), F.lit(buckets)).cast("int"),
        )
        .repartitionById(shards * buckets, F.col("_bucket"))
    )
    # A bucket is a partition, so the number in the partition is the rank.
    ranked = scattered.sortWithinPartitions("_order", "_tie").withColumn(
        "_rank", F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).cast("int")
    )
    places = (
        scattered.groupBy("_bucket")
        .agg(F.count("*").cast("int").alias("n"))
        .select("_bucket", F.shuffle(F.sequence(F.lit(0), F.col("n") - 1), SEED).alias("ranks"))
        .select("_bucket", F.posexplode("ranks").alias("place", "_rank"))
    )
    changed = F.raise_error(F.lit("the rows are not the same when read again")).cast("int")
    (
        # As many places as records: never to be broadcast.
        ranked.join(places.hint("merge"), ["_bucket", "_rank"], "left")
        .select(
            *columns,
            F.floor(F.col("_bucket") / buckets).cast("int").alias("shard"),
            (F.col("_bucket") % buckets).alias("bucket"),
            F.coalesce("place", changed).alias("place"),
        )
        .sortWithinPartitions("shard", "bucket", "place")
        .write.partitionBy("shard")
        .parquet(path)
    )


RESULTS = {"shard", "bucket", "place", "slot", "grown_shard", "law", "size", "text_crc32", "_order", "_tie", "_bucket", "_rank"}


def read_shards(docs: DataFrame, path: str) -> DataFrame:
    """The written rows with ``slot``, their place in the shard, from 0 without a gap."""
    spark = docs.sparkSession
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in RESULTS]
    added = "size long, text_crc32 long, grown_shard int, bucket int, place int, shard int"
    rows = spark.read.schema(", ".join([*fields, added])).parquet(path)
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    before = counts.select(
        "shard",
        "bucket",
        F.expr(
            "coalesce(sum(rows) OVER (PARTITION BY shard ORDER BY bucket"
            " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
        ).alias("before"),
    )
    return rows.join(before, ["shard", "bucket"]).withColumn(
        "slot", F.col("before") + F.col("place")
    )


def sharded(
    docs: DataFrame,
    shards: int = 8,
    bucket_bytes: int = BUCKET_BYTES,
    key: str = "doc_id",
    text: str = "text",
    path: str | None = None,
) -> DataFrame:
    """Writes the shards (below the shared folder if no path is given) and reads them."""
    path = path or new_folder(docs.sparkSession, "shards")
    write_shards(docs, path, shards, bucket_bytes, key, text)
    return read_shards(docs, path).withColumn("law", F.lit(LAW))
