"""Document fingerprints: one-permutation MinHash of word shingles, packed to a few bits.

Each shingle is hashed once. The hash's first bits choose a bin, and a bin keeps its smallest
hash; sorting a text's hashes puts each bin's smallest first. Empty bins take the value of a
bin that is not empty: each has a fixed order of its own in which it tries the others. That order
is an arithmetic progression with a start and a stride drawn per bin, where optimal densification
draws a hash for each try. Of each bin the low bits are stored. Two fingerprints' likeness is their
share of equal bins, corrected for bins that are equal by chance.

All of it is SQL functions over one row's arrays; there is no shuffle.

Defined results: a null text counts as empty. A text without a word has an empty fingerprint,
which is like (1) another empty one and unlike (0) all others. A text of fewer words than a
shingle is one shingle. Rows with equal texts have equal fingerprints.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.words import saved, text_of, words_of

SHINGLE = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
LOW_BITS = 8
CHANCE = 2.0**-LOW_BITS

_DRAWN = random.Random(11)
# Where a bin begins to look, and the odd stride that leads it past all others.
_STARTS = [_DRAWN.randrange(BINS) for _ in range(BINS)]
_STRIDES = [_DRAWN.randrange(BINS) | 1 for _ in range(BINS)]


def _integers(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def fingerprint(text: Column) -> Column:
    """The packed fingerprint of a text, as binary of one byte per bin."""
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    return let(F.transform(words_of(text), lambda w: F.xxhash64(w)), _of_words)


def _of_words(words: Column) -> Column:
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - SHINGLE, F.lit(0)))
    # Beyond the end there is null, which adds nothing to a hash.
    hashes = F.transform(
        starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)])
    )
    packed = let(F.sort_array(hashes), lambda ordered: let(_smallest(ordered), _packed))
    return F.when(F.size(words) > 0, packed).otherwise(F.lit(b""))


def _bin(value: Column) -> Column:
    return F.shiftrightunsigned(value, 64 - BIN_BITS)


def _smallest(ordered: Column) -> Column:
    """The first of each bin's hashes."""
    return F.filter(
        ordered, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(ordered, i - 1)))
    )


def _packed(smallest: Column) -> Column:
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    bins = F.transform(smallest, lambda h: _bin(h).cast("int"))
    numbers = F.sequence(F.lit(0), F.lit(BINS - 1))
    dense = let(
        bins,
        lambda b: F.transform(
            numbers,
            lambda n: F.get(smallest, F.array_position(b, n).cast("int") - 1).bitwiseAND(
                F.lit((1 << LOW_BITS) - 1)
            ),
        ),
    )
    return let(dense, _densified)


def _densified(dense: Column) -> Column:
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    numbers = F.sequence(F.lit(0), F.lit(BINS - 1))

    def tried(start: Column, stride: Column) -> Column:
        # Evaluated from the left, and no further than the first that is not empty.
        return F.coalesce(
            *[
                F.get(dense, (start + stride * k).bitwiseAND(F.lit(BINS - 1)))
                for k in range(BINS)
            ],
        )

    def filled(n: Column, starts: Column, strides: Column) -> Column:
        return F.coalesce(
            F.get(dense, n),
            let(
                F.get(starts, n),
                lambda start: let(F.get(strides, n), lambda stride: tried(start, stride)),
            ),
        )

    # The tables are made once per text: a place in a lambda would make them for each look.
    bins = let(
        _integers(_STARTS),
        lambda starts: let(
            _integers(_STRIDES),
            lambda strides: F.transform(numbers, lambda n: filled(n, starts, strides)),
        ),
    )
    return F.unhex(F.array_join(F.transform(bins, lambda v: F.lpad(F.hex(v), 2, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles, from 0 to 1."""
    equal = F.aggregate(
        F.sequence(F.lit(1), F.lit(BINS)),
        F.lit(0),
        lambda n, i: n + (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))).cast("int"),
    )
    corrected = (equal / F.lit(float(BINS)) - CHANCE) / (1 - CHANCE)
    return (
        F.when((F.octet_length(a) == 0) & (F.octet_length(b) == 0), F.lit(1.0))
        .when((F.octet_length(a) == 0) | (F.octet_length(b) == 0), F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), corrected)))
    )


def fingerprinted(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """The rows with their fingerprint as a hexadecimal string."""
    return docs.withColumn(name, F.lower(F.hex(fingerprint(text_of(text)))))


def compared_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's fingerprint against those of an edited text and of the next document.

    The next document is that of the next smaller key (null keys last); after the last comes
    the first. The edited text has its last third replaced by the beginning of the next one.
    Rows alike in key and text count as one document here: all get the same results. Rows of
    one key with different texts follow each other in the order of their texts' hashes.

    Keys alone are put in order. A text is shuffled once by its row's name; what an edited
    text needs of the next one, once more.
    """
    text_ = text_of(text)
    rows = docs.select(F.col(key).alias("key"), text_.alias("text")).withColumn(
        "row",
        F.concat_ws(
            ":", F.coalesce(F.col("key").cast("string"), F.lit("null")), F.xxhash64("text"), F.length("text")
        ),
    )
    prints = saved(
        rows.select("key", "row", F.length("text").alias("size"), fingerprint(F.col("text")).alias("print")),
        "minhash",
    )
    following = saved(_neighbours(prints.select("key", "row", "size").distinct()), "minhash-order")
    own = prints.select("row", "key", "print").dropDuplicates(["row"])
    # Both uses need just these columns of the texts, so that one shuffle serves both.
    known = rows.select("row", "text").join(following.join(own, "row"), "row")
    beginnings = (
        known.select(
            F.col("before").alias("row"),
            F.substr("text", F.lit(1), F.floor(F.col("size_before") / 3).cast("int")).alias("tail"),
            F.col("print").alias("next_print"),
        )
        .groupBy("row")
        .agg(F.first("tail").alias("tail"), F.first("next_print").alias("next_print"))
    )
    size = F.length("text")
    edited = F.concat(
        F.substr("text", F.lit(1), (size - F.floor(size / 3)).cast("int")), F.col("tail")
    )
    return (
        known.select("row", "key", "text", "print")
        .join(beginnings, "row")
        .withColumn("edited", edited)
        .withColumn("edited_print", fingerprint(F.col("edited")))
        .select(
            F.col("key").alias(key),
            size.cast("bigint").alias("n_chars"),
            F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            F.lower(F.hex("print")).alias("fingerprint"),
            F.lower(F.hex("edited_print")).alias("edited_fingerprint"),
            likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
            likeness(F.col("print"), F.col("next_print")).alias("near_next"),
        )
    )


def _neighbours(rows: DataFrame) -> DataFrame:
    """``row``, and the row that it follows (``before``) with its ``size_before``.

    Rows are put in ranges of keys; a window looks within a range, and the ranges' first and
    last rows, one of each per range, are matched among themselves.
    """
    order = [F.col("key").desc_nulls_last(), F.col("row").desc()]
    ranged = saved(
        rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()),
        "minhash-ranges",
    )
    within = Window.partitionBy("range").orderBy(*order)
    placed = saved(
        ranged.select(
            "row",
            "size",
            "range",
            F.lag("row").over(within).alias("before"),
            F.lag("size").over(within).alias("size_before"),
            F.lead("row").over(within).isNull().alias("last"),
        ),
        "minhash-placed",
    )
    # One row per range: few enough for one task. The first range follows the last one.
    ranges = placed.where("last").select("range", F.struct("row", "size").alias("end"))
    whole = Window.orderBy("range")
    last_of_all = F.last("end").over(whole.rowsBetween(0, Window.unboundedFollowing))
    ends = ranges.select(
        "range", F.coalesce(F.lag("end").over(whole), last_of_all).alias("end_before")
    )
    return placed.join(ends, "range").select(
        "row",
        F.coalesce("before", F.col("end_before.row")).alias("before"),
        F.coalesce("size_before", F.col("end_before.size")).alias("size_before"),
    )
