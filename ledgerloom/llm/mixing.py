"""Mixing sources to target weights by Poisson replication.

A source's target share of the mixture over its size is its rate: how often each of its
documents is wanted on average. Each document draws its count from a Poisson distribution of
that mean, by inverting the distribution at a number that a seeded hash of the document
gives, is repeated that often, and all copies are shuffled by another hash.

Rates above a bound are split over several draws whose sum has the wanted distribution, so
that the cumulative probabilities of one draw fit a short array for any rate.

Defined results: a null source is a source of its own; a null or empty text has size 0 and
is drawn like others of its source; if all of a source's texts are empty its rate is 0.
Repeated rows draw the same count; a row without a key draws by its text. Extra columns stay; a
column with the name of a result is replaced by the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.words import saved, text_of

SEED = 7
ALPHA = 0.7  # target share of a source without a given weight: size ** ALPHA
EPOCHS = 1.0  # size of the mixture over the size of the input
MEAN_OF_DRAW = 4.0
TERMS = 40  # of a draw of mean 4, all but 1e-26 lies below
HEX = 2.0**52  # the hash's first 13 hexadecimal digits as a number below 1


def uniform(*parts) -> Column:
    """A number from 0 to below 1, drawn by hashing the seed and the parts."""
    digest = F.md5(F.concat_ws(":", F.lit(SEED), *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / HEX


def rates(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    epochs: float = EPOCHS,
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """Per source: ``size`` (characters), ``rate``, ``draws`` and a draw's ``cumulative``.

    ``weights`` names target weights; sources it does not name weigh size ** ``ALPHA``.
    """
    size = F.sum(F.length(text_of(text)).cast("bigint"))
    sources = docs.groupBy(F.col(source).alias("_source")).agg(size.alias("size"))
    weight = F.pow(F.col("size").cast("double"), F.lit(ALPHA))
    for name, value in (weights or {}).items():
        weight = F.when(F.col("_source") == name, F.lit(float(value))).otherwise(weight)
    weighed = saved(sources.withColumn("weight", weight), "mixing-sources")
    whole = weighed.agg(
        F.sum("size").alias("all_sizes"), F.sum("weight").alias("all_weights")
    ).first()
    rate = F.when(
        F.col("size") > 0,
        F.lit(epochs * (whole.all_sizes or 0))
        * (F.col("weight") / F.lit(whole.all_weights or 1.0))
        / F.col("size"),
    ).otherwise(F.lit(0.0))
    mean = F.col("rate") / F.col("draws")
    # Terms of the distribution one after another, each added to those before.
    cumulative = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.struct(F.exp(-mean).alias("term"), F.array(F.exp(-mean)).alias("sums")),
        lambda seen, k: F.struct(
            (seen["term"] * mean / k).alias("term"),
            F.concat(
                seen["sums"],
                F.array(F.element_at(seen["sums"], -1) + seen["term"] * mean / k),
            ).alias("sums"),
        ),
        lambda seen: seen["sums"],
    )
    return (
        weighed.withColumn("rate", rate)
        .withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / MEAN_OF_DRAW)).cast("int"))
        .withColumn("cumulative", cumulative)
        .select("_source", "size", "weight", "rate", "draws", "cumulative")
    )


def mixed(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    epochs: float = EPOCHS,
    source: str = "source",
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The rows of the mixture in random order, with ``copy`` (from 1), ``n_copies``,
    ``rate`` and ``shuffle_key``.

    The table of rates is written first, so that it is joined by its measured size: sent to
    all tasks if small, else shuffled, where adaptive execution splits a large source.
    """
    table = saved(rates(docs, weights, epochs, source, text), "mixing-rates").select(
        "_source", "rate", "draws", "cumulative"
    )
    unnamed = F.concat(F.lit("null:"), F.md5(text_of(text)))
    named = F.coalesce(F.col(key).cast("string"), unnamed)
    below = lambda draw: F.size(
        F.filter("cumulative", lambda c: c <= uniform(named, draw.cast("string")))
    )
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("draws")), F.lit(0), lambda sum_, draw: sum_ + below(draw)
    )
    shuffle_key = F.conv(
        F.substring(
            F.md5(F.concat_ws(":", F.lit(SEED + 1), named, F.col("copy").cast("string"))), 1, 15
        ),
        16,
        10,
    ).cast("bigint")
    plain = docs.drop("rate", "n_copies", "copy", "shuffle_key", "draws", "cumulative", "_source")
    return (
        plain.join(table, plain[source].eqNullSafe(table["_source"]))
        .withColumn("n_copies", count)
        .where(F.col("n_copies") > 0)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
        .withColumn("shuffle_key", shuffle_key)
        .drop("_source", "draws", "cumulative")
        .repartition("shuffle_key")
        .sortWithinPartitions("shuffle_key")
    )
