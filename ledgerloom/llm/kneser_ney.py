"""Quality by perplexity: an interpolated modified Kneser-Ney model of letters.

The model is of sequences of ``ORDER`` characters, one per language, and is learned from
trusted texts. A document's perplexity under its language's model is compared with a
quantile of the perplexities of trusted documents in that language that are held out from the
counts: what is counted looks less perplexing than other texts of the same quality.

Work goes by blocks of documents. Each block lists its different n-grams once, with their
counts in trusted texts. All counts, continuation counts and context sums are made by
aggregations over these lists, and the probability of every n-gram that occurs is found by
joins with them, one level of the model after the other. The probabilities go back to the
blocks, where the documents are scored: they wait packed, in a table bucketed by block, so that
only lists of n-grams are shuffled. What is gathered grows with the corpus, and none of it passes
through the driver or one task. A table is deleted when nothing reads it any more.

Defined results: text is taken with its white space as single blanks. A text without a
character has no perplexity and is not kept. A language (a null one is a language of its own)
without trusted text has no model: its documents have no perplexity and are kept. If none of
a language's trusted texts is held out, the counted ones set its threshold; if all are, it has
no model. Repeated
rows are counted and scored each. Extra columns are not read.
"""

from __future__ import annotations

import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.words import Bucketed, forget, saved

ORDER = 4
QUANTILE = 0.97
HELD_OUT = 5  # one in so many trusted texts is not counted, but sets the threshold
BLOCK_CHARS = 10_000_000
PART_CHARS = 2_000_000  # n-grams of so many characters are numbered at once
SMALL_IDS = 2_000_000  # trusted keys that are sent to all tasks; more are joined by a shuffle
BEFORE, AFTER = "\x02", "\x03"
NO_LANGUAGE = "\x00"  # stands for null


def prepared(text: str | None) -> str:
    """The text between marks of its beginning and end; empty if it has no character."""
    words = (text or "").split()
    return BEFORE * (ORDER - 1) + " ".join(words) + AFTER if words else ""


class Grams:
    """The n-grams of some prepared texts as numbers, in order, and what they spell."""

    def __init__(self, texts: list[str], also: str = ""):
        points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
        spare = np.frombuffer(also.encode("utf-32-le", "replace"), np.uint32)
        self.alphabet = np.unique(np.concatenate([_distinct(points), _distinct(spare)]))
        self.fits = len(self.alphabet) ** ORDER < 2**62
        sizes = np.array([len(t) for t in texts], np.int64)
        counts = np.maximum(sizes - ORDER + 1, 0)
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
        starts = np.repeat(np.cumsum(sizes) - sizes, counts)
        at = starts + np.arange(len(self.text)) - np.repeat(np.cumsum(counts) - counts, counts)
        if self.fits:
            place = np.searchsorted(self.alphabet, points).astype(np.int32)
            self.numbers = place[at].astype(np.int64)
            for k in range(1, ORDER):
                self.numbers *= len(self.alphabet)
                self.numbers += place[at + k]
        else:
            self.numbers = self.pack(np.stack([points[at + k] for k in range(ORDER)], axis=1))

    def pack(self, points: np.ndarray) -> np.ndarray:
        """Rows of code points as one sortable value each."""
        if not self.fits:  # too many different characters: compare them as bytes
            rows = np.ascontiguousarray(points.astype(">u4"))
            return rows.view(f"V{4 * ORDER}").ravel()
        place = np.searchsorted(self.alphabet, points)
        return place @ (len(self.alphabet) ** np.arange(ORDER - 1, -1, -1, dtype=np.int64))

    def spelled(self, numbers: np.ndarray) -> list[str]:
        if not self.fits:
            points = numbers.view(">u4").reshape(-1, ORDER)
        else:
            base = len(self.alphabet)
            place = numbers[:, None] // base ** np.arange(ORDER - 1, -1, -1, dtype=np.int64) % base
            points = self.alphabet[place]
        whole = np.ascontiguousarray(points.astype("<u4")).tobytes().decode("utf-32-le")
        return [whole[k : k + ORDER] for k in range(0, len(whole), ORDER)]


def _distinct(points: np.ndarray) -> np.ndarray:
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    return np.flatnonzero(seen).astype(np.uint32)


BLOCKS = "block long, lang string, gram string, n long, documents binary"


def _blocks(batches):
    """Per block: its n-grams with trusted counts, and its documents, packed."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        begin = 0
        lengths = [len(t.as_py() or "") for t in batch.column(1)]
        for end, length in enumerate(lengths, 1):
            size += length
            if size >= BLOCK_CHARS:
                waiting.append(batch.slice(begin, end - begin))
                yield from _block(waiting)
                waiting, size, begin = [], 0, end
        if begin < batch.num_rows:
            waiting.append(batch.slice(begin))
    if waiting:
        yield from _block(waiting)


def _block(batches: list[pa.RecordBatch]):
    table = pa.Table.from_batches(batches)
    block = secrets.randbits(62)
    langs = np.array([NO_LANGUAGE if x is None else x for x in table.column("lang").to_pylist()], object)
    trusted = np.array(table.column("trusted").to_pylist(), bool)
    texts = [prepared(t) for t in table.column("text").to_pylist()]
    for lang in sorted(set(langs)):
        mine = np.flatnonzero(langs == lang)
        listed: dict[str, int] = {}
        for part in _parts(mine, texts):
            grams = Grams([texts[k] for k in part])
            numbers = np.unique(grams.numbers)
            counted, times = np.unique(grams.numbers[trusted[part][grams.text]], return_counts=True)
            n = np.zeros(len(numbers), np.int64)
            n[np.searchsorted(numbers, counted)] = times
            for gram, more in zip(grams.spelled(numbers), n.tolist()):
                listed[gram] = listed.get(gram, 0) + more
        yield _rows(block, lang, list(listed), list(listed.values()), None)
    keys = pa.table({"key": table.column("key"), "lang": langs.tolist(), "text": texts})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, keys.schema) as writer:
        writer.write_table(keys)
    plain = sink.getvalue()
    packed = pa.Codec("zstd", compression_level=9).compress(plain, asbytes=True)
    yield _rows(block, None, [None], [None], plain.size.to_bytes(8, "little") + packed)


def _parts(places: np.ndarray, texts: list[str]):
    """The places, some at a time, by the length of their texts."""
    sizes = np.cumsum([len(texts[k]) for k in places])
    cuts = np.flatnonzero(np.diff(sizes // PART_CHARS)) + 1
    return np.split(places, cuts)


def _rows(block: int, lang: str | None, grams: list, n, documents: bytes | None) -> pa.RecordBatch:
    size = len(grams)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(size, block, np.int64)),
            pa.array([lang] * size, pa.string()),
            pa.array(grams, pa.string()),
            pa.array(n, pa.int64()),
            pa.array([documents] * size, pa.binary()),
        ],
        names=["block", "lang", "gram", "n", "documents"],
    )


def unpacked(documents: bytes) -> pa.Table:
    size = int.from_bytes(documents[:8], "little")
    plain = pa.Codec("zstd").decompress(documents[8:], decompressed_size=size)
    return pa.ipc.open_stream(plain).read_all()


def probabilities(counts: DataFrame) -> DataFrame:
    """``lang, gram, p`` of every n-gram in ``counts`` (``lang, gram, n``; n in trusted texts),
    for languages that have trusted text."""
    levels = {ORDER: counts.where(F.col("n") > 0)}
    wanted = {ORDER: counts.select("lang", "gram")}
    for k in range(ORDER, 1, -1):
        shorter = F.substring("gram", 2, k - 1).alias("gram")
        levels[k - 1] = saved(
            levels[k].groupBy("lang", shorter).agg(F.count("*").alias("n")), "grams-continued"
        )
        wanted[k - 1] = saved(wanted[k].select("lang", shorter).distinct(), "grams-wanted")
    # Below the lowest level, all known characters and one unknown are alike.
    known = levels[1].groupBy("lang").agg((1 / (F.count("*") + 1)).alias("p_shorter"))
    p = None
    for k in range(1, ORDER + 1):
        level = levels[k]
        times = lambda t: F.count_if(F.col("n") == t)
        discounts = level.groupBy("lang").agg(
            *[times(t).cast("double").alias(f"t{t}") for t in (1, 2, 3, 4)]
        )
        y = F.col("t1") / (F.col("t1") + 2 * F.col("t2"))
        discount = {
            t: F.when(
                (F.col("t1") > 0) & (F.col(f"t{t}") > 0),
                F.greatest(
                    F.lit(0.0), t - (t + 1) * y * F.col(f"t{t + 1}") / F.col(f"t{t}")
                ),
            ).otherwise(F.lit(0.5 * t))
            for t in (1, 2, 3)
        }
        discounts = discounts.select("lang", *[d.alias(f"d{t}") for t, d in discount.items()])
        context = F.substring("gram", 1, k - 1)
        contexts = level.groupBy("lang", context.alias("context")).agg(
            F.sum("n").alias("total"),
            times(1).alias("once"),
            times(2).alias("twice"),
            F.count_if(F.col("n") > 2).alias("more"),
        )
        rows = (
            wanted[k]
            .withColumns({"context": context, "rest": F.substring("gram", 2, k - 1)})
            .join(level, ["lang", "gram"], "left")
            .join(contexts, ["lang", "context"], "left")
            .join(saved(discounts, "gram-discounts"), "lang")
        )
        if p is None:
            rows = rows.join(saved(known, "gram-alphabets"), "lang")
        else:
            shorter = p.select("lang", F.col("gram").alias("rest"), F.col("p").alias("p_shorter"))
            rows = rows.join(shorter, ["lang", "rest"])
        n = F.coalesce("n", F.lit(0))
        taken = F.when(n > 2, F.col("d3")).when(n == 2, F.col("d2")).when(n == 1, F.col("d1")).otherwise(0.0)
        kept_back = (
            F.col("d1") * F.col("once") + F.col("d2") * F.col("twice") + F.col("d3") * F.col("more")
        )
        value = F.when(F.col("total").isNull(), F.col("p_shorter")).otherwise(
            (F.greatest(n - taken, F.lit(0.0)) + kept_back * F.col("p_shorter")) / F.col("total")
        )
        below = p
        p = saved(rows.select("lang", "gram", value.alias("p")), "gram-probabilities")
        if below is not None:
            forget(below)
    forget(*(levels[k] for k in range(1, ORDER)), *(wanted[k] for k in range(1, ORDER)))
    return p


def _scored(kind: pa.DataType):
    def work(documents: pa.Table, grams: pa.Table) -> pa.Table:
        result = []
        known_langs = np.array(grams.column("lang").to_pylist(), object)
        known_grams = np.array(grams.column("gram").to_pylist(), object)
        known_p = np.log2(grams.column("p").to_numpy())
        for packed in documents.column("documents").to_pylist():
            table = unpacked(packed)
            langs = np.array(table.column("lang").to_pylist(), object)
            texts = table.column("text").to_pylist()
            bits = np.zeros(len(texts))
            n = np.zeros(len(texts), np.int64)
            for lang in set(langs):
                of_lang = known_langs == lang
                if not of_lang.any():
                    continue
                whole = "".join(known_grams[of_lang])
                points = np.frombuffer(whole.encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
                for mine in _parts(np.flatnonzero(langs == lang), texts):
                    grams_here = Grams([texts[k] for k in mine], whole)
                    keys = grams_here.pack(points)
                    order = np.argsort(keys)
                    at = np.searchsorted(keys[order], grams_here.numbers)
                    p = known_p[of_lang][order][at]
                    bits[mine] = -np.bincount(grams_here.text, p, len(mine))
                    n[mine] = np.bincount(grams_here.text, minlength=len(mine))
            result.append(
                pa.table(
                    {
                        "key": table.column("key").cast(kind),
                        "lang": pa.array(langs.tolist(), pa.string()),
                        "n_grams": pa.array(n),
                        "bits": pa.array(bits),
                        "has_text": pa.array([bool(t) for t in texts]),
                    }
                )
            )
        return pa.concat_tables(result)

    return work


def scored(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang"):
    """``key, lang, n_grams, perplexity, trusted, has_text`` of each row.

    ``trusted``: the keys (in a column named as ``key``) of the texts to learn from.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    ids = saved(
        trusted.select(F.col(key).alias("key")).where(F.col("key").isNotNull()).distinct()
        .withColumn("trusted", F.lit(True)),
        "trusted-keys",
    )
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    side = F.broadcast(ids) if ids.count() <= SMALL_IDS else ids
    marked = rows.join(side, "key", "left").select(
        "key", "text", "lang", F.coalesce("trusted", F.lit(False)).alias("trusted")
    )
    blocks = Bucketed(marked.mapInArrow(_blocks, BLOCKS), "block")
    lists = blocks.table().where(F.col("gram").isNotNull()).select("block", "lang", "gram", "n")
    documents = blocks.table().where(F.col("documents").isNotNull()).select("block", "documents")
    counts = saved(lists.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "gram-counts")
    p = probabilities(counts)
    forget(counts)
    grams = lists.select(F.col("block").alias("of_block"), "lang", "gram").join(p, ["lang", "gram"])
    grams = saved(grams.select("of_block", "lang", "gram", "p"), "gram-wanted")
    forget(p)
    result = (
        documents.groupBy("block")
        .cogroup(grams.groupBy("of_block"))
        .applyInArrow(
            _scored(to_arrow_type(kind)),
            f"key {kind.simpleString()}, lang string, n_grams long, bits double, has_text boolean",
        )
    )
    result = saved(result, "gram-scores")
    blocks.drop()
    forget(grams)
    perplexity = F.when(
        F.col("n_grams") > 0, F.pow(F.lit(2.0), F.col("bits") / F.col("n_grams"))
    )
    return (
        result.join(ids, "key", "left")
        .select(
            "key",
            F.nullif("lang", F.lit(NO_LANGUAGE)).alias("lang"),
            "n_grams",
            perplexity.alias("perplexity"),
            F.coalesce("trusted", F.lit(False)).alias("trusted"),
            "has_text",
        )
        .withColumnRenamed("key", key)
    )


def held_out(key: str) -> Column:
    """The trusted rows that are not counted."""
    return F.pmod(F.xxhash64(F.lit("held out"), F.col(key)), F.lit(HELD_OUT)) == 0


def judged(
    docs: DataFrame,
    trusted: DataFrame,
    quantile: float = QUANTILE,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """``key, n_grams, perplexity, threshold, kept`` of each row."""
    counted = trusted.where(~held_out(key))
    rows = scored(docs, counted, key, text, lang).join(
        trusted.where(held_out(key)).select(key).distinct().withColumn("held_out", F.lit(True)), key, "left"
    )
    rows = saved(rows, "perplexities")
    of = lambda rows_: F.percentile_approx(F.when(rows_, F.col("perplexity")), quantile, 10000)
    thresholds = (
        rows.where(F.col("trusted") | F.col("held_out"))
        .groupBy("lang")
        .agg(F.coalesce(of(F.col("held_out")), of(F.col("trusted"))).alias("threshold"))
    )
    kept = F.col("has_text") & (
        F.col("perplexity").isNull() | (F.col("perplexity") <= F.col("threshold"))
    )
    thresholds = saved(thresholds.withColumnRenamed("lang", "of_lang"), "perplexity-thresholds")
    return rows.join(thresholds, F.col("lang").eqNullSafe(F.col("of_lang")), "left").select(
        key, "n_grams", "perplexity", "threshold", F.coalesce(kept, F.lit(True)).alias("kept")
    )
