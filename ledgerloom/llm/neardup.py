"""Near-duplicate removal: SimHash components first, then MinHash bands and exact similarities.

Two texts are near copies if their SimHashes differ in at most two bits (``simhash.py``: the trie of
fingerprints joined with itself, and its components), or if the Jaccard similarity of their sets of
five-word shingles is at least ``LEAST`` (four fifths), wherever the edits lie; a fingerprint is too
coarse for the latter. ``groups`` joins the components given to it by the similarities.

Texts that share a band (``ROWS`` of
``BANDS * ROWS`` MinHash values) are candidates. At a similarity of 0.8 a pair shares one with
a probability of 1 - (1 - 0.8 ** 6) ** 20 = 0.9977, at 0.85 with 0.99995. Candidates whose
MinHash values agree too rarely for that similarity (4.5 standard deviations) are dropped
unseen, and so are those that must differ in more shingles than it allows: each text has the parities
of its shingles by the low bits of their hashes (an odd sketch), and where two texts' parities differ, at
least one shingle is in one of them only. This bound drops no similar pair. Of all others the two sets
of shingles are joined and compared exactly.

Equal texts are one node, and texts of one component are never compared. Texts of one band are not all compared with each other, but with hubs:
first each text with the hub of its bands that meets most texts, which is mostly what the others are
copies of. In the rounds that follow, each band whose texts are not yet all in one group gives as
hubs texts outside its largest group, one in the first round and four times as many in each further one;
a hub is compared with all texts of the band that are in other groups, and is then done with. This
ends when no band has two texts that were never compared and are in no common group. So a round has
as many rows as bands have texts, times its hubs; only texts that share bands and yet are in no
common group, round after round, come to be compared each with each, by which time all copies have
found their groups.

Defined results: texts without a word (null, empty or blank) have no shingles but the same fingerprint,
zero, and are copies of each other; texts of fewer words than a shingle are one shingle. Of a group the document with the smallest key stays, any other
key before null; of repeated rows one.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import simhash
from ledgerloom.llm.components import components
from ledgerloom.llm.words import forget, saved, text_of

BANDS = 20
ROWS = 6
SHINGLE = 5
LEAST = (4, 5)  # of Jaccard similarities, as a fraction
# Of 120 values, 96 agree at the least similarity, give or take 4.4.
LEAST_AGREEING = 76
PART = 4096  # shingles hashed at once
MORE_HUBS = 4  # in each round, so many times the hubs of the round before

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_FACTORS = _mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _MIX) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The different shingles of a text as numbers; of fewer words, one of them all."""
    digest = xxhash.xxh64_intdigest
    words = np.array([digest(w) for w in (text or "").encode().lower().split()], np.uint64)
    if not len(words):
        return words
    size = min(SHINGLE, len(words))
    total = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        total = _mixed(total ^ words[k : k + len(total)])
    return np.unique(total)


def sketch(text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of shingles, one number per band, and a byte of each MinHash value (in longs)."""
    return _sketch(shingles(text))


def parities(found: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles at each of a power of two of places (in longs), of which
    there are at least as many as shingles. By exclusive or, halves give the parities of half the places."""
    places = 64
    while places < len(found):
        places *= 2
    at = (found & np.uint64(places - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=places) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def _sketch(found: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), PART):
        part = found[k : k + PART, None] * _FACTORS[None, :]
        np.minimum(least, part.min(0), out=least)
    bands = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        bands = _mixed(bands ^ row)
    return len(found), bands.view(np.int64), _mixed(least).astype(np.uint8).view(np.int64)


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, digest`` (of the text), ``size``, ``bands``, ``sketch`` and ``parities`` of each row."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches):
        for batch in batches:
            sets = (shingles(t.as_py()) for t in batch.column(2))
            found = [(*_sketch(s), parities(s)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([f[0] for f in found], pa.int32()),
                    pa.array([f[1] for f in found], pa.list_(pa.int64())),
                    pa.array([f[2] for f in found], pa.list_(pa.int64())),
                    pa.array([f[3] for f in found], pa.list_(pa.int64())),
                ],
                names=["key", "digest", "size", "bands", "sketch", "parities"],
            )

    rows = docs.select(docs[key].alias("key"), _digest(text).alias("digest"), docs[text].alias("text"))
    return rows.mapInArrow(
        work,
        f"key {kind}, digest binary, size int, bands array<long>, sketch array<long>, parities array<long>",
    )


def _digest(text: str) -> Column:
    return F.unhex(F.md5(text_of(text)))


def _may_be_alike() -> Column:
    """Whether ``size``, ``sketch`` and ``parities`` of ``a`` and ``b`` allow the least similarity."""

    def differing(k: int) -> Column:
        x = F.get("sketch_a", F.lit(k)).bitwiseXOR(F.get("sketch_b", F.lit(k)))
        for shift, mask in ((4, 0x0F), (2, 0x03), (1, 0x01)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask * 0x0101010101010101))
        return F.bit_count(x)

    different = reduce(lambda x, y: x + y, [differing(k) for k in range(BANDS * ROWS // 8)])
    n, of = LEAST
    sizes = F.least("size_a", "size_b") * of >= F.greatest("size_a", "size_b") * n
    parted = _parted("parities_a", "parities_b") * (of + n) <= (F.col("size_a") + F.col("size_b")) * (of - n)
    return sizes & (different <= BANDS * ROWS - LEAST_AGREEING) & parted


def _parted(a: str, b: str) -> Column:
    """So many shingles at least are in one set only. One set may have twice the places of the other."""
    places = F.least(F.size(a), F.size(b))

    def folded(name: str, k: Column) -> Column:
        return F.get(name, k).bitwiseXOR(F.coalesce(F.get(name, k + places), F.lit(0)))

    return F.aggregate(
        F.sequence(F.lit(0), places - 1),
        F.lit(0),
        lambda total, k: total + F.bit_count(folded(a, k).bitwiseXOR(folded(b, k))),
    )


def _side(texts: DataFrame, name: str) -> DataFrame:
    return texts.select(
        F.col("digest").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("size", "sketch", "parities")]
    )


def shingle_sets(members: DataFrame, texts: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """``digest, shingles`` of each text that is a candidate."""

    def work(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # a set can be long
                found = shingles(batch.column(1)[k].as_py()).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1), pa.array([found], pa.list_(pa.int64()))],
                    names=["digest", "shingles"],
                )

    wanted = texts.join(members.select("digest").distinct(), "digest").select(
        F.col("digest").alias("_wanted"), F.col("smallest").alias("_smallest")
    )
    rows = docs.select(F.col(key).alias("_key"), _digest(text).alias("digest"), F.col(text).alias("text"))
    rows = rows.join(
        wanted, (F.col("digest") == F.col("_wanted")) & F.col("_key").eqNullSafe(F.col("_smallest")), "left_semi"
    )
    sets = rows.select("digest", "text").mapInArrow(work, "digest binary, shingles array<long>")
    return sets.dropDuplicates(["digest"])


def exactly_alike(links: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` whose sets of shingles have the least similarity."""
    of = lambda s: sets.select(F.col("digest").alias(s), F.col("shingles").alias(f"set_{s}"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    all_ = F.size("set_a") + F.size("set_b") - both
    n, of_ = LEAST
    alike = links.join(of("a"), "a").join(of("b"), "b").where(both * of_ >= all_ * n)
    return alike.select("a", "b")


def by_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``digest, root`` of each different text that a chain of near SimHashes joins to another."""
    named = docs.select(_digest(text).alias("digest"), F.col(text).alias("text"))
    found = simhash.near_duplicates(named, key="digest", text="text")
    found = found.select("digest", F.col("component_id").alias("root"))
    return saved(found.where("digest != root").distinct(), "near-fingerprints")


def groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", roots: DataFrame | None = None
) -> DataFrame:
    """``digest, smallest, root`` of each different text: texts of one root are one group.

    ``roots`` has the ``digest, root`` of texts that are known to belong together."""
    rows = saved(sketches(docs, key, text), "near-sketches")
    texts = saved(
        rows.groupBy("digest").agg(
            F.min("key").alias("smallest"),
            *[F.first(name).alias(name) for name in ("size", "bands", "sketch", "parities")],
        ),
        "near-texts",
    )
    forget(rows)
    prints = texts.where("size > 0").select("digest", F.posexplode("bands").alias("band", "value"))
    shared = prints.groupBy("band", "value").agg((F.count("*") - 1).alias("others"))
    members = saved(prints.join(shared.where("others > 0"), ["band", "value"]), "near-members")
    met = members.groupBy("digest").agg(F.sum("others").alias("met"))
    bands = saved(members.drop("others").join(met, "digest"), "near-bands")
    sets = saved(shingle_sets(members, texts, docs, key, text), "near-sets")
    forget(members)

    links = saved(_stars(bands, texts, roots), "near-stars")
    alike = saved(exactly_alike(links, sets), "near-alike")
    forget(links)
    if roots is None:
        roots = components(alike).withColumnRenamed("node", "digest")
    elif not alike.isEmpty():
        roots = _joined(roots, alike)
    hubs = 1
    while True:
        rooted = saved(_open(_rooted(bands, roots)), "near-open")
        if rooted.isEmpty():
            break
        pairs, left = _met_by_hubs(rooted, texts, hubs)
        links = saved(pairs, "near-candidates")
        bands = saved(left, "near-bands")
        found = saved(exactly_alike(links, sets), "near-alike")
        if not found.isEmpty():
            roots = _joined(roots, found)
        forget(links, rooted)
        hubs *= MORE_HUBS
    forget(bands, rooted, sets)
    return _rooted(texts, roots).select("digest", "smallest", "root")


def _rooted(rows: DataFrame, roots: DataFrame, name: str = "digest") -> DataFrame:
    """The rows with the root of their text: the text itself, if it has no other."""
    of = roots.select(F.col("digest").alias(name), "root")
    return rows.join(of, name, "left").withColumn("root", F.coalesce("root", name))


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The roots of all texts after further links: only groups are joined, not texts anew."""
    a = _rooted(links, roots, "a").withColumnRenamed("root", "root_a")
    both = _rooted(a, roots, "b").select(F.col("root_a").alias("a"), F.col("root").alias("b"))
    step = components(both).select(F.col("node").alias("before"), F.col("root").alias("after"))
    known = roots.join(step, roots["root"] == step["before"], "left").select(
        "digest", F.coalesce("after", "root").alias("root")
    )
    # Texts that had no link are roots of their own, of which the step knows what they are now.
    new = step.join(roots, step["before"] == roots["digest"], "left_anti").select(
        F.col("before").alias("digest"), F.col("after").alias("root")
    )
    return saved(known.union(new), "near-roots")


def _stars(bands: DataFrame, texts: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Of each text, the pair with the hub of its bands that meets most texts, if of another root."""
    hub = bands.groupBy("band", "value").agg(F.max(F.struct("met", "digest")).alias("hub"))
    best = bands.join(hub, ["band", "value"]).groupBy("digest").agg(F.max("hub").alias("hub"))
    pairs = best.select(F.col("hub.digest").alias("a"), F.col("digest").alias("b")).where("a != b")
    if roots is not None:
        of_a = _rooted(pairs, roots, "a").withColumnRenamed("root", "root_a")
        pairs = _rooted(of_a, roots, "b").where("root_a != root")
    may_be = pairs.join(_side(texts, "a"), "a").join(_side(texts, "b"), "b").where(_may_be_alike())
    return may_be.select("a", "b")


def _open(rooted: DataFrame) -> DataFrame:
    """The texts of bands that are not all of one root, with ``outside``: how many of the band's
    texts are not of its most frequent root, ``main``."""
    counted = rooted.groupBy("band", "value", "root").agg(F.count("*").alias("n"))
    mixed = counted.groupBy("band", "value").agg(
        F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all")
    )
    mixed = mixed.select(
        "band", "value", F.col("most.root").alias("main"), (F.col("all") - F.col("most.n")).alias("outside")
    )
    return rooted.join(mixed.where("outside > 0"), ["band", "value"])


def _met_by_hubs(rooted: DataFrame, texts: DataFrame, hubs: int) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a, b`` of the hubs of each band with its texts of other roots that may be alike; and
    the texts of bands, without these hubs, that have more texts outside their main root."""
    order = Window.partitionBy("band", "value").orderBy(F.col("met").desc(), "digest")
    chosen = rooted.where("root != main").withColumn("rank", F.row_number().over(order))
    chosen = saved(chosen.where(F.col("rank") <= hubs).select("band", "value", "digest", "root", "rank"), "near-hubs")
    a = chosen.select(
        "band", "value", F.col("digest").alias("a"), F.col("root").alias("root_a"), F.col("rank").alias("rank_a")
    ).join(_side(texts, "a"), "a")
    b = rooted.join(chosen.select("band", "value", "digest", "rank"), ["band", "value", "digest"], "left").select(
        "band", "value", F.col("digest").alias("b"), F.col("root").alias("root_b"), F.col("rank").alias("rank_b")
    ).join(_side(texts, "b"), "b")
    once = F.col("rank_b").isNull() | (F.col("rank_a") < F.col("rank_b"))  # two hubs meet once
    pairs = a.join(b, ["band", "value"]).where((F.col("root_a") != F.col("root_b")) & once & _may_be_alike())
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = rooted.where(F.col("outside") > hubs).join(
        chosen.select("band", "value", "digest"), ["band", "value", "digest"], "left_anti"
    )
    return pairs, left.select("digest", "band", "value", "met")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of copies and near copies."""
    found = groups(docs, key, text, by_fingerprint(docs, text))
    first = F.struct(F.col("smallest").isNull().alias("no_key"), "smallest", "digest")
    kept = saved(found.groupBy("root").agg(F.min(first).alias("first")), "near-kept").select(
        F.col("first.digest").alias("_digest"), F.col("first.smallest").alias("_smallest")
    )
    named = docs.withColumn("_text_digest", _digest(text))
    rows = named.join(
        kept,
        (named["_text_digest"] == kept["_digest"]) & named[key].eqNullSafe(kept["_smallest"]),
    )
    return rows.dropDuplicates(["_text_digest", key]).select(*docs.columns)
