"""SimHash near-duplicates: fingerprints, near pairs by a trie self-join, their components.

Defined results: a null or empty text has fingerprint zero and is linked like any other;
a text of fewer words than a shingle is one shingle. Documents with equal fingerprints are
one class, so a group of copies of any size is one node of the trie. Repeated rows stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.trie import near_pairs
from ledgerloom.llm.words import saved

SEED = 42


def shingles(text: str | None, size: int) -> list[bytes]:
    """Shingles of the text's words, with A to Z in lower case; repeats are kept."""
    words = (text or "").encode().lower().split()  # bytes know ASCII only
    if not words:
        return []
    space = b" ".join
    return [space(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]


def majority(hashes: np.ndarray) -> np.ndarray:
    """Rows of big-endian 64-bit hashes to one row: bits set in over half of them."""
    if not len(hashes):
        return np.zeros(hashes.shape[1], ">u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(len(hashes), -1), axis=1)
    return np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hashes)).view(">u8")


def fingerprint(text: str | None, size: int = 3) -> int:
    """The fingerprint as a signed 64-bit number."""
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles(text, size)], ">u8").reshape(-1, 1)
    return int(majority(hashes).astype(np.uint64).view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fingerprint`` (long) of each row."""
    kind = docs.schema[key].dataType

    def work(batches):
        for batch in batches:
            prints = [fingerprint(t.as_py(), size) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints, pa.int64())], names=["key", "fingerprint"]
            )

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    result = rows.mapInArrow(work, f"key {kind.simpleString()}, fingerprint long")
    return result.withColumnRenamed("key", key)


def near_duplicates(
    docs: DataFrame, size: int = 3, radius: int = 2, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, fingerprint, component_id`` of each row.

    Rows belong together if a chain of fingerprints, each at most ``radius`` bits from the
    next, leads from one to the other. The component is named after its smallest key.
    """
    rows = saved(fingerprints(docs, size, key, text), "simhash")
    classes = saved(
        rows.groupBy("fingerprint").agg(F.min(key).alias("smallest")), "simhash-classes"
    )
    prints = classes.select(F.lit(0).alias("table"), "fingerprint")
    roots = components(near_pairs(prints, radius))
    linked = classes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    linked = saved(linked, "simhash-roots")
    smallest = (
        linked.where(F.col("root").isNotNull())
        .groupBy("root")
        .agg(F.min("smallest").alias("component_id"))
    )
    smallest = saved(smallest, "simhash-smallest")
    named = saved(
        linked.join(smallest, "root", "left").select(
            "fingerprint", F.coalesce("component_id", "smallest").alias("component_id")
        ),
        "simhash-components",
    )
    return rows.join(named, "fingerprint").select(key, "fingerprint", "component_id")


def hexadecimal(fingerprint):
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
