"""Removal of repeated passages: bytes of strings of 100 that a document before has too.

A window is a string of ``window`` bytes of one document. It repeats if the same string starts
earlier: in a document of smaller key, or in its own before. All bytes of such windows are removed.

The index for that is the run-length compressed Burrows-Wheeler transform of ``runindex.py``. So
that it can be built in parts, windows are dealt by their content: each belongs to the ``gram`` bytes
in it whose hash is the smallest, the leftmost of equals. Equal windows have equal grams, at the same
place; neighbouring windows mostly share theirs, and form one segment.

* Segments whose gram stands nowhere else in the corpus repeat nothing.
* Of segments that are equal as a whole, the first one stands for all; the others are repeats.
* The different segments of one gram are indexed together, some thousand grams at a time, and
  streamed through the index. It gives each window that stands at several places the first of them.
* A gram with more than ``most`` different segments, such as those of a passage that a third of all
  documents have amid other words, is dealt anew by longer grams (``GRAMS``), in the end by whole
  windows; of those, equal ones are equal segments.

Aggregates are combined before shuffles, the joins on grams have a small or one-row side per gram,
and what a part of the index holds is bounded, however often a passage stands in the corpus.
Segments and grams are told apart by 64 bits of hash each, bytes are compared in the index.

Defined results: a null or empty text has no bytes. Keys are compared as Spark orders them, nulls
first. Rows of one key are one document as far as *earlier* goes: of two places that start alike
neither is earlier, so repeated rows lose the same bytes, and none because of each other. What is
left may cut through a character, so it is binary.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.runindex import RunIndex
from ledgerloom.llm.words import forget, saved

WINDOW = 100
GRAMS = (32, 64, 88, 100)
MOST = 4_000  # different segments of one gram
PART = 500_000  # bytes of segments indexed together, about
AT_ONCE = 1 << 20  # bytes hashed at once; one longer text is cut into overlapping parts
_PLACE = np.uint64((1 << 24) - 1)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x += b
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each byte on."""
    hashes = _mixed(data.astype(np.uint64) + np.uint64(1), np.uint64(size))
    length = 1
    while length < size:
        step = min(length, size - length)
        hashes = _mixed(hashes[: len(hashes) - step], hashes[step:])
        length += step
    return hashes


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    number, length = len(values) - width + 1, 1
    while 2 * length <= width:
        values = np.minimum(values[:-length], values[length:])
        length *= 2
    if length < width:
        values = np.minimum(values[:number], values[width - length : width - length + number])
    return values


def segments(data: np.ndarray, ends: np.ndarray, gram: int, window: int):
    """Of the texts that end at ``ends``: ``first byte, windows, hash of the gram, of the bytes``
    of each segment, in order."""
    begins = np.r_[0, ends[:-1]]
    begins, ends = begins[ends - begins >= window], ends[ends - begins >= window]
    if not len(ends):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    hashes = gram_hashes(data, gram)
    ordered = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    least = least_of(ordered, window - gram + 1)
    cuts = np.flatnonzero(least[1:] != least[:-1]) + 1
    stops = ends - window + 1  # no window of the text begins here or after
    cuts = np.unique(np.concatenate([cuts, begins, stops]))
    text = np.searchsorted(begins, cuts, side="right") - 1
    inside = (text >= 0) & (cuts < stops[np.maximum(text, 0)])
    first, after = cuts[inside], np.r_[cuts[1:], len(data)][inside]
    last = after + window - 1  # the byte behind the segment
    content = (last - first).astype(np.uint64)
    # The hashes of grams that cover the segment, the last ones at its end.
    longest = 2 * window - gram
    for k in range(0, longest, gram):
        content = _mixed(content, hashes[np.minimum(first + k, last - gram)])
    key = hashes[(least[first] & _PLACE).astype(np.int64)]
    return first, after - first, key.view(np.int64), content.view(np.int64)


def _parts_of(column: pa.Array, window: int):
    """Texts of an Arrow column by parts: their rows, first bytes within the whole texts, bytes."""
    rows, starts, parts, size = [], [], [], 0
    for row in range(len(column)):
        data = np.frombuffer(column[row].as_buffer(), np.uint8)
        # Parts of a long text share all but one byte of a window: none is lost, none met twice.
        for start in range(0, len(data) - window + 1, AT_ONCE):
            part = data[start : start + AT_ONCE + window - 1]
            if size + len(part) > 2 * AT_ONCE:
                yield rows, starts, parts
                rows, starts, parts, size = [], [], [], 0
            rows.append(row)
            starts.append(start)
            parts.append(part)
            size += len(part)
    if rows:
        yield rows, starts, parts


# A segment's place is its first byte and 32 bits that tell rows of one key apart; its span is its
# first byte within the piece that it was read from, and the number of its windows.
def _found(pieces: DataFrame, kind: str, gram: int, window: int) -> DataFrame:
    """``gram, content, key, place, span`` of all segments of the pieces ``key, base, data``."""

    def work(batches):
        for batch in batches:
            bases = batch.column(1).to_numpy()
            for rows, starts, parts in _parts_of(batch.column(2), window):
                sizes = np.array([len(p) for p in parts])
                ends = np.cumsum(sizes)
                first, windows, key, content = segments(np.concatenate(parts), ends, gram, window)
                part = np.searchsorted(ends, first, side="right")
                offset = first - (ends - sizes)[part] + np.array(starts)[part]
                row = np.array(rows)[part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key),
                        pa.array(content),
                        batch.column(0).take(pa.array(row)),
                        pa.array(bases[row] + (offset << 32)),
                        pa.array((offset << 8) | windows),
                    ],
                    names=["gram", "content", "key", "place", "span"],
                )

    schema = f"gram long, content long, key {kind}, place long, span long"
    return pieces.select("key", "base", "data").mapInArrow(work, schema)


def _after(first: str) -> Column:
    """Whether ``key, place`` comes after ``first``: another key, or a later byte."""
    same = F.col("key").eqNullSafe(F.col(f"{first}.key"))
    earlier = F.shiftright(f"{first}.place", 32) < F.shiftright("place", 32)
    return ~same | earlier


def _cut_out(firsts: DataFrame, pieces: DataFrame, kind: str, window: int) -> DataFrame:
    """``gram, few, key, place, data`` of the segments ``gram, few, key, place, span``."""
    wanted = firsts.select(
        F.col("key").alias("_key"),
        (F.col("place") - F.shiftleft(F.shiftright("span", 8), 32)).alias("_base"),
        F.struct("gram", "few", "place", "span").alias("segment"),
    )
    wanted = wanted.groupBy("_key", "_base").agg(F.collect_list("segment").alias("segments"))  # of one text
    rows = pieces.join(wanted, F.col("key").eqNullSafe(F.col("_key")) & (F.col("base") == F.col("_base")))

    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                data = memoryview(batch.column(1)[row].as_buffer())
                lists = batch.column(2).slice(row, 1).flatten()
                spans = lists.field("span").to_numpy(zero_copy_only=False).tolist()
                found = [bytes(data[s >> 8 : (s >> 8) + (s & 255) + window - 1]) for s in spans]
                yield pa.RecordBatch.from_arrays(
                    [
                        lists.field("gram"),
                        lists.field("few"),
                        batch.column(0).take(pa.array(np.full(len(found), row))),
                        lists.field("place"),
                        pa.array(found, pa.binary()),
                    ],
                    names=["gram", "few", "key", "place", "data"],
                )

    schema = f"gram long, few boolean, key {kind}, place long, data binary"
    cut = rows.select("key", "data", "segments").mapInArrow(work, schema)
    return cut.dropDuplicates(["gram", "key", "place"])  # of repeated rows


def _marked(indexed: DataFrame, parts: int, kind: str, window: int) -> DataFrame:
    """``key, place, windows`` of repeats among the segments ``gram, key, place, data``."""

    def work(group: pa.Table) -> pa.Table:
        # Keys of any type become numbers in their order, so that places can be compared.
        keys = group["key"].combine_chunks().dictionary_encode()
        names = keys.dictionary.to_pylist()
        order = np.zeros(len(names) + 1, np.int64)  # the last one is that of null
        order[sorted(range(len(names)), key=names.__getitem__)] = np.arange(1, len(names) + 1)
        number = order[keys.indices.fill_null(-1).to_numpy(zero_copy_only=False)]
        place = group["place"].to_numpy()
        data = group["data"].to_pylist()
        start = (number << 32) + (place >> 32)
        sizes = np.array([len(d) for d in data], np.int64)
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        index = RunIndex(data, np.repeat(start, sizes) + within, window)
        which, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for rows, offsets, earliest in index.repeats(data):
            later = earliest < start[rows] + offsets
            which.append(rows[later])
            at.append(offsets[later])
        which, at = np.concatenate(which), np.concatenate(at)
        ordered = np.lexsort((at, which))
        which, at = which[ordered], at[ordered]
        new = np.ones(len(which), bool)
        new[1:] = (np.diff(which) != 0) | (np.diff(at) != 1)
        new = np.flatnonzero(new)
        return pa.table(
            {
                "key": group["key"].take(pa.array(which[new])),
                "place": place[which[new]] + (at[new] << 32),
                "windows": np.diff(np.r_[new, len(which)]),
            }
        )

    part = F.pmod(F.xxhash64("gram"), F.lit(parts)).alias("part")
    rows = indexed.select(part, "key", "place", "data").groupBy("part")
    return rows.applyInArrow(work, f"key {kind}, place long, windows long")


def _pieces(docs: DataFrame, key: str, text: str) -> DataFrame:
    data = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return docs.select(F.col(key).alias("key"), F.crc32(data).alias("base"), data.alias("data"))


def repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    grams: tuple[int, ...] = GRAMS,
    most: int = MOST,
    part: int = PART,
) -> DataFrame:
    """``key, place, windows``: so many windows that repeat, from the byte ``place >> 32`` of the
    text whose CRC-32 is the rest of ``place``. ``grams`` grow up to ``window``."""
    if grams[-1] != window or window - grams[0] > 254 or window < 8:
        raise ValueError("the last gram must be the window, which is of 8 bytes at least")
    kind = docs.schema[key].dataType.simpleString()
    pieces = _pieces(docs, key, text)
    marks = []
    for gram in grams:
        found = saved(_found(pieces, kind, gram, window), "repeat-segments")
        shared = found.groupBy("gram").agg(
            F.count(F.lit(1)).alias("times"),
            (F.min("content") == F.max("content")).alias("alike"),
            F.min(F.struct("key", "place")).alias("first"),
        )
        shared = saved(shared.where("times > 1").drop("times"), "repeat-grams")
        both = found.join(shared, "gram").where(~F.col("alike") | _after("first"))
        both = saved(both.drop("first"), "repeat-shared")
        forget(found, shared)
        windows = F.col("span").bitwiseAND(255).alias("windows")
        marks.append(both.where("alike").select("key", "place", windows))

        differing = both.where(~F.col("alike")).drop("alike")
        firsts = differing.groupBy("gram", "content").agg(
            F.min(F.struct("key", "place", "span")).alias("first"), F.count(F.lit(1)).alias("times")
        )
        firsts = saved(firsts, "repeat-firsts")
        several = firsts.where("times > 1").select("gram", "content", "first")
        later = differing.join(several, ["gram", "content"]).where(_after("first"))
        marks.append(saved(later.select("key", "place", windows), "repeat-later"))

        few = F.lit(True) if gram == window else F.count(F.lit(1)) <= most
        counted = firsts.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"), few.alias("few"))
        rows = firsts.select("gram", "first.*").join(counted.drop("_n"), "gram")
        cut = saved(_cut_out(rows, pieces, kind, window), "repeat-bytes")
        indexed = cut.where("few")
        size = indexed.agg(F.sum(F.length("data"))).first()[0] or 0
        marks.append(saved(_marked(indexed, 1 + size // part, kind, window), "repeat-marks"))
        forget(firsts)
        many = cut.where("NOT few")
        if many.isEmpty():
            forget(cut)
            break
        pieces = many.select("key", F.col("place").alias("base"), "data")
    return reduce(DataFrame.union, marks)


def cut(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, **how) -> DataFrame:
    """``key, n_bytes, spans, kept`` of each row: the removed runs (``start, length`` in bytes), and
    the bytes that are left, joined."""
    kind = docs.schema[key].dataType.simpleString()
    marks = repeats(docs, key, text, window, **how)
    lists = marks.groupBy(
        F.col("key").alias("_key"), F.col("place").bitwiseAND(2**32 - 1).alias("_base")
    ).agg(  # of one text
        F.collect_list(F.struct(F.shiftright("place", 32).alias("start"), "windows")).alias("marks")
    )
    rows = _pieces(docs, key, text).join(
        lists, F.col("key").eqNullSafe(F.col("_key")) & (F.col("base") == F.col("_base")), "left"
    )

    def work(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sizes, spans, kept = [], [], []
                for row in range(batch.num_rows):
                    data = batch.column(1)[row].as_py()
                    runs = []
                    if batch.column(2)[row].is_valid:
                        found = batch.column(2).slice(row, 1).flatten()
                        start, number = (
                            found.field(n).to_numpy(zero_copy_only=False) for n in ("start", "windows")
                        )
                        runs = joined_runs(start, start + number + window - 1)
                    sizes.append(len(data))
                    spans.append([{"start": a, "length": b - a} for a, b in runs])
                    edges = [0, *[x for run in runs for x in run], len(data)]
                    kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(sizes, pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
                        pa.array(kept, pa.binary()),
                    ],
                    names=["key", "n_bytes", "spans", "kept"],
                )

    schema = f"key {kind}, n_bytes long, spans array<struct<start:long,length:long>>, kept binary"
    return rows.select("key", "data", "marks").mapInArrow(work, schema).withColumnRenamed("key", key)


def joined_runs(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The runs that the intervals cover together; those that touch are one."""
    order = np.argsort(starts)
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.r_[True, starts[1:] > ends[:-1]])
    last = np.r_[new[1:] - 1, len(ends) - 1]
    return list(zip(starts[new].tolist(), ends[last].tolist()))


def digests(docs: DataFrame) -> DataFrame:
    """``cut`` of the given table, as counts and digests."""
    return cut(docs).select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["length"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
