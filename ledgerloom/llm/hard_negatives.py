"""Hard negatives of anchors: rows of other labels that score high, but not too close to a positive.

Components x become integers floor(scale * x); a score is the inner product with the anchor. Higher
scores come first, equal ones by the smaller key.

All rows are dealt by a hash into blocks, and every anchor meets every block. Anchors travel in
small chunks of similar ones; over each chunk stands a minimum spanning tree whose root hangs from
the origin. Going down the tree, the scores of a block's rows at an anchor lie within those at its
parent, plus or minus the length of the edge times the norm of the row (Cauchy-Schwarz). Only rows
whose bounds reach into what is searched for are scored anew; for all others the wider bounds are
handed on. In a first pass that is the best ``positives`` of the same label, in a second one the
windows below each positive's score. A block gives at most ``positives`` rows, or ``negatives``
rows a positive, for each anchor; the best of all blocks are then ranked.

Blocks hold at most about ``BLOCK`` rows, chunks ``CHUNK`` anchors: that bounds the memory of a
task. Rows are shuffled once a pass, anchors once a pass and block.

Defined results: rows with a null key, label, vector or component, or a non-finite component, take
no part. A component that a shorter vector lacks counts as zero. Rows that share a key count once,
as the one with the least label and vector. Anchors without a positive, and positives with an
empty window (those of negative score among them), give no rows. Scores that no long can hold count
as the largest (or least) long.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.clustering import usable
from ledgerloom.llm.words import forget, saved

POSITIVES = 5
NEGATIVES = 10
WINDOW = (30, 90)  # of a positive's score, in hundredths
SCALE = 256
BLOCK = 65_536
LEAST_BLOCK = 2_048  # so many rows are worth a task of their own
CHUNK = 64
_LONGEST = 2**63 - 1


class Vectors:
    """Integer vectors, kept as doubles as long as their products are exact in them."""

    def __init__(self, rows: list | pa.ListArray, scale: int):
        offsets = rows.offsets.to_numpy()
        lengths = np.diff(offsets)
        flat = np.floor(rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
        self.values = np.zeros((len(lengths), int(lengths.max(initial=0))))
        self.values[np.arange(self.values.shape[1])[None, :] < lengths[:, None]] = flat
        self.norms = np.sqrt((self.values**2).sum(1)) * (1 + 1e-12)

    def scores(self, places: np.ndarray, other: np.ndarray, norm: float) -> np.ndarray:
        """Inner products of some rows with another vector, as longs."""
        size = min(self.values.shape[1], len(other))
        rows, other = self.values[places, :size], other[:size]
        if norm * self.norms.max(initial=0) < 2.0**52:
            return (rows @ other).astype(np.int64)
        other = [int(x) for x in other]
        exact = [sum(int(x) * y for x, y in zip(row, other)) for row in rows]
        return np.array([max(-_LONGEST, min(_LONGEST, x)) for x in exact], np.int64)


def spanning_tree(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the rows, each one's parent (a place in that order) and its edge's length.

    Minimum spanning tree by Prim's method. The first row hangs from the origin, parent -1."""
    n = len(values)
    order, parent, length = np.zeros(n, int), np.full(n, -1), np.zeros(n)
    length[0] = np.sqrt((values[0] ** 2).sum())
    away = np.full(n, np.inf)
    nearest = np.zeros(n, int)
    free = np.ones(n, bool)
    free[0] = False
    for k in range(1, n):
        distance = np.sqrt(((values - values[order[k - 1]]) ** 2).sum(1))
        closer = distance < away
        away[closer], nearest[closer] = distance[closer], k - 1
        order[k] = np.where(free, away, np.inf).argmin()
        if not free[order[k]]:  # distances too large for doubles: any free row will do
            order[k] = np.flatnonzero(free)[0]
        free[order[k]] = False
        parent[k], length[k] = nearest[order[k]], away[order[k]]
    return order, parent, length


def trees(anchors: DataFrame, scale: int) -> DataFrame:
    """``chunk, place, parent, edge, key, label, vector`` of the anchors.

    Chunks are cut from an order by label and signs of components, so that edges are short."""
    signs = [
        F.when(F.coalesce(F.get("vector", F.lit(k)), F.lit(0.0)) >= 0, 1 << (15 - k)).otherwise(0)
        for k in range(16)
    ]
    code = signs[0]
    for sign in signs[1:]:
        code = code + sign
    schema = "chunk long, place int, parent int, edge double, key long, label long, vector array<double>"

    def work(batches):
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                order, parent, length = spanning_tree(Vectors(part.column(2), scale).values)
                part = pa.Table.from_batches([part]).take(pa.array(order)).combine_chunks()
                places = np.arange(len(order), dtype=np.int32)
                columns = [
                    pa.array(np.full(len(order), chunk)),
                    pa.array(places),
                    pa.array(parent.astype(np.int32)),
                    pa.array(length),
                    *[part.column(k).combine_chunks() for k in range(3)],
                ]
                names = ["chunk", "place", "parent", "edge", "key", "label", "vector"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                chunk += 1

    rows = anchors.select("key", "label", "vector", code.alias("code"))
    ordered = rows.repartitionByRange("label", "code", "key").sortWithinPartitions("label", "code", "key")
    return ordered.select("key", "label", "vector").mapInArrow(work, schema)


class Block:
    """The rows of a block that a chunk of anchors meets."""

    def __init__(self, keys: np.ndarray, labels: np.ndarray, vectors: Vectors):
        self.keys, self.labels, self.vectors = keys, labels, vectors
        by_label = np.argsort(labels, kind="stable")
        names, first = np.unique(labels[by_label], return_index=True)
        self.of_label = dict(zip(names.tolist(), np.split(by_label, first[1:])))

    def best(self, places: np.ndarray, scores: np.ndarray, number: int) -> np.ndarray:
        """Which of the scored rows come first; at most ``number`` of them."""
        if len(scores) > number:
            least = np.partition(scores, -number)[-number]
            chosen = np.flatnonzero(scores >= least)
        else:
            chosen = np.arange(len(scores))
        return chosen[np.lexsort((self.keys[places[chosen]], -scores[chosen]))[:number]]


# Which rows to score, from bounds; then what to give, from the rows and their scores.
Wanted = Callable[[Block, dict, np.ndarray, np.ndarray], np.ndarray]
Given = Callable[[Block, dict, np.ndarray, np.ndarray], list[tuple]]


def walk(block: Block, chunk: list[dict], wanted: Wanted, given: Given) -> Iterator[tuple]:
    """What the rows of a block give to the anchors of a chunk, down their tree."""
    low = np.zeros((len(chunk) + 1, len(block.keys)))  # the last row is the origin's
    high = np.zeros_like(low)
    for anchor in chunk:
        a, parent = anchor["place"], anchor["parent"]
        slack = anchor["edge"] * (1 + 1e-9) * block.vectors.norms + 1
        low[a], high[a] = low[parent] - slack, high[parent] + slack
        places = wanted(block, anchor, low[a], high[a])
        scores = block.vectors.scores(places, anchor["values"], anchor["norm"])
        rounding = np.abs(scores) * 1e-12
        low[a, places], high[a, places] = scores - rounding, scores + rounding
        yield from given(block, anchor, places, scores)


def nearest_of_label(number: int) -> tuple[Wanted, Given]:
    """The best rows of the anchor's own label."""

    def wanted(block, anchor, low, high):
        places = block.of_label.get(anchor["label"], np.zeros(0, int))
        places = places[block.keys[places] != anchor["key"]]
        if len(places) > number:
            least = np.partition(low[places], -number)[-number]  # so many score this or more
            places = places[high[places] >= least]
        return places

    def given(block, anchor, places, scores):
        chosen = block.best(places, scores, number)
        return [(anchor["key"], int(block.keys[places[c]]), int(scores[c])) for c in chosen]

    return wanted, given


def below_positives(number: int, window: tuple[int, int]) -> tuple[Wanted, Given]:
    """The best rows of other labels in the window of each of the anchor's positives."""

    def windows(anchor):
        for positive, score in anchor["positives"]:
            yield positive, score, -((-window[0] * score) // 100), (window[1] * score) // 100

    def wanted(block, anchor, low, high):
        spans = {(least, most) for _, _, least, most in windows(anchor) if least <= most}
        if not spans:
            return np.zeros(0, int)
        reach = (high >= min(s[0] for s in spans)) & (low <= max(s[1] for s in spans))
        places = np.flatnonzero(reach & (block.labels != anchor["label"]))
        low, high = low[places], high[places]
        chosen = np.zeros(len(places), bool)
        for least, most in spans:
            inside = low[(low >= least) & (high <= most)]
            if len(inside) >= number:  # so many lie within, at this or more
                least = np.partition(inside, -number)[-number]
            chosen |= (high >= least) & (low <= most)
        return places[chosen]

    def given(block, anchor, places, scores):
        found = []
        for positive, score, least, most in windows(anchor):
            inside = np.flatnonzero((scores >= least) & (scores <= most))
            for c in inside[block.best(places[inside], scores[inside], number)]:
                row = (anchor["key"], positive, score, int(block.keys[places[c]]), int(scores[c]))
                found.append(row)
        return found

    return wanted, given


def _met(
    rows: DataFrame, anchors: DataFrame, blocks: int, scale: int, search: tuple[Wanted, Given], schema: pa.Schema
) -> DataFrame:
    """What all anchors are given by all blocks. In each block its rows come first, then the
    anchors, chunk by chunk and down their trees."""

    def chunks(batches) -> Iterator[tuple[int, int, pa.Table]]:
        """Block, chunk (-1 for the rows) and what belongs to them, in order."""
        held, name = [], None
        for batch in batches:
            ids = np.stack([batch.column(k).to_numpy() for k in (0, 1)], axis=1)
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            for start, end in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows]):
                if start == end:
                    continue
                if name is not None and name != tuple(ids[start]):
                    yield *name, pa.Table.from_batches(held).combine_chunks()
                    held = []
                name = tuple(ids[start].tolist())
                held.append(batch.slice(start, end - start))
        if held:
            yield *name, pa.Table.from_batches(held).combine_chunks()

    def work(batches):
        block, number = None, None
        for block_id, chunk_id, part in chunks(batches):
            column = {n: part.column(n).combine_chunks() for n in part.column_names}
            vectors = Vectors(column["vector"], scale)
            keys, labels = column["key"].to_numpy(), column["label"].to_numpy()
            if chunk_id < 0:
                block, number = Block(keys, labels, vectors), block_id
                continue
            if number != block_id:
                continue  # a block without rows
            chunk = [
                {
                    "place": k,
                    "parent": column["parent"][k].as_py(),
                    "edge": column["edge"][k].as_py(),
                    "key": int(keys[k]),
                    "label": int(labels[k]),
                    "values": vectors.values[k],
                    "norm": vectors.norms[k],
                    "positives": [(p["key"], p["score"]) for p in column["positives"][k].as_py() or []],
                }
                for k in range(len(keys))
            ]
            found = list(walk(block, chunk, *search))
            if found:
                arrays = [pa.array(c, f.type) for c, f in zip(zip(*found), schema)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    listed = "array<struct<key:long,score:long>>"
    members = rows.select(
        F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"),
        F.lit(-1).cast("long").alias("chunk"),
        F.lit(0).alias("place"),
        F.lit(-1).alias("parent"),
        F.lit(0.0).alias("edge"),
        "key",
        "label",
        "vector",
        F.lit(None).cast(listed).alias("positives"),
    )
    asking = anchors.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        "chunk", "place", "parent", "edge", "key", "label", "vector",
        F.col("positives").cast(listed).alias("positives"),
    )
    dealt = members.union(asking).repartition(blocks, "block").sortWithinPartitions("block", "chunk", "place")
    columns = ", ".join(f"{f.name} long" for f in schema)
    return dealt.mapInArrow(work, columns)


def _ranked(rows: DataFrame, by: list[str], score: str, key: str, number: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), key)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= number)


def mined(
    vectors: DataFrame,
    anchors: Column,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    window: tuple[int, int] = WINDOW,
    scale: int = SCALE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` says, of the columns of ``vectors``, which rows are anchors. Each one's
    positives are the first ``positives`` other rows of its label; each of these has the first
    ``negatives`` rows of other labels that score within ``window`` hundredths of it.
    """
    context = vectors.sparkSession.sparkContext
    taking = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & usable(vector))
    row = F.struct(
        F.col(label).cast("long").alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
    )
    once = taking.groupBy(F.col(key).cast("long").alias("key")).agg(F.min(row).alias("row"))
    rows = saved(once.select("key", "row.label", "row.vector", "row.anchor"), "negative-rows")
    number = rows.count()
    worth = min(4 * context.defaultParallelism, math.ceil(number / LEAST_BLOCK))
    blocks = max(1, worth, math.ceil(number / BLOCK))
    tree = saved(trees(rows.where("anchor"), scale), "negative-trees")

    longs = lambda *names: pa.schema([(n, pa.int64()) for n in names])
    asked = tree.withColumn("positives", F.lit(None))
    found = _met(
        rows, asked, blocks, scale, nearest_of_label(positives), longs("anchor_id", "positive_id", "score")
    )
    best = saved(_ranked(found, ["anchor_id"], "score", "positive_id", positives), "negative-positives")
    lists = best.groupBy(F.col("anchor_id").alias("key")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "positive_id", "score"))).alias("all")
    )  # at most ``positives`` of them
    lists = lists.select(
        "key",
        F.transform("all", lambda p: F.struct(p["positive_id"].alias("key"), p["score"].alias("score"))).alias(
            "positives"
        ),
    )
    asked = saved(tree.join(lists, "key", "left"), "negative-asked")
    names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
    found = _met(rows, asked, blocks, scale, below_positives(negatives, window), longs(*names))
    result = _ranked(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    result = saved(
        result.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"),
        "negatives",
    )
    forget(rows, tree, best, asked)
    return result
