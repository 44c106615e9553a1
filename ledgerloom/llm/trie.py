"""Pairs of near fingerprints, by a self-join of the binary trie of their bits.

Starting at the root, pairs of trie nodes are followed down together. A pair carries how
many bits its two paths differ in, and is dropped as soon as that exceeds the budget. The
upper levels are DataFrames of node pairs, a few bits a round; a pair whose nodes are small
enough becomes a unit, which one task walks down to single fingerprints.

A unit holds two nodes of at most ``leaf`` distinct fingerprints each. Distinct fingerprints
always part further down, so no group of copies can make a unit large.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.words import saved

STRIDE = 4
BITS = 64
WIDTH = 50_000  # so many node pairs are followed down together
DIRECT = 32  # node pairs of so many combinations are compared one by one


def node_pairs(
    values: np.ndarray, others: np.ndarray | None, depth: int, diff: int, radius: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of near values, some at a time. Both arrays are sorted and unsigned;
    ``others`` is None to join an array with itself, each pair once. ``depth`` bits are alike
    but for ``diff``. Where there are many node pairs, some wait while others are followed
    down, so that what is held at once is bounded."""
    same_array = others is None
    others = values if same_array else others
    waiting = [
        (
            depth,
            np.array([[0, len(values)]], np.int32),
            np.array([[0, len(others)]], np.int32),
            np.array([diff], np.int8),
            np.array([same_array]),
        )
    ]
    while waiting:
        depth, a, b, diffs, same = waiting.pop()
        if len(a) > WIDTH:
            for k in range(0, len(a), WIDTH):
                part = slice(k, k + WIDTH)
                waiting.append((depth, a[part], b[part], diffs[part], same[part]))
            continue
        size = (a[:, 1] - a[:, 0]).astype(np.int64) * (b[:, 1] - b[:, 0])
        small = (size <= DIRECT) | (depth == BITS)
        if small.any():
            i, j = _combinations(a[small], b[small], same[small])
            near = np.bitwise_count(values[i] ^ others[j]) <= radius
            yield i[near], j[near]
            a, b, diffs, same = a[~small], b[~small], diffs[~small], same[~small]
        if not len(a):
            continue
        bit = np.uint64(BITS - 1 - depth)
        mid_a = _middle(values, a, bit)
        mid_b = mid_a if same_array and same.all() else _middle(others, b, bit)
        zero_a, one_a = np.c_[a[:, 0], mid_a], np.c_[mid_a, a[:, 1]]
        zero_b, one_b = np.c_[b[:, 0], mid_b], np.c_[mid_b, b[:, 1]]
        no = np.zeros(len(a), bool)
        a = np.concatenate([zero_a, one_a, zero_a, one_a])
        b = np.concatenate([zero_b, one_b, one_b, zero_b])
        diffs = np.concatenate([diffs, diffs, diffs + 1, diffs + 1])
        mirrored = np.concatenate([no, no, no, same])  # of a node with itself, once
        same = np.concatenate([same, same, no, no])
        keep = (
            (a[:, 1] > a[:, 0])
            & (b[:, 1] > b[:, 0])
            & (diffs <= radius)
            & ~mirrored
            & ~(same & (a[:, 1] - a[:, 0] < 2))
        )
        if keep.any():
            waiting.append((depth + 1, a[keep], b[keep], diffs[keep], same[keep]))


def _middle(values: np.ndarray, spans: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Of each span of values that agree above the bit: where the bit becomes one."""
    ones = np.r_[0, np.cumsum((values >> bit) & np.uint64(1), dtype=np.int64)]
    return (spans[:, 1] - (ones[spans[:, 1]] - ones[spans[:, 0]])).astype(np.int32)


def _combinations(a: np.ndarray, b: np.ndarray, same: np.ndarray):
    wide = b[:, 1] - b[:, 0]
    size = (a[:, 1] - a[:, 0]) * wide
    pair = np.repeat(np.arange(len(a)), size)
    place = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
    i = a[pair, 0] + place // wide[pair]
    j = b[pair, 0] + place % wide[pair]
    keep = ~same[pair] | (i < j)
    return i[keep], j[keep]


def forest(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs join what was apart: at most as many as there are labels, less one,
    over all calls. ``label`` says what is joined already, and is brought up to date."""
    keep = np.zeros(len(i), bool)
    n = len(label)
    open_ = np.arange(len(i))
    while len(open_):
        x, y = label[i[open_]], label[j[open_]]
        apart = x != y
        open_, x, y = open_[apart], x[apart], y[apart]
        if not len(open_):
            break
        low, high = np.minimum(x, y), np.maximum(x, y)
        # Each group takes one pair that leads lower; such steps cannot form a circle.
        high_once, first = np.unique(high, return_index=True)
        keep[open_[first]] = True
        label_of = np.arange(n)
        label_of[high_once] = low[first]
        while True:
            further = label_of[label_of]
            if (further == label_of).all():
                break
            label_of = further
        label[:] = label_of[label]
    return keep


def near_pairs(prints: DataFrame, radius: int, leaf: int = 4096) -> DataFrame:
    """Pairs ``table, a, b`` of near fingerprints that hold together all that is near.

    ``prints`` has distinct ``table`` (int) and ``fingerprint`` (long). Pairs at most
    ``radius`` bits apart are all found; of those of one unit, the ones that close a circle
    are left out, so that the pairs grow no faster than the fingerprints.
    """
    spark = prints.sparkSession
    node = lambda depth: F.shiftrightunsigned("fingerprint", BITS - depth)
    frontier = None
    units = []
    for depth in range(STRIDE, BITS + 1, STRIDE):
        # At the last level the whole fingerprint is the node.
        nodes = prints.groupBy("table", node(depth).alias("node")).agg(F.count("*").alias("size"))
        nodes = saved(nodes, "trie-nodes").withColumn(
            "parent", F.shiftrightunsigned("node", STRIDE) if depth > STRIDE else F.lit(0)
        )
        side = lambda s, nodes=nodes: nodes.select(
            "table",
            F.col("parent").alias(f"parent_{s}"),
            F.col("node").alias(s),
            F.col("size").alias(f"size_{s}"),
        )
        if frontier is None:
            pairs = side("a").withColumn("diff", F.lit(0)).join(side("b"), "table")
        else:
            above = frontier.select(
                "table", F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), "diff"
            )
            pairs = above.join(side("a"), ["table", "parent_a"]).join(
                side("b"), ["table", "parent_b"]
            )
        # Unsigned order does not matter here: a pair must only be met once.
        met_once = (F.col("parent_a") != F.col("parent_b")) | (F.col("a") <= F.col("b"))
        step = F.bit_count(F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(F.lit(2**STRIDE - 1)))
        pairs = (
            pairs.where(met_once)
            .withColumn("diff", (F.col("diff") + step).cast("int"))
            .where(F.col("diff") <= radius)
            .where((F.col("a") != F.col("b")) | (F.col("size_a") > 1))
            .withColumn("ready", F.greatest("size_a", "size_b") <= leaf)
        )
        pairs = saved(pairs.select("table", "a", "b", "diff", "ready"), "trie-pairs")
        small = nodes.where(F.col("size") <= leaf).select("table", "node")
        members = (
            prints.withColumn("node", node(depth))
            .join(small, ["table", "node"])
            .groupBy("table", "node")
            .agg(F.collect_list("fingerprint").alias("prints"))
        )
        wanted = pairs.where("ready").drop("ready")
        of = lambda s, members=members: members.select(
            "table", F.col("node").alias(s), F.col("prints").alias(f"prints_{s}")
        )
        twice = wanted.where(F.col("a") != F.col("b")).join(of("a"), ["table", "a"]).join(
            of("b"), ["table", "b"]
        )
        once = wanted.where(F.col("a") == F.col("b")).join(of("a"), ["table", "a"])
        units.append(
            _walked(twice.select("table", "diff", "prints_a", "prints_b"), depth, radius).union(
                _walked(
                    once.select("table", "diff", "prints_a", F.lit(None).cast("array<long>")),
                    depth,
                    radius,
                )
            )
        )
        frontier = pairs.where(~F.col("ready"))
        if frontier.isEmpty():
            break
    if not units:
        return spark.createDataFrame([], "table int, a long, b long")
    return reduce(DataFrame.union, units)


def _walked(units: DataFrame, depth: int, radius: int) -> DataFrame:
    def work(batches):
        for batch in batches:
            tables, i_s, j_s = [], [], []
            table, diff, left, right = (batch.column(k) for k in range(4))
            for k in range(batch.num_rows):
                a = _sorted(left[k])
                b = _sorted(right[k]) if right[k].is_valid else None
                every = a if b is None else np.concatenate([a, b])
                label, shift = np.arange(len(every)), 0 if b is None else len(a)
                for i, j in node_pairs(a, b, depth, diff[k].as_py(), radius):
                    kept = forest(label, i, j + shift)
                    i_s.append(every[i[kept]].view(np.int64))
                    j_s.append(every[j[kept] + shift].view(np.int64))
                    tables.append(np.full(len(i_s[-1]), table[k].as_py(), np.int32))
            if tables:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (tables, i_s, j_s)],
                    names=["table", "a", "b"],
                )

    return units.mapInArrow(work, "table int, a long, b long")


def _sorted(values) -> np.ndarray:
    return np.sort(values.values.to_numpy().view(np.uint64))
