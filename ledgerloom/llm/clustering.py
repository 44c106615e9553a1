"""Centroid clustering of vectors of 64 components, with exact integer distances from bit planes.

Each component x becomes the integer floor(scale * x). Bit i of the 64 integers of a vector is
one plane, packed into an unsigned 64-bit number; the top plane holds the signs (two's
complement). An inner product is then a sum over pairs of planes: the number of bits that both
have, times the weights of the two planes. A squared distance is |x|^2 - 2 xc + |c|^2, all three
of them such sums, so distances and sums of vectors are exact, whatever the order of the rows.

Vectors are packed once and written; a round reads the planes, and what it sends on is, per task
and cluster, the sum of 64 components and a count. Centroids (``k`` of them) are all that the
driver and the tasks hold in common.

Defined results: vectors with another number of components, a null or non-finite component, or
null themselves, are left out. A repeated row is a vector of its own. A null key can be a member
but is no starting centroid before all other keys are. With fewer vectors than ``k``, there are
as many centroids as vectors; without any, the result is empty. Integers can be of any size: a
vector has as many planes as its batch needs, and where sums could pass 62 bits they are Python
integers. A distance or sum that no long can hold is null.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.words import forget, saved

SIZE = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
LIMB = 60
_LONGEST = 2**63 - 1


def usable(vector: str, size: int | None = None) -> Column:
    """Whether the vector has ``size`` components (any number, if None), all of them finite.

    Doubles that would not be finite once scaled, from 1e300 on, count as not finite."""
    column = F.col(vector)
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(1e300)))
    fits = column.isNotNull() if size is None else column.isNotNull() & (F.size(column) == size)
    return F.coalesce(fits & finite, F.lit(False))


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles; Python integers where 62 bits are too few."""
    scaled = np.floor(values * scale)
    if not scaled.size or np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    return np.array([[int(x) for x in row] for row in scaled], object)


def bits_needed(values: np.ndarray) -> int:
    """Of two's complement numbers that hold all the integers."""
    if not values.size:
        return 1
    return max(int(values.max()).bit_length(), (~int(values.min())).bit_length()) + 1


def pack(values: np.ndarray) -> np.ndarray:
    """Rows of 64 integers to rows of planes: lowest bits first, the signs last."""
    planes = []
    for bit in range(bits_needed(values)):
        ones = ((values >> bit) & 1).astype(np.uint8)
        planes.append(np.packbits(ones, axis=1, bitorder="little").view("<u8")[:, 0])
    return np.stack(planes, axis=1) if len(values) else np.zeros((0, 1), np.uint64)


def unpack(planes: np.ndarray) -> np.ndarray:
    """The rows of 64 integers that ``pack`` made planes of."""
    weight = weights(planes.shape[1])
    total = np.zeros((len(planes), SIZE), weight.dtype)
    for bit, w in enumerate(weight):
        column = np.ascontiguousarray(planes[:, bit : bit + 1])
        ones = np.unpackbits(column.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        total += ones.astype(weight.dtype) * w
    return total


def weights(planes: int, others: int | None = None) -> np.ndarray:
    """What a bit of each plane counts; Python integers if inner products could pass 62 bits."""
    exact = [2**k for k in range(planes)]
    exact[-1] = -exact[-1]
    needed = planes + (planes if others is None else others) + 8
    return np.array(exact, np.int64 if needed <= 62 else object)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of planes with one row of planes."""
    left, right = weights(a.shape[1], len(b)), weights(len(b), a.shape[1])
    total = np.zeros(len(a), left.dtype)
    for i, w in enumerate(left):
        column = np.ascontiguousarray(a[:, i])
        part = np.zeros(len(a), left.dtype)
        for plane, v in zip(b, right):
            part += np.bitwise_count(column & plane).astype(left.dtype) * v
        total += part * w
    return total


def squares(a: np.ndarray) -> np.ndarray:
    """Inner products of rows of planes with themselves."""
    weight = weights(a.shape[1], a.shape[1])
    columns = [np.ascontiguousarray(a[:, i]) for i in range(a.shape[1])]
    total = np.zeros(len(a), weight.dtype)
    for i, w in enumerate(weight):
        total += np.bitwise_count(columns[i]).astype(weight.dtype) * (w * w)
        for j in range(i):
            both = np.bitwise_count(columns[i] & columns[j]).astype(weight.dtype)
            total += both * (2 * w * weight[j])
    return total


def nearest(planes: np.ndarray, centroids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid, the smaller one of equals."""
    own = squares(planes)
    best = np.zeros(len(planes), np.int32)
    least = None
    for number, centroid in enumerate(centroids):
        away = own - 2 * inner(planes, centroid) + squares(centroid[None, :])[0]
        if least is None:
            least = away
        else:
            closer = away < least
            best[closer], least = number, np.where(closer, away, least)
    return best, least


def _planes(column: pa.Array) -> np.ndarray:
    """Lists of planes as one array; where they differ in length, signs are repeated."""
    offsets = column.offsets.to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    lengths = np.diff(offsets)
    if not len(lengths):
        return np.zeros((0, 1), np.uint64)
    places = np.minimum(np.arange(lengths.max())[None, :], lengths[:, None] - 1)
    return flat[(offsets[:-1] - offsets[0])[:, None] + places]


def planes_needed(values: np.ndarray) -> np.ndarray:
    """For each row, how many planes hold its integers."""
    if values.dtype == object:
        return np.array([bits_needed(row) for row in values], np.int64)
    largest = np.maximum(values, ~values).max(axis=1)
    return np.frexp(largest.astype(np.float64))[1].astype(np.int64) + 1


def packed(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``key, planes`` of the vectors that take part; a row has the planes that it needs."""
    kind = vectors.schema[key].dataType.simpleString()

    def work(batches):
        for batch in batches:
            doubles = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            values = integers(doubles.astype(np.float64).reshape(-1, SIZE), scale)
            planes = _extended(pack(values), int(planes_needed(values).max(initial=1)))
            needed = planes_needed(values)
            flat = planes[np.arange(planes.shape[1])[None, :] < needed[:, None]]
            offsets = np.r_[0, np.cumsum(needed)].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", "planes"])

    rows = vectors.where(usable(vector, SIZE)).select(
        F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector")
    )
    return rows.mapInArrow(work, f"key {kind}, planes array<long>")


def _extended(planes: np.ndarray, number: int) -> np.ndarray:
    """At least so many planes a row, by repeating the signs."""
    more = max(0, number - planes.shape[1])
    return np.concatenate([planes, np.repeat(planes[:, -1:], more, axis=1)], axis=1)


def starts(rows: DataFrame, k: int, seed: int) -> list[np.ndarray]:
    """The planes of the ``k`` vectors whose ``<seed>:<key>`` has the smallest digests."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    # Equal keys have equal digests: their vectors decide.
    first = rows.orderBy(order.asc_nulls_last(), "planes").limit(k).select("planes").collect()
    return [np.array(row.planes, np.int64).view(np.uint64) for row in first]


def _sums(rows: DataFrame, centroids: list[np.ndarray]) -> dict[int, tuple[int, list[int]]]:
    """Count and component sums of the vectors nearest to each centroid."""

    def work(batches):
        for batch in batches:
            planes = _planes(batch.column(0))
            best, _ = nearest(planes, centroids)
            values = unpack(planes)
            found = []
            for number in np.unique(best).tolist():
                mine = values[best == number]
                found.append((number, -1, 0, len(mine)))
                for place, total in enumerate(mine.sum(0).tolist()):
                    found += [(number, place, n, x) for n, x in enumerate(limbs(total))]
            columns = list(zip(*found)) or [[], [], [], []]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, kinds)],
                names=["cluster", "place", "limb", "value"],
            )

    parts = rows.select("planes").mapInArrow(work, "cluster int, place int, limb int, value long")
    found = parts.groupBy("cluster", "place", "limb").agg(
        F.sum(F.col("value").cast("decimal(38,0)")).alias("total")
    )
    result: dict[int, tuple[int, list[int]]] = {}
    for row in found.orderBy("cluster", "place", "limb").collect():  # 65 rows per cluster and limb
        if row.place < 0:
            result[row.cluster] = (int(row.total), [0] * SIZE)
        else:
            result[row.cluster][1][row.place] += int(row.total) << (LIMB * row.limb)
    return result


def limbs(number: int) -> list[int]:
    """Numbers of at most 61 bits whose sum, each shifted by 60 bits times its place, it is."""
    found = []
    while not -(1 << LIMB) <= number < 1 << LIMB:
        found.append(number & ((1 << LIMB) - 1))
        number >>= LIMB
    return [*found, number]


def moved(centroids: list[np.ndarray], sums: dict[int, tuple[int, list[int]]]) -> list[np.ndarray]:
    """Each centroid with members goes to the floor of their mean."""
    result = list(centroids)
    for number, (members, totals) in sums.items():
        mean = [total // members for total in totals]
        small = all(abs(x) < 2**62 for x in mean)
        result[number] = pack(np.array([mean], np.int64 if small else object))[0]
    return result


def clustered(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    seed: int = SEED,
) -> DataFrame:
    """``key, cluster, distance, cluster_inertia, inertia, centroid`` of each vector that takes part.

    ``distance`` is squared and in units of 1 / scale; the two sums are those of a cluster and of
    all. ``centroid`` is the list of the components of the last centroid, as decimal text.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    rows = saved(packed(vectors, key, vector, scale), "cluster-planes")
    centroids = starts(rows, k, seed)
    if not centroids:
        return spark.createDataFrame(
            [],
            f"`{key}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, "
            "centroid array<string>",
        )
    for _ in range(rounds):
        centroids = moved(centroids, _sums(rows, centroids))

    def work(batches):
        for batch in batches:
            best, away = nearest(_planes(batch.column(1)), centroids)
            if away.dtype == object:
                away = [x if x <= _LONGEST else None for x in away]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best), pa.array(away, pa.int64())],
                names=["key", "cluster", "distance"],
            )

    found = saved(rows.mapInArrow(work, f"key {kind}, cluster int, distance long"), "clusters")
    forget(rows)
    # A sum with a distance that no long can hold is not known either.
    known = F.count("distance") == F.count(F.lit(1))
    total = F.when(known, F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = found.groupBy("cluster").agg(total.alias("part"))
    whole = sums.agg(
        F.when(F.count("part") == F.count(F.lit(1)), F.sum("part")).alias("whole")
    ).first()[0]  # one row, from one row per cluster
    parts = {row.cluster: row.part for row in sums.collect()}
    as_long = lambda x: None if x is None or x > _LONGEST else int(x)
    table = [
        (number, as_long(parts.get(number)), as_long(whole), [str(x) for x in unpack(c[None, :])[0]])
        for number, c in enumerate(centroids)
    ]
    facts = spark.createDataFrame(
        table, "cluster int, cluster_inertia long, inertia long, centroid array<string>"
    )
    # One row per centroid: the bound of a broadcast.
    return found.withColumnRenamed("key", key).join(F.broadcast(facts), "cluster").select(
        key, "cluster", "distance", "cluster_inertia", "inertia", "centroid"
    )


def digests(vectors: DataFrame) -> DataFrame:
    """``clustered`` of the given table, with the digest of each centroid."""
    return clustered(vectors).select(
        "vec_id",
        "cluster",
        "distance",
        "cluster_inertia",
        "inertia",
        F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"),
    )


def digest_of(components: list[int]) -> str:
    """The digest of a centroid as ``digests`` gives it."""
    return hashlib.sha256(",".join(str(x) for x in components).encode()).hexdigest()
