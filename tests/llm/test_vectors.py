"""Centroid clustering and hard negatives against brute force, and on odd vectors."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import clustering, hard_negatives

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, label int, key string, cluster string, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(*row, "x", "x", "x") for row in rows], SCHEMA)


def vector(drawn, size=64, scale=1.0):
    return [drawn.gauss(0, scale) for _ in range(size)]


@pytest.fixture(scope="module")
def odd_rows():
    drawn = random.Random(5)
    rows = [(k, vector(drawn, scale=10.0 ** drawn.randrange(-3, 3)), k % 4) for k in range(120)]
    rows += [(7, rows[7][1], 3)]  # a repeated row
    rows += [(200 + k, rows[k][1], 1) for k in range(10)]  # ties
    rows += [(300, None, 1), (301, [], 1), (302, vector(drawn, 63), 1), (303, [NAN] * 64, 1)]
    rows += [(304, [None] + vector(drawn, 63), 1), (305, [INF] * 64, 2), (None, vector(drawn), 2)]
    rows += [(306, vector(drawn), None), (307, [-0.0] * 64, 2), (308, vector(drawn, scale=1e30), 2)]
    return rows


def taking_part(rows, size=None):
    return [
        r
        for r in rows
        if r[1] is not None
        and (size is None or len(r[1]) == size)
        and not any(x is None or not math.isfinite(x) for x in r[1])
    ]


def lloyd(rows, k, rounds):
    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v, *_ in taking_part(rows, 64)]
    first = sorted(
        ints, key=lambda r: ("~" if r[0] is None else hashlib.sha256(f"3:{r[0]}".encode()).hexdigest())
    )
    centroids = [v for _, v in first[:k]]

    def assigned():
        found = []
        for i, v in ints:
            away = [sum((x - y) ** 2 for x, y in zip(v, c)) for c in centroids]
            found.append((i, v, away.index(min(away)), min(away)))
        return found

    for _ in range(rounds):
        found = assigned()
        for number in range(len(centroids)):
            members = [v for _, v, c, _ in found if c == number]
            if members:
                centroids[number] = [sum(x) // len(members) for x in zip(*members)]
    return [
        (i, c, d if d < 2**63 else None, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
        for i, _, c, d in assigned()
    ]


def test_clusters_agree_with_brute_force(spark, odd_rows):
    got = clustering.digests(frame(spark, odd_rows)).collect()
    ours = [(r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in got]
    key = lambda r: (r[0] is None, r[0] or 0)
    expected = sorted(lloyd(odd_rows, 8, 10), key=key)
    assert sorted(ours, key=key) == expected
    for r in got:
        mine = [e[2] for e in expected if e[1] == r.cluster]
        whole = sum(mine) if None not in mine else None
        assert r.cluster_inertia == (whole if whole is None or whole < 2**63 else None)


@pytest.mark.parametrize("number", [0, 1, 5])
def test_few_vectors_are_their_own_clusters(spark, odd_rows, number):
    got = clustering.digests(frame(spark, odd_rows[:number])).collect()
    assert len(got) == number and all(r.distance == r.inertia == 0 for r in got)


def test_planes_give_exact_products():
    drawn = random.Random(2)
    for bits in (3, 10, 27, 40, 120):
        ints = [[drawn.randrange(-(2**bits), 2**bits) for _ in range(64)] for _ in range(5)]
        values = np.array(ints, np.int64 if bits < 62 else object)
        planes = clustering.pack(values)
        assert (clustering.unpack(planes) == values).all()
        exact = [sum(x * y for x, y in zip(row, ints[0])) for row in ints]
        assert clustering.inner(planes, planes[0]).tolist() == exact
        assert clustering.squares(planes).tolist() == [sum(x * x for x in row) for row in ints]


def brute_negatives(rows, every, window=(30, 90), number=10):
    once = {}
    for i, v, label, *_ in taking_part(rows):
        if i is not None and label is not None:
            once[i] = min(once.get(i, (label, v)), (label, v))
    ints = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in once.items()}
    clip = lambda x: max(-(2**63 - 1), min(2**63 - 1, x))
    found = set()
    for a, (label, v) in ints.items():
        if a % every:
            continue
        score = {i: clip(sum(x * y for x, y in zip(v, w))) for i, (_, w) in ints.items()}
        ordered = sorted(ints, key=lambda i: (-score[i], i))
        for p in [i for i in ordered if ints[i][0] == label and i != a][:5]:
            low, high = window[0] * score[p], window[1] * score[p]
            fit = [i for i in ordered if ints[i][0] != label and low <= 100 * score[i] <= high]
            found |= {(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fit[:number])}
    return found


@pytest.mark.parametrize("every", [1, 10])
def test_negatives_agree_with_brute_force(spark, odd_rows, every):
    rows = frame(spark, odd_rows)
    got = hard_negatives.mined(rows, F.col("vec_id") % every == 0).collect()
    assert {tuple(r) for r in got} == brute_negatives(odd_rows, every)
    assert len(got) == len({tuple(r) for r in got})


def test_negatives_of_many_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAST_BLOCK", 40)
    drawn = random.Random(8)
    centres = [vector(drawn, 16) for _ in range(6)]
    rows = []
    for k in range(400):  # one label holds a third; close vectors, so that bounds decide
        centre = centres[k % 6]
        rows.append((k, [x + drawn.gauss(0, 0.1) for x in centre], k % 3 if k % 9 else 7))
    got = hard_negatives.mined(frame(spark, rows), F.col("vec_id") % 2 == 0).collect()
    assert {tuple(r) for r in got} == brute_negatives(rows, 2)


def test_bounds_spare_most_scores():
    drawn = np.random.default_rng(1)
    values = np.concatenate([drawn.normal(c, 1, (500, 64)) for c in (40, -40, 0)])
    labels = np.repeat(np.arange(3), 500)
    rows = hard_negatives.pa.array(values.tolist())
    vectors = hard_negatives.Vectors(rows, 1)
    block = hard_negatives.Block(np.arange(1500), labels, vectors)
    order, parent, length = hard_negatives.spanning_tree(vectors.values[:20])
    chunk = [
        {
            "place": k, "parent": int(parent[k]), "edge": length[k], "key": int(order[k]), "label": 0,
            "values": vectors.values[order[k]], "norm": vectors.norms[order[k]], "positives": [(0, 100_000)],
        }
        for k in range(20)
    ]
    scored = []
    wanted, given = hard_negatives.below_positives(10, (30, 90))

    def counting(block, anchor, low, high):
        places = wanted(block, anchor, low, high)
        scored.append(len(places))
        return places

    list(hard_negatives.walk(block, chunk, counting, given))
    # The root's bounds leave out the rows near the origin, its scores those on the other side.
    assert scored[0] == 500 and sum(scored[1:]) == 0


@pytest.mark.parametrize("number", [0, 1])
def test_negatives_of_hardly_any_rows(spark, odd_rows, number):
    assert hard_negatives.mined(frame(spark, odd_rows[:number]), F.lit(True)).collect() == []
