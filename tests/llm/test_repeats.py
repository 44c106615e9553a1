"""Removal of repeated passages and its run-length index, against brute force."""

import hashlib
import random

import numpy as np
import pytest

from ledgerloom.llm import repeats
from ledgerloom.llm.queries import queries
from ledgerloom.llm.runindex import RunIndex

SMALL = "/root/testdata/sf0.001"


def brute(rows, window):
    """Kept bytes and removed runs of each row ``key, text``, in their order."""
    first = {}
    texts = [(key, (text or "").encode()) for key, text in rows]
    place = lambda key, start: (key is not None, key or 0, start)
    for key, data in texts:
        for start in range(len(data) - window + 1):
            found = data[start : start + window]
            first[found] = min(first.get(found, (True, 10**9, 0)), place(key, start))
    result = []
    for key, data in texts:
        removed = np.zeros(len(data), bool)
        for start in range(len(data) - window + 1):
            if first[data[start : start + window]] < place(key, start):
                removed[start : start + window] = True
        runs = int((np.diff(np.r_[0, removed.astype(int)]) == 1).sum())
        result.append((key, len(data), runs, np.frombuffer(data, np.uint8)[~removed].tobytes()))
    return sorted(result, key=repr)


def cut(spark, rows, window, **how):
    frame = spark.createDataFrame([(*r, "x", "x") for r in rows], "doc_id long, text string, key string, gram string")
    got = repeats.cut(frame, window=window, **how).collect()
    for r in got:
        assert sum(s.length for s in r.spans) == r.n_bytes - len(r.kept)
    return sorted(((r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in got), key=repr)


def documents(drawn, number):
    """Copies, near copies, passages that many share, repetitions within a text, odd rows."""
    letters = "abcdefgh é\n"
    passage = "".join(drawn.choices(letters, k=90))
    rows = []
    for k in range(number):
        kind = k % 6
        text = "".join(drawn.choices(letters, k=drawn.randrange(150)))
        if kind == 0 and rows:
            text = drawn.choice(rows)[1] or ""
        elif kind == 1 and rows:
            text = drawn.choice(rows)[1] or ""
            at = drawn.randrange(len(text) + 1)
            text = text[:at] + "Z" + text[at + 2 :]
        elif kind in (2, 3):
            begin = drawn.randrange(60)
            text += passage[begin : begin + drawn.randrange(20, 90)] + "".join(drawn.choices(letters, k=40))
        elif kind == 4:
            text = text * 3
        rows.append((1000 - k if k % 5 else k, text))
    rows += [(2000, None), (2001, ""), (None, passage), (5, passage), (5, passage), (5, passage + "!"), (2002, "ab" * 200)]
    return rows


@pytest.mark.parametrize("grams, most", [((8, 14, 20), 3), ((8, 20), 10_000), ((20,), 1), ((9, 12, 15, 20), 1)])
def test_repeats_agree_with_brute_force(spark, grams, most):
    rows = documents(random.Random(len(grams)), 150)
    assert cut(spark, rows, 20, grams=grams, most=most, part=2_000) == brute(rows, 20)


def test_texts_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "AT_ONCE", 37)
    rows = documents(random.Random(9), 60)
    # Workers import the module anew, so the parts are tried here as well.
    assert cut(spark, rows, 20, grams=(8, 20)) == brute(rows, 20)
    column = repeats.pa.array([(t or "").encode() for _, t in rows], repeats.pa.binary())
    found = [
        (row, start + k, part[k : k + 20].tobytes())
        for rows_, starts, parts in repeats._parts_of(column, 20)
        for row, start, part in zip(rows_, starts, parts)
        for k in range(len(part) - 19)
    ]
    expected = [
        (row, k, data[k : k + 20])
        for row, data in enumerate(column.to_pylist())
        for k in range(len(data) - 19)
    ]
    assert sorted(found) == sorted(expected)


def test_segments_hold_each_window_once_and_equal_ones_alike():
    drawn = random.Random(4)
    passage = bytes(drawn.choices(range(256), k=400))
    texts = [passage, b"x" * 30, passage[100:300], b"", b"y" * 150 + passage[50:250]]
    ends = np.cumsum([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    for gram in repeats.GRAMS:
        first, windows, key, _ = repeats.segments(data, ends, gram, 100)
        starts = np.concatenate([np.arange(a, a + n) for a, n in zip(first, windows)])
        within = [e - len(t) + k for e, t in zip(ends, texts) for k in range(len(t) - 99)]
        assert starts.tolist() == within
        of = {}
        for start, gram_of_it in zip(starts, np.repeat(key, windows)):
            assert of.setdefault(data[start : start + 100].tobytes(), gram_of_it) == gram_of_it
        assert windows.max() <= 101 - gram


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics_agree_with_search(seed):
    drawn = random.Random(seed)
    window = drawn.choice([8, 10, 14, 20, 30])
    base = bytes(drawn.choices(b"ab\x00\xff", k=80))
    strings = [b""]
    for _ in range(12):
        a = drawn.randrange(70)
        text = bytearray(base[a : a + drawn.randrange(60)])
        if text and drawn.random() < 0.5:
            text[drawn.randrange(len(text))] = drawn.choice(b"ab\x00\xff")
        strings.append(bytes(text))
    index = RunIndex(strings, np.arange(sum(map(len, strings))), window)
    text = b"\0".join(strings) + b"\0"
    for which, at, length, low, high, place in index.stream(strings):
        for s, a, n, x, y, p in zip(which, at, length, low, high, place):
            match = strings[s][a : a + n]
            assert n == min(window, len(strings[s]) - a) and text[p : p + n] == match
            assert y - x == sum(t.startswith(match, k) for t in strings for k in range(len(t)))
    windows = {
        (s, a): (x, y, text[p : p + window])
        for which, at, length, low, high, place in index.stream(strings)
        for s, a, n, x, y, p in zip(which, at, length, low, high, place)
        if n == window
    }
    streamed = {
        (s, a): (x, y, text[p : p + window])
        for which, at, length, low, high, place in index.stream(strings, windows_only=True)
        for s, a, n, x, y, p in zip(which, at, length, low, high, place)
    }
    assert windows == streamed


def test_the_index_of_copies_hardly_grows():
    drawn = random.Random(1)
    text = bytes(drawn.choices(b"abcd", k=500))
    sizes = [len(RunIndex([text] * n, np.zeros(500 * n, np.int64), 100).run_starts) for n in (1, 2, 50)]
    assert sizes[2] <= sizes[1] + 2


def test_query_agrees_with_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries()["op11_repeats"](spark, SMALL).collect()]
    expected = [
        (key, size, size - len(kept), runs, hashlib.sha256(kept).hexdigest())
        for key, size, runs, kept in brute(rows, 100)
    ]
    assert sorted(got) == sorted(expected)
