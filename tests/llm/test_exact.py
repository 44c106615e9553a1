"""Operators written out again in plain Python, and the pipeline stage by stage."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import bpe, mixing, neardup, pii, sharding, simhash
from test_operators import brute_groups

SMALL = "/root/testdata/sf0.001"


def hashed(*parts):
    """Spark's xxhash64 of ints (as (value, bytes)) in a row."""
    seed = 42
    for value, size in parts:
        if value is not None:
            seed = xxhash.xxh64_intdigest(value.to_bytes(size, "little", signed=True), seed)
    return seed - 2**64 if seed >= 2**63 else seed


def shard_of(key, shards):
    return max(range(shards), key=lambda s: (hashed((sharding.SEED, 4), (key, 8), (s, 4)), s))


def test_shards_agree_with_rendezvous_hashing_and_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = []
    for partitions in (4, 7):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        rows = docs.repartition(partitions + 1)
        found.append({r.doc_id: r for r in sharding.sharded(rows, bucket_bytes=20_000).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    first, second = found
    for row in docs.collect():
        r, data = first[row.doc_id], (row.text or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        assert (r.shard, r.grown_shard) == (shard_of(row.doc_id, 8), shard_of(row.doc_id, 9))
        assert (r.shard, r.slot) == (second[row.doc_id].shard, second[row.doc_id].slot)
    # The order is not that of the keys, nor that of the hashes that dealt the records out.
    slots = sorted(first.values(), key=lambda r: (r.shard, r.bucket, r.place))
    ordered = [r.doc_id for r in slots if r.shard == 0]
    assert ordered != sorted(ordered) and ordered != sorted(ordered, reverse=True)


def test_shards_are_written_without_gathering_the_texts_of_a_bucket(spark, monkeypatch):
    """Buckets are sorted and joined, which can spill; no row holds the records of a bucket."""
    plans, write = [], DataFrameWriter.parquet

    def noted(writer, *args, **more):
        plans.append(writer._df._jdf.queryExecution().optimizedPlan().toString())
        return write(writer, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    rows = [(k % 400, f"text {k % 400} " * 9) for k in range(500)]  # some rows twice
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.sharded(docs, bucket_bytes=1_000).collect()
    assert len(plans) == 1 and "collect_list" not in plans[0]
    assert sorted((r.doc_id, r.text) for r in got) == sorted(rows)
    for shard in range(8):
        own = sorted((r.slot, r.doc_id) for r in got if r.shard == shard)
        assert [slot for slot, _ in own] == list(range(len(own)))
        assert [key for _, key in own] != sorted(key for _, key in own)


def counted(key, rate, draws):
    """The documented draws, written out for one document."""
    total = 0
    for draw in range(1, draws + 1):
        digest = hashlib.md5(f"{mixing.SEED}:{key}:{draw}".encode()).hexdigest()[:13]
        number, mean = int(digest, 16) / 2**52, rate / draws
        term = below = math.exp(-mean)
        k = 0
        while below <= number and k < mixing.TERMS:
            k += 1
            term *= mean / k
            below += term
            total += 1
        total += below <= number
    return total


def rates_of(rows):
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += len(r.text or "")
    weights = {s: n**mixing.ALPHA for s, n in sizes.items()}
    whole, all_weights = sum(sizes.values()), sum(weights.values())
    return {s: whole * weights[s] / all_weights / n if n else 0.0 for s, n in sizes.items()}


def expected_copies(rows):
    rates = rates_of(rows)
    found = collections.Counter()
    for r in rows:
        rate = rates[r.source]
        key = r.doc_id if r.doc_id is not None else "null:" + hashlib.md5((r.text or "").encode()).hexdigest()
        number = counted(key, rate, max(1, math.ceil(rate / mixing.MEAN_OF_DRAW)))
        if number:
            found[r.doc_id, r.text] += number
    return found


def test_documents_without_a_key_draw_by_their_text(spark):
    rows = [(None, f"text number {k} " * (1 + k % 3), "a" if k % 2 else "b") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = collections.Counter((r.doc_id, r.text) for r in mixing.mixed(docs).collect())
    assert got == expected_copies(docs.collect())
    assert 1 < len({got[None, r[1]] for r in rows})


def test_digests_agree_with_the_tokenizers_library(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.default_vocabulary())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    drawn = random.Random(2)
    long = "".join(drawn.choices("etaoinshrdlucmfwyp", k=20_000))
    texts = [None, "", long, "a" * 3_000, "é" * 999, "x" * 257 + " " + long[:300], "<|endoftext|>" + long[:600]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.digests(docs).collect():
        ids = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_near_copies_of_which_few_are_alike_find_their_groups(spark):
    """A text that all others are copies of, which are mostly no copies of each other; and texts
    that only share a long passage."""
    drawn = random.Random(12)
    words = lambda n: ["".join(drawn.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    whole, passage = words(200), words(120)
    texts = {0: " ".join(whole)}
    for k in range(1, 60):
        copy = list(whole)
        begin = drawn.randrange(170)
        copy[begin : begin + 16] = words(16)  # about 0.8 of the shingles of the first are left
        texts[k] = " ".join(copy)
    for k in range(100, 160):
        texts[k] = " ".join(passage + words(40))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {}
    for r in neardup.groups(docs).collect():
        found.setdefault(bytes(r.root), set()).add(r.smallest)
    expected = brute_groups(texts)
    assert max(map(len, expected)) > 30
    # A pair just at the bound may share no band, with a probability below 0.003.
    missed = [g for g in expected if g not in {frozenset(f) for f in found.values()}]
    assert sum(map(len, missed)) <= 3 + max(map(len, expected)) * (len(missed) > 0)
    together = sum(len(set(f) & max(expected, key=len)) ** 2 for f in found.values())
    assert together >= 0.9 * max(map(len, expected)) ** 2


def test_the_copies_stage_links_by_simhash_and_by_similarity(spark):
    """1 and 2 have near SimHashes only, 2 and 3 are similar only: a chain of both is one group."""
    drawn = random.Random(21)
    words = lambda n: ["".join(drawn.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    line, one, other = words(31), words(20), words(20)
    texts = {
        1: " ".join(line * 50 + one),
        2: " ".join(line * 50 + other),
        3: " ".join(line + other),
        4: " ".join(words(200)),
        5: " \n",
        6: None,
    }
    assert {frozenset({1}), frozenset({2, 3}), frozenset({4})} == brute_groups({k: texts[k] for k in (1, 2, 3, 4)})
    prints = {k: simhash.fingerprint(t) & (2**64 - 1) for k, t in texts.items()}
    near = {(a, b) for a in texts for b in texts if a < b and (prints[a] ^ prints[b]).bit_count() <= 2}
    assert near == {(1, 2), (5, 6)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.without_copies(spark, docs, "").collect()} == {1, 4, 5}


def test_few_texts_of_one_kind_are_compared_by_their_shingles(spark, monkeypatch):
    """Copies of a text that is not there, most of them no copies of each other."""
    drawn = random.Random(17)
    words = lambda n: ["".join(drawn.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    whole, texts = words(200), {}
    for k in range(60):
        begin = drawn.randrange(184)
        texts[k] = " ".join(whole[:begin] + words(16) + whole[begin + 16 :])
    compared, exactly = [], neardup.exactly_alike
    monkeypatch.setattr(neardup, "exactly_alike", lambda x, s: compared.append(x.count()) or exactly(x, s))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {}
    for r in neardup.groups(docs).collect():
        found.setdefault(bytes(r.root), set()).add(r.smallest)
    expected = brute_groups(texts)
    assert len(expected) > 20
    assert len(expected ^ {frozenset(f) for f in found.values()}) <= 3  # a pair at the bound
    assert sum(compared) < 400  # 229 of 1770 pairs; without parities 1898, some twice


def test_parities_never_say_more_than_the_sets(spark):
    drawn, rows = random.Random(8), []
    for size, other in ((1, 1), (60, 70), (64, 65), (500, 520), (1000, 1100), (1024, 1030)):
        common = drawn.randrange(size + 1)
        pool = [drawn.getrandbits(64) for _ in range(size + other - common)]
        a, b = pool[:size], pool[size - common :]
        p, q = (neardup.parities(np.array(sorted(x), np.uint64)).tolist() for x in (a, b))
        rows.append((p, q, len(set(a) ^ set(b))))
    rows.append((rows[3][0], rows[3][0], 0))
    frame = spark.createDataFrame(rows, "p array<long>, q array<long>, parted int")
    for r in frame.withColumn("found", neardup._parted("p", "q")).collect():
        assert min(1, r.parted) <= r.found <= r.parted


def test_recall_of_pairs_just_above_the_bound():
    """Similarities between 0.80 and 0.82: bands and the least agreement together."""
    drawn = random.Random(3)
    found = tried = 0
    for _ in range(400):
        both, own = drawn.randrange(400, 500), drawn.randrange(48, 56)
        common = [f"w{drawn.random()}" for _ in range(both)]
        a = common + [f"a{drawn.random()}" for _ in range(own)]
        b = common + [f"b{drawn.random()}" for _ in range(own)]
        x, y = set(neardup.shingles(" ".join(a)).tolist()), set(neardup.shingles(" ".join(b)).tolist())
        if not 0.80 <= len(x & y) / len(x | y) <= 0.82:
            continue
        tried += 1
        (_, p, s), (_, q, t) = neardup.sketch(" ".join(a)), neardup.sketch(" ".join(b))
        agree = (s.view("u1") == t.view("u1")).sum()
        found += bool((p == q).any()) and agree >= neardup.LEAST_AGREEING
    assert tried > 50 and found >= 0.97 * tried


def test_the_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage of ``run`` against what its input says."""
    from tokenizers import Tokenizer

    rows = spark.read.parquet(f"{SMALL}/documents.parquet").limit(120).collect()
    extra = [
        (9001, "12345 !!! ???", None, "web", 13),
        (9002, rows[0].text, rows[0].lang, "web", 0),
        (9003, (rows[1].text or "") + " one more word", rows[1].lang, "books", 0),
        (9004, "write to anna.meier@mail.example or 4111 1111 1111 1111 on 2020-03-04, the river is wide", "en", "web", 0),
        (9005, None, "en", "web", 0),
    ]
    docs = spark.createDataFrame([tuple(r) for r in rows] + extra, spark.createDataFrame(rows).schema)
    folder = str(tmp_path / "in")
    docs.write.parquet(f"{folder}/documents.parquet")

    language, copies, pseudonyms, mixture, tokens = (stage for _, stage in corpus_pipeline.STAGES)
    kept = language(spark, docs, folder).collect()
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept} == {9001, 9005}
    docs = spark.createDataFrame(kept, docs.schema)

    kept = copies(spark, docs, folder).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in kept} == {min(g) for g in brute_groups(texts)}
    assert 9002 not in {r.doc_id for r in kept}
    docs = spark.createDataFrame(kept, docs.schema)

    kept = pseudonyms(spark, docs, folder).collect()
    new = {r.doc_id: r for r in pii.pseudonymised(docs).collect()}
    for r in kept:
        assert r.text == new[r.doc_id].text and r.n_chars == len(r.text)
        assert new[r.doc_id].pii or r.text == texts[r.doc_id]
    told = next(r.text for r in kept if r.doc_id == 9004)
    assert not [v for v in ("anna.meier", "4111 1111", "2020-03-04") if v in told]
    docs = spark.createDataFrame(kept, docs.schema)

    expected = expected_copies(docs.collect())
    kept = mixture(spark, docs, folder).collect()
    assert collections.Counter((r.doc_id, r.text) for r in kept) == expected

    tokenizer = Tokenizer.from_file(bpe.default_vocabulary())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    wanted = collections.Counter()
    for (key, text), number in expected.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        wanted[key, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()] += number
    got = corpus_pipeline.run(spark, folder).collect()
    assert collections.Counter((r.doc_id, r.ids_sha256) for r in got) == wanted
    docs = spark.createDataFrame(kept, docs.schema)
    assert sorted(map(tuple, tokens(spark, docs, folder).collect())) == sorted(map(tuple, got))


@pytest.mark.parametrize("size", [3, 5])
def test_bits_of_spark_hashes_are_known(spark, size):
    row = spark.range(1).select(F.xxhash64(F.lit(size), F.lit(7).cast("long"))).first()
    assert row[0] == hashed((size, 4), (7, 8))
