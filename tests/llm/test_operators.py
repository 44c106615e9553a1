"""The operators against brute force, exact round trips and held-out rows."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import (
    bpe,
    kneser_ney,
    language,
    licenses,
    minhash,
    mixing,
    neardup,
    pii,
    sharding,
    simhash,
    trie,
)
from ledgerloom.llm.components import components
from ledgerloom.llm.queries import queries


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


def test_simhash_agrees_with_brute_force(spark, texts):
    rows = {r.doc_id: r for r in queries()["op1_simhash"](spark, SMALL).collect()}
    prints = {i: simhash.fingerprint(t) & (2**64 - 1) for i, t in texts}
    group = {i: i for i in prints}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in sorted(prints):
        for b in sorted(prints):
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                low, high = sorted((find(a), find(b)))
                group[high] = low
    for i in prints:
        assert rows[i].fingerprint == f"{prints[i]:016x}"
        assert rows[i].component_id == find(i)


@pytest.mark.parametrize("leaf", [4, 10_000])
def test_trie_join_finds_all_near_pairs(spark, leaf):
    drawn = random.Random(3)
    base = [drawn.getrandbits(64) for _ in range(30)]
    values = set(base)
    for value in base * 6:
        values.add(value ^ (1 << drawn.randrange(64)) ^ (1 << drawn.randrange(64)))
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    frame = spark.createDataFrame([(0, v) for v in signed], "table int, fingerprint long")
    roots = {
        r.node: r.root
        for r in components(trie.near_pairs(frame, 2, leaf).select("a", "b")).collect()
    }
    ordered = sorted(signed)
    for k, a in enumerate(ordered):
        for b in ordered[k + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                assert roots[a] == roots[b]
    # Nothing else is joined: links are real.
    for r in trie.near_pairs(frame, 2, leaf).collect():
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(60)]
    star = [(1000, 1000 + k) for k in range(1, 60)]
    frame = spark.createDataFrame(chain + star + [(5, 5)], "a long, b long")
    groups = collections.defaultdict(set)
    for r in components(frame).collect():
        groups[r.root].add(r.node)
    assert sorted(map(len, groups.values())) == [60, 61]


def test_near_copies_are_found_and_others_left(spark):
    drawn = random.Random(5)
    vocabulary = ["".join(drawn.choices("abcdefghijklmn", k=drawn.randint(2, 8))) for _ in range(3000)]
    originals = [[drawn.choice(vocabulary) for _ in range(200)] for _ in range(40)]
    rows = [(k, " ".join(words)) for k, words in enumerate(originals)]
    for k, words in enumerate(originals[:30]):
        copy = list(words)
        for place in drawn.sample(range(200), 2):
            copy[place] = drawn.choice(vocabulary)
        rows.append((100 + k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in neardup.deduplicated(docs).collect()}
    assert set(range(40)) <= kept
    assert len(kept) <= 41  # at most one in thirty is missed


def test_poisson_replication_meets_its_rates(spark):
    rows = [(k, "xx", "a" if k % 10 else "b") for k in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"a": 0.25, "b": 0.75}
    mixed = mixing.mixed(docs, weights)
    counts = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert counts["a"] == pytest.approx(5_000, rel=0.05)
    assert counts["b"] == pytest.approx(15_000, rel=0.05)
    # The variance of a Poisson distribution is its mean; here 7.5, in two draws.
    per_doc = mixed.where("source = 'b' AND copy = 1").agg(F.var_samp("n_copies")).first()[0]
    assert per_doc == pytest.approx(7.5, rel=0.15)
    copies = mixed.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_copies").alias("m"))
    assert copies.where("n != m").count() == 0


def luhn(number: str) -> bool:
    digits = [int(c) for c in reversed(number)]
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0


def brute_feistel(symbols, kind, key):
    """The documented network, written out for one value."""
    half = len(symbols) // 2
    a, b = symbols[:half], symbols[half:]
    for number in range(1, pii.ROUNDS + 1):
        other = ",".join(str(v) for v, _ in b)
        moved = []
        for place, (v, r) in enumerate(a):
            text = f"{key}|{kind}|{number}|{place}|{other}"
            moved.append(((v + int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)) % r, r))
        a, b = b, moved
    return a + b


def test_pseudonyms_agree_with_brute_force(spark):
    rows = [
        (1, "card 4111111111111111, ip 10.20.30.40, on 2020-02-29"),
        (2, "card 4111-1111-1111-1111; wrong 4111111111111112 and 2021-02-30"),
        (3, "Mail A.b9@x.example or a.B9@x.example, call +1 (017) 555-1234"),
        (4, "ssn 123-45-6789, iban DE89370400440532013000, wrong DE88370400440532013000"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    new = {r.doc_id: r for r in pii.pseudonymised(docs, key="k").collect()}
    body = brute_feistel([(int(c), 10) for c in "411111111111111"], "card", "k")
    number = "".join(str(v) for v, _ in body)
    number += next(c for c in "0123456789" if luhn(number + c))
    octets = ".".join(str(v) for v, _ in brute_feistel([(10, 256), (20, 256), (30, 256), (40, 256)], "ip", "k"))
    assert new[1].text.startswith(f"card {number}, ip {octets}, on ")
    dashed = "-".join(number[k : k + 4] for k in range(0, 16, 4))
    assert new[2].text == f"card {dashed}; wrong 4111111111111112 and 2021-02-30"
    assert new[2].pii == ["card"]
    first, second = re.findall(r"\S+@x.example", new[3].text)
    assert first.lower() == second.lower() and first != second and "555-1234" not in new[3].text
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}$", new[3].text)
    iban = re.search(r"iban (DE\d{20})", new[4].text)[1]
    spelled = "".join(str(int(c, 36)) for c in iban[4:] + iban[:4])
    assert int(spelled) % 97 == 1 and "DE88370400440532013000" in new[4].text


def test_pseudonyms_are_a_permutation(spark):
    days = spark.sql("SELECT id AS doc_id, cast(date_add(date'1990-01-01', cast(id AS int)) AS string) AS text FROM range(3000)")
    new = pii.pseudonymised(days)
    assert new.select("text").distinct().count() == 3000
    assert new.where(F.to_date("text").isNull()).count() == 0


def test_minhash_is_near_the_exact_similarity(spark, texts):
    rows = {r.doc_id: r for r in queries()["op6_minhash"](spark, SMALL).collect()}
    ordered = sorted(texts, reverse=True)
    shingled = lambda t: {tuple(w[k : k + 5]) for w in [re.findall(r"[^\x20\x09-\x0D]+", t)] for k in range(max(1, len(w) - 4))}
    errors = []
    for k, (i, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        assert rows[i].n_chars == len(text)
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingled(text), shingled(edited)
        errors.append(abs(rows[i].near_edited - len(a & b) / len(a | b)))
    assert np.mean(errors) < 0.04
    same = collections.defaultdict(set)
    for i, text in texts:
        same[text].add(rows[i].fingerprint)
    assert all(len(prints) == 1 for prints in same.values())
    assert len(minhash._STARTS) == minhash.BINS


def test_shards_are_gapless_and_grow_into_the_new_one(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = sharding.sharded(docs, bucket_bytes=20_000).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r.shard, r.bucket) for r in rows}) > 8
    again = sharding.sharded(docs, bucket_bytes=20_000).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_bpe_is_what_the_library_does(spark):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    drawn = random.Random(1)
    pieces = ["a", "b", "aaaa", " ", "  ", "\n", "'s", "'ll", "é", "1", "12", "!", "<|endoftext|>", "　", "\x1c", "ß", "𝒳", "the", " of"]
    samples = ["".join(drawn.choices(pieces, k=drawn.randint(0, 40))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(samples)), "doc_id long, text string")
    for r in bpe.encoded(docs).collect():
        expected = reference.encode(samples[r.doc_id], add_special_tokens=False).ids
        assert r.ids == expected
        assert r.decoded == reference.decode(expected, skip_special_tokens=False) == samples[r.doc_id]


def test_known_words_may_be_forgotten(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    with open(bpe.default_vocabulary(), encoding="utf-8") as file:
        vocabulary = bpe.Vocabulary(file.read())
    small, texts = bpe.Encoder(vocabulary), ["one two three", "three four five", "one <|endoftext|> six"]
    forgetful = [small.encode_batch([t])[0].tolist() for t in texts]
    assert forgetful == [i.tolist() for i in bpe.Encoder(vocabulary).encode_batch(texts)]


def brute_licenses(scanner, text):
    """Every window of every template's length, without retrieval."""
    words, found = licenses.words_of(text), []
    for family in scanner.families:
        for number, wanted in enumerate(family.words):
            slack = max(1, len(wanted) // 4)
            for begin in range(0, max(1, len(words) - len(wanted) + 1)):
                share = family.share(number, words[max(0, begin - slack) : begin + len(wanted) + slack])
                if share >= licenses.LEAST:
                    found.append((family.templates[number].license, begin, begin + len(wanted), share))
    return {m[0] for m in scanner._clear(found + scanner._looked_up(text))}


def test_license_scan_agrees_with_brute_force(texts):
    scanner = licenses.Scanner()
    drawn = random.Random(4)
    noise = lambda: " ".join(drawn.choices(["some", "plain", "words", "of", "prose", "the", "under"], k=30))
    told = [(0, f"{noise()}. {t.text.upper()}. {noise()}") for t in licenses.TEMPLATES]
    for _, text in [*[t for t in texts if len(t[1] or "") < 1000], *told]:
        assert {m[0] for m in scanner.scan(text)} == brute_licenses(scanner, text)
    assert licenses.bands_for(0.5) == math.ceil(math.log(0.001) / math.log(0.75))


def test_licenses_are_found_with_a_word_changed():
    scanner = licenses.Scanner()
    drawn = random.Random(6)
    for template in licenses.TEMPLATES:
        words, name = template.text.split(), template.name.split()
        counted = len(licenses.words_of(template.text))
        assert template.license in {m[0] for m in scanner.scan(f"see this. {template.text} and so on")}, template
        telling = {"Affero", "Lesser", "library", "program", "3", "2"}  # one license from another
        free = [k for k, w in enumerate(words) if w not in telling | set(name) and len(licenses.words_of(w)) == 1]
        said = [w for w in words if w in licenses.TELLING]
        free = [k for k in free if len(said) > 1 or words[k] not in said]
        if counted < 5 or not free:
            continue
        for k in drawn.sample(free, min(4, len(free))):
            changed = " ".join([*words[:k], "changed", *words[k + 1 :]])
            assert template.license in {m[0] for m in scanner.scan(f"see this. {changed} and so on")}, changed


@pytest.mark.parametrize(
    "text, expected",
    [
        ("# SPDX-License-Identifier: MIT\ncode", ["MIT"]),
        ("SPDX-License-Identifier: (Apache-2.0 OR MIT) and so on", ["Apache-2.0", "MIT"]),
        ("MIT License\n\nCopyright (c) 2020", ["MIT"]),
        ("Licensed under the Apache License 2.0", ["Apache-2.0"]),
        ("released under an MIT License", ["MIT"]),
        ("Licensed under CC BY-NC 4.0. All rights reserved", ["All-Rights-Reserved", "CC-BY-NC-4.0"]),
        ("licensed under the BSD 3-Clause license", ["BSD-3-Clause"]),
        ("This work is licensed under the GNU General Public License, version 3", ["GPL-3.0"]),
        ("He studied at MIT and got a driving license under the new rules", []),
        ("released under the new fishing license", []),
        ("the rights of all are reserved", []),
        ("", []),
    ],
)
def test_declared_licenses(text, expected):
    assert sorted({m[0] for m in licenses.Scanner().scan(text)}) == expected


def test_language_of_held_out_rows(spark):
    rows = queries()["op10_language"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    joined = rows.where("held_out").join(truth, "doc_id")
    right, total = joined.agg(F.count_if(F.col("lang_pred") == F.col("lang")), F.count("*")).first()
    assert right / total > 0.97


def test_viterbi_agrees_with_all_paths():
    drawn = np.random.default_rng(1)
    scores = drawn.normal(size=(11, 2)) * 5
    begins = np.array([0, 4, 4, 5, 11])
    labels = language.viterbi(scores, begins, 3.0)
    for begin, end in zip(begins, begins[1:]):
        if begin == end:
            continue
        paths = np.array(np.meshgrid(*[[0, 1]] * (end - begin))).reshape(end - begin, -1).T
        value = lambda p: sum(scores[begin + k, x] for k, x in enumerate(p)) - 3.0 * sum(p[1:] != p[:-1])
        assert value(labels[begin:end]) == pytest.approx(max(map(value, paths)))


def test_mixed_text_has_spans(spark):
    english, german = "the quick fox is with the other one of them that was there ", "der schnelle fuchs ist mit dem anderen und das ist nicht von hier "
    train = [(k, english * 3, "en") for k in range(5)] + [(9 + k, german * 3, "de") for k in range(5)]
    docs = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = language.learn(docs)
    mixed = spark.createDataFrame([(1, english + german * 3 + english)], "doc_id long, text string")
    row = language.identified(mixed, model, with_spans=True).first()
    assert [s.lang for s in row.spans] == ["en", "de", "en"] and row.lang_pred == "de"


def brute_kneser_ney(trusted: list[str], texts: list[str]) -> list[float]:
    n = kneser_ney.ORDER
    levels = {n: collections.Counter()}
    for t in map(kneser_ney.prepared, trusted):
        levels[n].update(t[k : k + n] for k in range(len(t) - n + 1))
    for k in range(n, 1, -1):
        levels[k - 1] = collections.Counter(g[1:] for g in levels[k])

    def discount(k, c):
        t = {x: sum(v == x for v in levels[k].values()) for x in (1, 2, 3, 4)}
        x = min(c, 3)
        if not (t[1] and t[x]):
            return 0.5 * x
        return max(0.0, x - (x + 1) * t[1] / (t[1] + 2 * t[2]) * t[x + 1] / t[x])

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / (len(levels[1]) + 1)
        same = [c for x, c in levels[k].items() if x[:-1] == g[:-1]]
        if not same:
            return p(g[1:])
        c = levels[k][g]
        kept_back = sum(discount(k, x) for x in same)
        return (max(0.0, c - (discount(k, c) if c else 0)) + kept_back * p(g[1:])) / sum(same)

    result = []
    for t in map(kneser_ney.prepared, texts):
        bits = [-math.log2(p(t[k : k + n])) for k in range(len(t) - n + 1)]
        result.append(2 ** (sum(bits) / len(bits)))
    return result


def test_perplexity_agrees_with_brute_force(spark):
    trusted = ["the cat sat on the mat", "a cat and a hat", "that is the hat"]
    others = ["the hat sat", "zzzz qq!", "cat"]
    rows = [(k, t, "en") for k, t in enumerate(trusted + others)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    keys = docs.where(F.col("doc_id") < len(trusted)).select("doc_id")
    found = {r.doc_id: r.perplexity for r in kneser_ney.scored(docs, keys).collect()}
    expected = brute_kneser_ney(trusted, trusted + others)
    assert [found[k] for k in range(len(rows))] == pytest.approx(expected)


def five_words(text: str) -> set:
    words = text.split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def brute_groups(texts: dict) -> set:
    """Groups of keys that chains of similarities of 0.8 or more hold together."""
    sets = {k: five_words(t) for k, t in texts.items()}
    group = {k: k for k in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b]) if a < b else 0
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                old, new = group[a], group[b]
                group = {k: new if g == old else g for k, g in group.items()}
    return {frozenset(k for k in sets if group[k] == g) for g in group.values()}


def found_groups(spark, texts: dict) -> set:
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {}
    for r in neardup.groups(docs).collect():
        found.setdefault(bytes(r.root), set()).add(r.smallest)
    return {frozenset(g) for g in found.values()}


def test_near_copies_of_edited_blocks_agree_with_brute_force(spark):
    drawn = random.Random(7)
    words = lambda n: ["".join(drawn.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    rows = {}
    for k in range(60):
        whole = words(150)
        edited = {
            0: whole + words(drawn.randint(26, 42)),  # appended
            1: whole[: drawn.randint(112, 128)],  # cut
            2: whole[:133] + words(17 + k % 3),  # another end
            3: words(15) + whole[15:],  # another head
        }[k % 4]
        rows[k], rows[100 + k] = " ".join(whole), " ".join(edited)
    expected = brute_groups(rows)
    assert 20 < len(expected) < 120  # similarities on both sides of the bound
    missed = expected - found_groups(spark, rows)
    assert len(missed) <= 2  # one group, or the two halves of it


def test_near_copies_among_texts_with_a_long_common_passage_agree_with_brute_force(spark):
    drawn = random.Random(11)
    words = lambda n: ["".join(drawn.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    passage, rows = words(110), {}
    for k in range(150):
        own = words(30)
        rows[k] = " ".join(passage + own)
        if k % 3 == 0:
            rows[1000 + k] = " ".join(passage + own[:-3] + words(3))
    assert found_groups(spark, rows) == brute_groups(rows)


def test_threshold_is_the_quantile_of_held_out_trusted_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("lang = 'en'")
    trusted = docs.where("doc_id % 2 = 0").select("doc_id")
    parts = trusted.withColumn("out", kneser_ney.held_out("doc_id"))
    counted = parts.where(~F.col("out")).select("doc_id")
    found = {r.doc_id: r.perplexity for r in kneser_ney.scored(docs, counted).collect()}
    held = sorted(found[r.doc_id] for r in parts.where("out").collect() if found[r.doc_id])
    rows = kneser_ney.judged(docs, trusted, quantile=0.5).collect()
    assert {r.threshold for r in rows} == {held[math.ceil(len(held) / 2) - 1]}
    assert all(r.kept == (r.perplexity <= r.threshold) for r in rows if r.perplexity)


FORMS = {
    "iban": [
        "BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "DE89370400440532013000", "NO93 8601 1117 947",
        "de89 3704 0044 0532 0130 00", "DE89-3704-0044-0532-0130-00", "gb29nwbk60161331926819",
    ],
    "ymd": ["2020-03-04T12:00:00Z", "2020-3-4", "2020/03/04", "2020.3.4"],
    "dmy": ["3/4/2020", "3.4.2020", "13/4/2020", "03/04/2020"],
    "mdy": ["3/14/2020", "12/31/2020"],
    "phone": [
        "+14155550123", "+4915112345678", "+1 2025550143", "+49 30 1234567", "+33 6 12 34 56 78",
        "+33 12 34 56 78 90", "415.555.0123", "1-415-555-0123", "415-555-0123", "+1 (415) 555-0123",
        "415 555 0123", "1 415 555 0123",
    ],
    "card": ["3782 822463 10005", "3782-822463-10005", "4111 1111 1111 1111", "4111111111111111"],
    "ip": ["10.20.30.40"],
    "ipv6": ["2001:db8:85a3:0:0:8a2e:370:7334", "2001:DB8::8A2E:370:7334", "2001:db8:1:2::1"],
    "email": ["j.smith+x@mail.example", "müller@x.example", "мария@пример.example"],
    "ssn": ["123-45-6789"],
}


def test_valid_values_beside_and_inside_others_are_found(spark):
    one = {kind: forms[-1] for kind, forms in FORMS.items()}
    rows = [(f"{a} {b}", [a, b], [one[a], one[b]]) for a in one for b in one if a != b]
    rows = [(f"{one[a]} {one[b]}", kinds, values) for (_, kinds, values) in rows for a, b in [kinds]]
    rows += [
        ("PO12 4111 1111 1111 1111", ["card"], ["4111 1111 1111 1111"]),
        ("ID42 4111111111111111", ["card"], ["4111111111111111"]),
        ("no 0123 4111 1111 1111 1111 left", ["card"], ["4111 1111 1111 1111"]),
        ("4111 1111 1111 1111 4111 1111 1111 1111", ["card", "card"], ["4111 1111 1111 1111"]),
    ]
    frame = spark.createDataFrame(rows, "text string, kinds array<string>, forms array<string>")
    for r in pii.pseudonymised(frame.withColumn("before", F.col("text"))).collect():
        assert r.pii == r.kinds, (r.before, r.text, r.pii)
        assert not [f for f in r.forms if f in r.text], (r.before, r.text)


def test_what_is_not_personal_data_stays(spark):
    texts = [
        "4111 1111 1111 1112 and DE88370400440532013000", "version 10.2.3, 1.2.3.4.5", "at 12:30:45 or std::vector",
        "2021-02-30 13/13/2020", "0.5 100 200 3000 400", "call 555 1234 or 123 456 7890", "a@b and @home", "",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [(r.text, r.pii) for r in pii.pseudonymised(rows).collect()] == [(t, []) for t in texts]


def test_pseudonyms_keep_their_format(spark):
    rows = [(f"<{f}>",) for forms in FORMS.values() for f in forms]
    got = pii.pseudonymised(spark.createDataFrame(rows, "text string").withColumn("old", F.col("text"))).collect()
    shape = lambda t: re.sub("[^\\W\\d_]", "a", re.sub("[0-9]", "0", t))
    for r in got:
        if r.pii in (["ip"], ["ipv6"]):
            assert re.sub("[0-9A-Fa-f]+", "x", r.old) == re.sub("[0-9A-Fa-f]+", "x", r.text)
        elif r.pii == ["email"]:
            assert r.old.split("@")[1] == r.text.split("@")[1] and len(r.old) == len(r.text)
        elif r.pii[0] not in ("ymd", "dmy", "mdy"):
            assert shape(r.old) == shape(r.text)


def test_personal_data_is_found_in_every_written_form(spark):
    rows = [(kind, form) for kind, forms in FORMS.items() for form in forms]
    docs = [(k, f, f"at {f} EUR AND more") for k, f in rows] + [(k, f, f"At {f}. Then") for k, f in rows]
    frame = spark.createDataFrame(docs, "kind string, form string, text string")
    for r in pii.pseudonymised(frame).collect():
        value = r.form.split("T")[0] if r.kind == "ymd" else r.form
        assert r.pii == [r.kind] and value not in r.text, (r.form, r.text)
        assert r.text.endswith(" EUR AND more") or r.text.endswith(". Then")
    codes = {r.form: r.text for r in pii.pseudonymised(frame).where("text LIKE 'at %'").collect()}
    assert codes["+14155550123"].startswith("at +1") and codes["+4915112345678"].startswith("at +49")
    assert codes["1-415-555-0123"].startswith("at 1-") and "T12:00:00Z" in codes["2020-03-04T12:00:00Z"]
