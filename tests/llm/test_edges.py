"""Every operator on nulls, empty and long texts, repeated rows, clashing names, no rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import (
    bpe,
    kneser_ney,
    language,
    licenses,
    minhash,
    mixing,
    neardup,
    pii,
    quality_rules,
    repeats,
    sharding,
    simhash,
)


def trusted(docs):
    return docs.where("doc_id < 5").select("doc_id")


OPERATORS = {
    "simhash": simhash.near_duplicates,
    "quality_rules": quality_rules.ruled,
    "mixing": mixing.mixed,
    "pii": pii.pseudonymised,
    "kneser_ney": lambda d: kneser_ney.judged(d, trusted(d)),
    "minhash": minhash.compared_with_next,
    "sharding": sharding.sharded,
    "bpe": bpe.encoded,
    "licenses": licenses.scanned,
    "language": lambda d: language.identified(d, language.learn(d), with_spans=True),
    "neardup": neardup.deduplicated,
    "repeats": repeats.cut,
}
ONE_ROW_EACH = set(OPERATORS) - {"mixing", "neardup"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_edge_rows(docs, name):
    rows = OPERATORS[name](docs).collect()
    if name in ONE_ROW_EACH:
        assert len(rows) == docs.count()
        assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 10]
    repeated = [r for r in rows if r.doc_id == 9]
    if name not in {"sharding", "mixing", "neardup"}:
        assert repeated[0] == repeated[1]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_no_rows(nothing, name):
    assert OPERATORS[name](nothing).collect() == []


def test_stages_keep_the_columns(spark, docs):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, plain, "").columns == plain.columns, name
        assert stage(spark, plain.limit(0), "").count() == 0, name
    last = corpus_pipeline.STAGES[-1][1](spark, plain, "")
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_language_stage_rejects_what_has_no_letters(spark, docs):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    kept = {r.doc_id for r in corpus_pipeline.in_known_language(spark, plain, "").collect()}
    assert kept == {1, 2, 3, 4, 8, 9, None}


def test_copies_stage_keeps_one_of_each_group(spark, docs):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    kept = sorted(r.doc_id or 0 for r in corpus_pipeline.without_copies(spark, plain, "").collect())
    # 5 to 7: a null, an empty and a blank text; only the first two are equal.
    assert kept[:2] == [0, 1] and 2 not in kept and 3 not in kept
    # 9 repeats the words of 4 and has no other shingles but those at its line ends.
    assert 4 in kept and 9 not in kept and 6 not in kept


def test_pseudonyms_stage_counts_characters_anew(spark):
    plain = spark.createDataFrame(
        [(1, "from 10.0.0.1 here", "en", "a", 0)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    row = corpus_pipeline.with_pseudonyms(spark, plain, "").first()
    assert "10.0.0.1" not in row.text and row.n_chars == len(row.text)


def test_repeated_source_names_and_null_sources_are_mixed(docs):
    table = mixing.rates(docs).collect()
    assert {r["_source"] for r in table} == {"a", "b", "c", None}
    assert sum(r.rate * r["size"] for r in table) == pytest.approx(
        docs.agg(F.sum(F.length(F.coalesce("text", F.lit(""))))).first()[0]
    )


def test_language_stage_rejects_what_is_no_learned_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    letters = random.Random(3)
    texts = [
        "Сегодня утром мы пошли на рынок, чтобы купить хлеб и молоко, но магазин был закрыт",
        "Dzisiaj rano poszliśmy na targ, żeby kupić chleb i mleko dla całej rodziny, ale sklep był "
        "jeszcze zamknięty i musieliśmy wrócić do domu",
        " ".join("".join(letters.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(40)),
        " ".join("".join(letters.choices("bcdfghjklmnpqrstvwxz", k=6)) for _ in range(40)),
    ]
    odd = spark.createDataFrame([(f"odd{k}", t) for k, t in enumerate(texts)], "doc_id string, text string")
    both = docs.withColumn("doc_id", F.col("doc_id").cast("string")).unionByName(odd, allowMissingColumns=True)
    kept = [r.doc_id for r in corpus_pipeline.in_known_language(spark, both, "").select("doc_id").collect()]
    assert not [k for k in kept if k.startswith("odd")]
    assert len(kept) >= 0.997 * docs.count()  # 0.1% of the labelled ones may go
