"""The corpus pipeline: from raw documents to token ids, in stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written and read
again as the next stage's ``docs``. All but the last return the columns of ``docs``, whatever others
there are beside those of ``documents``.

Defined results: null, empty and letterless texts go in the first stage. Repeated rows and equal
texts are one group of the second, which keeps one row: of the smallest key, any key before null.
Later stages treat repeated rows alike; a row without a key is drawn by its text. Stages of an empty
table return an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, language, mixing, neardup, pii
from ledgerloom.llm.words import documents, saved

LEAST_SCORE = 0.3  # of a document's language; with four languages a guess has 0.25
LEAST_KNOWN = 0.5  # share of letters in scripts that the languages are written in
FIT_QUANTILE = 0.001  # of labelled documents' fits, per language


def in_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: not those without a letter, of other scripts, or
    whose words are no language's. The model is learned from the labelled rows.

    The score compares the languages with each other only. So the letters must also be as
    likely as those of labelled texts: at least as the ``FIT_QUANTILE`` of the language's, less
    the standard deviation of a single letter."""
    labelled = docs.where(~language.held_out())
    model = language.learn(labelled)
    found = language.identified(docs, model, with_fit=True)
    fits = F.lit(True)
    for name, least in language.least_fits(labelled, model, FIT_QUANTILE).items():
        bound = float(least - model.spread[model.languages.index(name)])
        fits = F.when(F.col("lang_pred") == name, F.col("fit") >= bound).otherwise(fits)
    recognised = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    recognised &= fits & (F.col("known_share") >= LEAST_KNOWN)
    return found.where(recognised).select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies, by SimHash as ``op1`` links them and by
    the similarity of shingles, which also holds together what differs in more bits."""
    return neardup.deduplicated(docs)


def with_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced; ``n_chars`` is that of the new text."""
    rows = pii.pseudonymised(docs).withColumn("n_chars", F.length("text").cast("bigint"))
    return rows.select(*docs.columns)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, by their source's rate, in random order."""
    return mixing.mixed(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, and number and digests of the token ids of every text and copy."""
    return bpe.digests(docs)


STAGES = [
    ("language", in_known_language),
    ("near_copies", without_copies),
    ("pseudonyms", with_pseudonyms),
    ("mixing", to_weights),
    ("bpe", tokens),
]

ORACLE_SQL = None  # SQL cannot express the stages; tests compare them with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
