"""What a text must fit to count as one of its language."""

from pyspark.sql import functions as F

from ledgerloom.llm import language


def test_least_fits_are_of_all_labelled_rows(spark, monkeypatch):
    """Not only of those that the model is learned from."""
    monkeypatch.setattr(language, "SAMPLE_DOCS", 20)
    vowels = "aeiou"
    texts = [f"the word number {'b' + vowels[k % 5] + vowels[k // 5 % 5]} is here again" for k in range(300)]
    texts[1::30] = [f"qx{vowels[k % 5]}zvvk jjq xqz wvx" * (1 + k) for k in range(10)]
    rows = spark.createDataFrame(
        [(k, text, "en") for k, text in enumerate(texts)] + [(None, None, "en"), (301, "the", None)],
        "doc_id long, text string, lang string",
    )
    model = language.learn(rows)
    every = language.identified(rows.where("text is not null and lang is not null"), model, with_fit=True)
    least = every.agg(F.min("fit")).first()[0]
    drawn = language.identified(language._sampled(rows, "doc_id", "text", "lang")[1], model, with_fit=True)
    assert least < drawn.agg(F.min("fit")).first()[0]  # the least is of a row that is not drawn
    assert language.least_fits(rows, model, 0.0) == {"en": least}
