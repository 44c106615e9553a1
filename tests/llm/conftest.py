import pytest

TEXT = (
    "the river of this small town is wide and it was quiet by the water in the morning when "
    "people came to see the boats that were on the other side of the old stone bridge and they "
    "talked for a long time with the fishermen about the weather and the price of the fish in "
    "the market of the city far away from here where nobody knew their names"
)
GERMAN = (
    "der fluss in der kleinen stadt ist breit und das wasser war still am morgen als die leute "
    "kamen um die boote zu sehen die auf der anderen seite der alten steinernen bruecke lagen"
)


def near(text: str, place: int = 30) -> str:
    words = text.split()
    words[place] = "changed"
    return " ".join(words)


ROWS = [
    (1, TEXT, "en", "a"),
    (2, TEXT, "en", "a"),  # a copy
    (3, near(TEXT), "en", "b"),  # a near copy
    (4, GERMAN, "de", "b"),
    (5, None, "en", None),
    (6, "", None, "b"),
    (7, " \n\t ", "de", "a"),
    (8, "two words", "en", "c"),
    (9, (GERMAN + "\n") * 200, "de", "c"),  # long
    (9, (GERMAN + "\n") * 200, "de", "c"),  # a repeated row
    (10, "12345 !!! ???", None, "c"),
    (None, "a text without a key", "en", "a"),
]
# Names that operators use for themselves or for results.
CLASHING = "key size row score fingerprint shard copy n_words rate block table node digest".split()


@pytest.fixture(scope="session")
def docs(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    frame = frame.withColumn("n_chars", F.length("text").cast("long"))
    return frame.withColumns({name: F.lit("x") for name in CLASHING})


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
