"""Quality rules: a table of thresholds compiled into one projection.

``measured`` adds the counts, ``ruled`` the verdict. Both are built from SQL functions
only and need no shuffle: every count is of one text.

Defined results: a null or empty text has zero words and fails the length rule; ratios of
an empty text are 0. Repeated rows are judged alike and all kept. Input columns stay, but a
column with the name of a result is replaced by the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.words import WORD, text_of, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 3

# Frequent function words of the languages the rules are meant for.
STOP_WORDS = (
    "the of and to in a is that for it was with be by on "
    "der die und das den von zu mit ist des "
    "le la les et des un une que du dans "
    "el los en y una por con para del las"
).split()


@dataclass(frozen=True)
class Rule:
    """A ratio or count that a good text keeps within bounds, both included."""

    name: str
    value: str  # SQL over the columns that ``measured`` adds
    least: float | None = None
    most: float | None = None

    def broken(self) -> Column:
        value = F.expr(self.value)
        tests = [value < self.least] if self.least is not None else []
        tests += [value > self.most] if self.most is not None else []
        return tests[0] if len(tests) == 1 else tests[0] | tests[1]


# The first two make up ``base_failed``.
BASE_RULES = (
    Rule("length", "n_words", least=50),
    Rule("repetition", "100 * n_repeat_words - 50 * n_words", most=0),
)
RULES = (
    Rule("word_length", "word_chars / greatest(n_words, 1)", least=2.0, most=14.0),
    Rule("symbols", "n_symbols / greatest(n_words, 1)", most=0.1),
    Rule("stop_words", "n_stop_words / greatest(n_words, 1)", least=0.02),
    Rule("duplicate_lines", "n_dup_lines / greatest(n_lines, 1)", most=0.5),
    Rule("upper_case", "n_upper / greatest(word_chars, 1)", most=0.5),
)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts that the rules are about."""
    words = F.col("_words")
    windows, places = F.col("_windows"), F.col("_places")
    # Words are compared by their 64-bit hashes: within one text, two windows that differ
    # but hash alike are not to be expected.
    starts = F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW)
    hashes = F.when(
        F.col("n_words") >= WINDOW,
        F.transform(
            starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
        ),
    )
    # Hash and place of each window, equal windows side by side; nothing to sort in the
    # many texts that repeat no window.
    by_hash = F.when(
        F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
        F.sort_array(
            F.transform("_hashes", lambda h, i: F.struct(h.alias("hash"), i.alias("place")))
        ),
    )
    repeated = F.filter(
        windows,
        lambda w, i: F.coalesce(
            F.get(windows, i - 1)["hash"] == w["hash"], F.lit(False)
        )
        | F.coalesce(F.get(windows, i + 1)["hash"] == w["hash"], F.lit(False)),
    )
    # A window covers the words that the repeated window before it did not reach.
    covered = F.aggregate(
        places,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("total")),
        lambda seen, place: F.struct(
            place.alias("last"),
            (seen["total"] + F.least(F.lit(WINDOW), place - seen["last"])).alias("total"),
        ),
        lambda seen: seen["total"],
    )

    def pieces(pattern: str) -> Column:
        """How often the pattern, one character, is in the text."""
        return (F.size(F.split("_text", pattern)) - 1).cast("bigint")

    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(WORD))
    return (
        docs.withColumn("_text", text_of(text))
        .withColumn("_words", words_of(F.col("_text")))
        .withColumn("_lines", lines)
        .withColumns(
            {
                "n_words": F.size("_words").cast("bigint"),
                "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
                "n_symbols": pieces(f"[{SYMBOLS}]"),
                "n_lines": F.size("_lines").cast("bigint"),
                "n_dup_lines": (
                    F.size("_lines") - F.size(F.array_distinct("_lines"))
                ).cast("bigint"),
                "n_stop_words": F.size(
                    F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))
                ).cast("bigint"),
                "n_upper": pieces(r"\p{Lu}"),
            }
        )
        .withColumn("_hashes", hashes)
        .withColumn("_windows", by_hash)
        .withColumn("_places", F.sort_array(F.transform(repeated, lambda w: w["place"])))
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint")))
        .drop("_text", "_words", "_lines", "_hashes", "_windows", "_places")
    )


def ruled(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Adds the counts, ``base_failed``, ``broken_rules`` (names) and ``kept``."""
    base = BASE_RULES[0].broken() | BASE_RULES[1].broken()
    broken = [F.when(rule.broken(), F.lit(rule.name)) for rule in (*BASE_RULES, *rules)]
    return (
        measured(docs, text)
        .withColumn("base_failed", base)
        .withColumn("broken_rules", F.array_compact(F.array(*broken)))
        .withColumn("kept", F.size("broken_rules") == 0)
    )
