"""Language ID of mixed text: scripts narrow the candidates, Viterbi labels spans.

A word is a run of letters. Its score for a language is the log probability of its letter
trigrams (with the word's edges), for languages written in the word's script; others are
ruled out. The best sequence of labels, where each change of language costs a penalty, gives
the spans; a document's language is the one with most letters in its spans.

The model is learned from labelled rows: trigram counts per language in a hashed table, and
the scripts that make up a share of its letters. Its size is bounded by ``BUCKETS`` times the
number of languages, so it can be gathered and broadcast. Per language at most about
``SAMPLE_DOCS`` rows, drawn by a hash of the key, are counted.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every
text if there are no labelled rows. Ties go to the language first in the alphabet. Repeated
rows are labelled alike. Extra columns stay as they are.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
BUCKETS = 1 << 16
SAMPLE_DOCS = 20_000
SMOOTHING = 0.5
SWITCH_PENALTY = 12.0
SCRIPT_SHARE = 0.01
RULED_OUT = -1e4
ERRORS = 3.0  # standard errors that a text's fit is given
SLICE_CHARS = 1_000_000  # looked at together for trigrams
PART_CHARS = 2_000_000  # labelled together

# First and last code point of the letters of a script.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)],
}
OTHER_SCRIPT = 1 + len(SCRIPTS)

_CODES: np.ndarray | None = None


def script_codes() -> np.ndarray:
    """Per code point: 0 for what is no letter, else the number of its script."""
    global _CODES
    if _CODES is None:
        codes = np.zeros(sys.maxunicode + 1, np.uint8)
        letters = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool)
        codes[letters] = OTHER_SCRIPT
        for number, ranges in enumerate(SCRIPTS.values(), 1):
            for first, last in ranges:
                span = codes[first : last + 1]
                span[span > 0] = number
        _CODES = codes
    return _CODES


@dataclass
class Words:
    """Trigram buckets of all letters of some texts, and where words and texts begin."""

    buckets: np.ndarray  # per letter
    starts: np.ndarray  # per word: its first letter
    lengths: np.ndarray  # per word: its letters
    scripts: np.ndarray  # per word
    begins: np.ndarray  # per text, and one more: its first word


def words_of(texts: list[str]) -> Words:
    lowered = [text.lower() for text in texts]
    raw = "\0".join(lowered).encode("utf-32-le", "replace")
    points = np.frombuffer(raw, np.uint32)
    scripts = script_codes()[points]
    letter = scripts > 0
    codes = np.where(letter, points, 0).astype(np.uint32)
    before = np.r_[np.uint32(0), codes[:-1]]
    after = np.r_[codes[1:], np.uint32(0)]
    mixed = before * np.uint32(0x9E3779B1) ^ codes * np.uint32(0x85EBCA77) ^ after * np.uint32(0xC2B2AE3D)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x27D4EB2F)
    buckets = (mixed >> np.uint32(16))[letter]
    first = letter & ~np.r_[False, letter[:-1]]
    at_letter = np.cumsum(letter) - 1  # place among the letters
    starts = at_letter[first]
    lengths = np.diff(np.r_[starts, len(buckets)])
    text_ends = np.cumsum([len(t) + 1 for t in lowered])
    begins = np.searchsorted(np.flatnonzero(first), np.r_[0, text_ends])
    return Words(buckets, starts, lengths, scripts[first], begins)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # bucket x language: log probability
    allowed: np.ndarray  # script x language: 0 or RULED_OUT
    known: np.ndarray | None = None  # per script: whether a language is written in it
    spread: np.ndarray | None = None  # per language: of the log probabilities of its letters

    def word_scores(self, words: Words) -> np.ndarray:
        """word x language: how much less likely than the likeliest."""
        if not len(words.starts):
            return np.zeros((0, len(self.languages)), np.float32)
        total = np.add.reduceat(self.scores[words.buckets], words.starts, axis=0)
        total += self.allowed[words.scripts]
        return total - total.max(1, keepdims=True)


def viterbi(scores: np.ndarray, begins: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best label of each word; all texts take their steps together.

    ``begins``: where each text's words begin, and one more.
    """
    sizes = np.diff(begins)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    labels = np.zeros(len(scores), np.int32)
    if not len(order):
        return labels
    at, sizes = begins[:-1][order], sizes[order]
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
    best_before = np.zeros(len(scores), np.int32)
    switched = np.zeros(scores.shape, bool)
    value = scores[at].astype(np.float64)
    ended = np.empty_like(value)
    for t, k in enumerate(active):
        if t:
            ended[k : len(value)] = value[k:]
            value = value[:k]
            best = value.argmax(1)
            switch = value[np.arange(k), best] - penalty
            here = at[:k] + t
            best_before[here] = best
            change = switch[:, None] > value
            switched[here] = change
            value = np.where(change, switch[:, None], value) + scores[here]
    ended[: len(value)] = value
    label = ended.argmax(1)
    for t in range(sizes[0] - 1, -1, -1):
        k = active[t]
        here = at[:k] + t
        labels[here] = label[:k]
        if t:
            change = switched[here, label[:k]]
            label[:k] = np.where(change, best_before[here], label[:k])
    return labels


def predict(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages and scores of texts; labels and lengths (in letters) of all their words."""
    parts = [words_of(texts[a:b]) for a, b in _slices(texts)]
    scores = np.concatenate([model.word_scores(p) for p in parts])
    lengths = np.concatenate([p.lengths for p in parts])
    counts = np.concatenate([np.diff(p.begins) for p in parts])
    begins = np.r_[0, np.cumsum(counts)]
    labels = viterbi(scores, begins)
    n, languages = len(texts), len(model.languages)
    text = np.repeat(np.arange(n), counts)
    letters = np.bincount(text * languages + labels, lengths, n * languages).reshape(n, languages)
    chosen = letters.argmax(1)
    sure = np.exp(scores, out=scores)
    sure = sure[np.arange(len(sure)), chosen[text]] / sure.sum(1)
    total = np.bincount(text, lengths, n)
    score = np.bincount(text, sure * lengths, n) / np.maximum(total, 1)
    names = [model.languages[c] if t else UNKNOWN for c, t in zip(chosen, total)]
    return names, np.clip(np.where(total > 0, score, 0.0), 0, 1), labels, lengths


def _slices(texts: list[str], most: int = SLICE_CHARS):
    begin, size = 0, 0
    for end, text in enumerate(texts):
        if size and size + len(text) > most:
            yield begin, end
            begin, size = end, 0
        size += len(text)
    yield begin, len(texts)


def held_out(key: str = "doc_id") -> Column:
    """The quarter of rows that nothing is learned from."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """The model of rows with a language; see the module about its bounds."""
    sizes, rows = _sampled(labelled, key, text, lang)
    # A row of ``feature`` below 0 counts the letters of a script.
    counts = (
        rows.select("lang", "text")
        .mapInArrow(_counts, "lang string, feature int, n long")
        .groupBy("lang", "feature")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    languages = sorted(sizes)
    place = {name: k for k, name in enumerate(languages)}
    table = np.zeros((BUCKETS, max(1, len(languages))))
    letters = np.zeros((OTHER_SCRIPT + 1, max(1, len(languages))))
    at = np.array([place[name] for name in counts.column("lang").to_pylist()], np.int64)
    feature, n = counts.column("feature").to_numpy(), counts.column("n").to_numpy()
    table[feature[feature >= 0], at[feature >= 0]] = n[feature >= 0]
    letters[-feature[feature < 0], at[feature < 0]] = n[feature < 0]
    scores = np.log(table + SMOOTHING) - np.log(table.sum(0) + SMOOTHING * BUCKETS)
    used = letters >= SCRIPT_SHARE * np.maximum(letters.sum(0), 1)
    known = used.any(1)
    used |= ~known[:, None]  # a script that nobody uses rules nobody out
    allowed = np.where(used, 0.0, RULED_OUT)
    share = table / np.maximum(table.sum(0), 1)
    spread = np.sqrt(np.maximum((share * scores**2).sum(0) - (share * scores).sum(0) ** 2, 0))
    return Model(languages, scores.astype(np.float32), allowed.astype(np.float32), known, spread)


def _sampled(labelled: DataFrame, key: str, text: str, lang: str) -> tuple[dict[str, int], DataFrame]:
    """Rows per language, and the drawn ones of them as ``key, text, lang``."""
    rows = _with_language(labelled, text, lang, F.col(key).alias("key"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    drawn = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for name, size in sizes.items():
        share = F.when(F.col("lang") == name, min(1.0, SAMPLE_DOCS / size)).otherwise(share)
    return sizes, rows.where(drawn < share)


def _with_language(labelled: DataFrame, text: str, lang: str, *besides: Column) -> DataFrame:
    rows = labelled.select(*besides, F.col(text).alias("text"), F.col(lang).alias("lang"))
    return rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())


def _counts(batches):
    table: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = batch.column(1).to_pylist(), batch.column(0).to_pylist()
        for a, b in _slices(texts):
            of = np.array(langs[a:b])
            words = words_of(texts[a:b])
            text = np.repeat(np.arange(b - a), np.diff(words.begins))
            script = np.repeat(words.scripts, words.lengths)
            text = np.repeat(text, words.lengths)
            for name in set(langs[a:b]):
                mine = (of == name)[text]
                found = table.setdefault(name, np.zeros(BUCKETS + OTHER_SCRIPT + 1, np.int64))
                found[:BUCKETS] += np.bincount(words.buckets[mine], minlength=BUCKETS)
                found[BUCKETS:] += np.bincount(script[mine], minlength=OTHER_SCRIPT + 1)
    for name, found in table.items():
        at = np.flatnonzero(found)
        feature = np.where(at < BUCKETS, at, BUCKETS - at)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([name] * len(at)),
                pa.array(feature, pa.int32()),
                pa.array(found[at], pa.int64()),
            ],
            names=["lang", "feature", "n"],
        )


def identified(
    docs: DataFrame, model: Model, text: str = "text", with_spans: bool = False, with_fit: bool = False
) -> DataFrame:
    """The rows with ``lang_pred`` and ``score``, and if asked for ``spans`` (language and
    letters of each) or ``fit`` and ``known_share`` (see ``_fits``). Columns of these names are
    replaced."""
    docs = docs.drop("lang_pred", "score", "spans", *(["fit", "known_share"] if with_fit else []))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def work(batches):
        for whole in batches:
            every = [t or "" for t in whole.column(place).to_pylist()]
            for begin, end in _slices(every, PART_CHARS):
                batch, texts = whole.slice(begin, end - begin), every[begin:end]
                known = shared.value
                if known.languages and texts:
                    names, score, labels, lengths = predict(known, texts)
                else:
                    names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                    labels = lengths = np.zeros(0, np.int64)
                added = {
                    "lang_pred": pa.array(names, pa.string()),
                    "score": pa.array(score, pa.float64()),
                }
                if with_spans:
                    added["spans"] = _spans(known, texts, labels, lengths)
                if with_fit:
                    fit, known_share = _fits(known, texts, names, labels)
                    added |= {"fit": pa.array(fit), "known_share": pa.array(known_share)}
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *added.values()], names=[*batch.schema.names, *added]
                )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    fields += ["lang_pred string", "score double"]
    fields += ["spans array<struct<lang: string, letters: bigint>>"] if with_spans else []
    fields += ["fit double, known_share double"] if with_fit else []
    return docs.mapInArrow(work, ", ".join(fields))


def _fits(model: Model, texts: list[str], names: list[str], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: how likely its letters are at the most, and how many of them are of scripts
    in which a language of the model is written.

    The former is the mean log probability of a letter by the labels of its words, plus
    ``ERRORS`` standard errors of such a mean, so that short texts get the benefit of the doubt.
    """
    fit, share = np.zeros(len(texts)), np.zeros(len(texts))
    if not model.languages:
        return fit, share
    done = 0
    for a, b in _slices(texts):
        words = words_of(texts[a:b])
        counts = np.diff(words.begins)
        letters = np.repeat(np.arange(len(words.starts)), words.lengths)
        text = np.repeat(np.arange(b - a), counts)[letters]
        p = model.scores[words.buckets, labels[done : done + len(words.starts)][letters]]
        done += len(words.starts)
        n = np.maximum(np.bincount(text, minlength=b - a), 1)
        place = {name: k for k, name in enumerate(model.languages)}
        spread = np.array([model.spread[place[x]] if x in place else 0.0 for x in names[a:b]])
        fit[a:b] = np.bincount(text, p, b - a) / n + ERRORS * spread / np.sqrt(n)
        share[a:b] = np.bincount(text, model.known[words.scripts][letters], b - a) / n
    return fit, share


def least_fits(
    labelled: DataFrame, model: Model, quantile: float, text: str = "text", lang: str = "lang"
) -> dict[str, float]:
    """Per language: the ``fit`` that all but a share of its labelled rows have, of all that there are."""
    rows = _with_language(labelled, text, lang)
    found = identified(rows, model, with_fit=True).where(F.col("lang_pred") == F.col("lang"))
    found = found.groupBy("lang").agg(F.percentile_approx("fit", quantile, 10000).alias("least"))
    return {r["lang"]: r["least"] for r in found.collect()}


def _spans(model: Model, texts: list[str], labels: np.ndarray, lengths: np.ndarray) -> pa.Array:
    kind = pa.list_(pa.struct([("lang", pa.string()), ("letters", pa.int64())]))
    if not model.languages:
        return pa.array([[]] * len(texts), kind)
    counts = [np.diff(words_of(texts[a:b]).begins) for a, b in _slices(texts)]
    ends = np.cumsum(np.concatenate(counts)) if counts else np.zeros(0, int)
    result, begin = [], 0
    for end in ends:
        label, size = labels[begin:end], lengths[begin:end]
        first = np.flatnonzero(np.r_[True, label[1:] != label[:-1]]) if end > begin else []
        letters = np.add.reduceat(size, first) if end > begin else []
        result.append(
            [{"lang": model.languages[label[k]], "letters": int(n)} for k, n in zip(first, letters)]
        )
        begin = end
    return pa.array(result, kind)
