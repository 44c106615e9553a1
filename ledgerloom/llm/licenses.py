"""License scans: MinHash bands over windows of the text retrieve license notices.

Texts and templates are read as lower-case words. Templates are whole bodies, standard headers and
short declarations (``license_texts.py``); of long ones the shingles of three words count, of those
of fewer than ``LONG`` words the words themselves, as one changed word leaves too few shingles.
For each length of a template, windows of that length slide over a text in steps of a quarter. A
window and a template that share a band of MinHash values are candidates; the share of the
template's shingles (or words) that the window really has, compared word by word, decides. A short
declaration must also call the license by its name and say that something is licensed or released.

``bands_for`` sets the number of bands so that a window at the least similarity is missed
with a probability below ``MISS``. A window without any shingle of any template cannot share
a MinHash value with one, and one in which nothing is licensed or released matches no declaration, so
only windows around these are hashed. Headings that stand in a line of their own, and identifiers behind
``SPDX-License-Identifier``, are looked up. Templates are a fixed table, which is sent to the tasks;
there is no shuffle, and each task scans its texts whole.

With a share of 0.8, a declaration of five words or more, and any long template, may have a word
changed; shorter declarations are needed whole. Of places that fit several licenses, the one with
the larger share, then the longer one, has it.

Defined results: a null, empty or license-free text has no matches. Repeated rows are scanned
alike. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from ledgerloom.llm.license_texts import BODIES, DECLARATIONS, HEADERS, NAMES, PHRASES, TELLING, TITLES

SHINGLE = 3
LONG = 17  # words: of so many, one changed leaves four fifths of the shingles
ROWS = 2
LEAST = 0.8  # containment of a match
MISS = 0.001
MARGIN = 1 / 8  # what a window of the template's length can be off, as a share of it


@dataclass(frozen=True)
class Template:
    license: str
    text: str
    name: str = ""  # words in a row that a match must have


TEMPLATES = (
    *(Template(license, text) for license, text in (*BODIES, *HEADERS)),
    *(
        Template(license, declaration.format(name).replace("License license", "License"), name)
        for declaration in DECLARATIONS
        for license, name in NAMES
    ),
    *(Template(license, text, text) for license, text in PHRASES),
)
SPDX = re.compile(r"spdx-license-identifier:[ \t]*([\w.+() -]+)", re.I)
_SPDX_JOINED = {"OR", "AND", "WITH"}

_WORDS = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingle_hashes(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """One hash per shingle of hashed words; of too few words, one of them all."""
    if not len(h):
        return h
    size = min(size, len(h))
    total = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        total = _mixed(total ^ h[k : k + len(total)])
    return total


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def bands_for(similarity: float, miss: float = MISS, rows: int = ROWS) -> int:
    """The least number of bands that misses such a pair with at most this probability."""
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows))


def least_similarity(containment: float = LEAST, margin: float = MARGIN) -> float:
    """Jaccard similarity of a template and the window that lies best on a match."""
    common = containment - margin
    return common / (2 - common)


def shingled(words: list[str], size: int) -> Counter:
    """How often each shingle stands in the words; of one word, each counts as often as it is said."""
    found = Counter(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1)))
    return found if size == 1 else Counter(dict.fromkeys(found, 1))


def contains(words: list[str], name: list[str]) -> bool:
    return not name or any(words[k : k + len(name)] == name for k in range(len(words) - len(name) + 1))


class Windows:
    """Templates whose shingles have one size, by the bands of their MinHash values."""

    def __init__(self, templates: list[Template], size: int, least: float):
        self.templates, self.size, self.least = templates, size, least
        self.words = [words_of(t.text) for t in templates]
        self.names = [words_of(t.name) for t in templates]
        self.shingles = [shingled(words, size) for words in self.words]
        self.bands = bands_for(least_similarity(least))
        seeds = np.arange(1, self.bands * ROWS + 1, dtype=np.uint64)
        self.seeds = _mixed(seeds * np.uint64(0xD6E8FEB86659FD93))
        hashes = [shingle_hashes(word_hashes(words), size) for words in self.words]
        # What a window must have one of: a word that says that something is licensed, or any shingle.
        self.telling = [
            {w for w in words if w in TELLING} or {max(name, key=len)} if name else set()
            for words, name in zip(self.words, self.names)
        ]
        needed = [
            shingle_hashes(word_hashes(sorted(telling)), 1) if telling else h
            for telling, h in zip(self.telling, hashes)
        ]
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *needed]))
        self.lengths = sorted({len(words) for words in self.words})
        self.index: dict[tuple, set[int]] = {}
        for number, h in enumerate(hashes):
            for band in self._bands(h):
                self.index.setdefault((len(self.words[number]), *band), set()).add(number)

    def _bands(self, hashes: np.ndarray) -> list[tuple]:
        least = _mixed(hashes[:, None] ^ self.seeds[None, :]).min(0)
        return [(k, *least[k * ROWS : k * ROWS + ROWS].tolist()) for k in range(self.bands)]

    def share(self, number: int, words: list[str]) -> float:
        """How much of the template the words have; nothing if they lack its name, or all the words
        that say that something is licensed."""
        if not contains(words, self.names[number]):
            return 0.0
        if self.telling[number] and not self.telling[number].intersection(words):
            return 0.0
        wanted = self.shingles[number]
        return (wanted & shingled(words, self.size)).total() / wanted.total()

    def matches(self, words: list[str], hashed: np.ndarray) -> list[tuple[str, int, int, float]]:
        """``(license, first word, word after the last, share)`` of all windows that match."""
        hashes = shingle_hashes(hashed, self.size)
        if not len(hashes) or not len(self.known):
            return []
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        hits = np.flatnonzero(self.known[at] == hashes)
        if not len(hits):
            return []
        found: dict[tuple[int, int], float] = {}
        for length in self.lengths:
            step = max(1, length // 4)
            # Windows, counted in steps, that have one of the shingles.
            first = -(-(hits - length + self.size) // step)
            numbers = np.unique(np.concatenate([first + k for k in range(length // step + 1)]))
            last = max(0, len(words) - length)
            for begin in sorted({min(max(int(n) * step, 0), last) for n in numbers}):
                self._window(words, hashes, begin, length, found)
        return [
            (self.templates[n].license, begin, begin + len(self.words[n]), share)
            for (n, begin), share in found.items()
        ]

    def _window(self, words, hashes, begin, length, found) -> None:
        part = hashes[begin : begin + max(1, length - self.size + 1)]
        candidates = set().union(*(self.index.get((length, *band), ()) for band in self._bands(part)))
        # What a step can be off is looked at too.
        slack = max(1, length // 4)
        there = words[max(0, begin - slack) : begin + length + slack]
        for number in candidates:
            share = self.share(number, there)
            if share >= self.least:
                found[number, begin] = share


class Scanner:
    def __init__(self, templates=TEMPLATES, least: float = LEAST):
        long = [t for t in templates if len(words_of(t.text)) >= LONG]
        short = [t for t in templates if len(words_of(t.text)) < LONG]
        self.families = [Windows(long, SHINGLE, least), Windows(short, 1, least)]
        self.titles = {tuple(words_of(title)): license for license, title in TITLES}

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        """``(license, first word, word after the last, share)``, in order."""
        words = words_of(text)
        hashed = word_hashes(words)
        found = [match for family in self.families for match in family.matches(words, hashed)]
        return self._clear(found + self._looked_up(text))

    def _looked_up(self, text: str) -> list[tuple[str, int, int, float]]:
        """Titles in lines of their own, and declared identifiers."""
        if "license" not in text.lower() and "cc0" not in text.lower():
            return []
        found, spans = [], [m.span() for m in _WORDS.finditer(text.lower())]
        starts = [a for a, _ in spans]
        place = lambda at: bisect_left(starts, at)
        begin = 0
        for row in text.lower().split("\n"):
            license = self.titles.get(tuple(words_of(row))) if len(row) < 200 else None
            if license:
                found.append((license, place(begin), place(begin + len(row)), 1.0))
            begin += len(row) + 1
        for match in SPDX.finditer(text):
            for name in re.finditer(r"[\w.+-]*\w\+?", match[1].split("  ")[0]):
                if name[0] in _SPDX_JOINED:
                    continue
                found.append((name[0], place(match.start()), place(match.end()), 1.0))
                joined = match[1][name.end() :].lstrip(" )").split(" ")[0]
                if joined not in _SPDX_JOINED:
                    break  # what follows is no longer the expression
        return found

    @staticmethod
    def _clear(found: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
        """Windows of one license that overlap are one match, at the best of them; and where the
        words are more like another license, they are that one's."""
        rank = lambda m: (m[3], m[2] - m[1])
        result: list[tuple[str, int, int, float]] = []
        for match in sorted(found):
            if result and result[-1][0] == match[0] and match[1] < result[-1][2]:
                result[-1] = max(result[-1], match, key=rank)
            else:
                result.append(match)
        clear = [
            r
            for r in result
            if not any(rank(o) > rank(r) and o[0] != r[0] and o[1] < r[2] and r[1] < o[2] for o in result)
        ]
        return sorted(clear, key=lambda r: (r[1], r[0]))


MATCH = "struct<license: string, first: bigint, after: bigint, containment: double>"


def scanned(
    docs: DataFrame, templates=TEMPLATES, least: float = LEAST, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, licenses`` (names, sorted) and ``matches`` (with places in words) of each row."""
    kind = docs.schema[key].dataType.simpleString()
    match = pa.struct(
        [
            ("license", pa.string()),
            ("first", pa.int64()),
            ("after", pa.int64()),
            ("containment", pa.float64()),
        ]
    )

    def work(batches):
        scanner = Scanner(templates, least)
        for batch in batches:
            found = [scanner.scan(t.as_py() or "") for t in batch.column(1)]
            names = [sorted({m[0] for m in matches}) for matches in found]
            rows = [[dict(zip(("license", "first", "after", "containment"), m)) for m in matches] for matches in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(names, pa.list_(pa.string())),
                    pa.array(rows, pa.list_(match)),
                ],
                names=["key", "licenses", "matches"],
            )

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    result = rows.mapInArrow(work, f"key {kind}, licenses array<string>, matches array<{MATCH}>")
    return result.withColumnRenamed("key", key)
