"""Byte-level BPE: encoding and decoding by batched merge rounds.

The words of a batch that were not met before are laid out as one flat array of symbols.
A round finds every neighbouring pair's rank by binary search over the sorted pair keys,
merges the lowest-ranked pair of each word (all its places, left to right), and repeats
until no word has a pair to merge. Results are kept per word in a table of bounded size. A long
word, such as a line of base64, is merged by itself: its rounds touch only the places of the lowest
rank and their neighbours, so that time grows with the merges, not with rounds times length.

The vocabulary file is read on the driver and broadcast: its size is that of the file, not
of the data. There is no shuffle; each task works through its own batches, so a lost
executor costs only its tasks.

Defined results: a null text is encoded as an empty one (no ids). Extra columns are not
read. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

# Fixed value: the pattern of byte-level BPE. White space is spelled out, as engines differ.
SPACE = r"\t-\r\x20\x85\xA0  -     　"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
# The same for texts that are all ASCII, where letters and digits are short lists.
ASCII_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+"
    r"| ?[^\t-\r\x20A-Za-z0-9]+|[\t-\r\x20]+(?![^\t-\r\x20])|[\t-\r\x20]+"
)
KEPT_WORDS = 150_000
LONG_WORD = 256  # bytes; a longer word is merged by itself
SLICE_CHARS = 1_500_000
NONE = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files, as letter to byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in set(plain)]
    return {chr(byte): byte for byte in plain} | {
        chr(256 + place): byte for place, byte in enumerate(others)
    }


class Vocabulary:
    """Merge ranks as sorted pair keys, and the bytes of each id."""

    def __init__(self, content: str):
        self.digest = hashlib.sha256(content.encode()).hexdigest()
        file = json.loads(content)
        vocab = file["model"]["vocab"]
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        self.size = max([*vocab.values(), *special.values()]) + 1
        self.bytes = [b""] * self.size
        for token, number in vocab.items():
            self.bytes[number] = bytes(letters[letter] for letter in token)
        for token, number in special.items():
            self.bytes[number] = token.encode()
        self.special = special
        self.of_byte = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.of_byte[byte] = vocab[letter]
        merges = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words = regex.compile(PATTERN)
        self.ascii_words = re.compile(ASCII_PATTERN)
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def merged(self, words: list[str]) -> list[bytes]:
        """The ids of each word (32-bit), by merge rounds over all words together."""
        v = self.vocabulary
        raw = [word.encode() for word in words]
        long = {k: self.merged_long(r) for k, r in enumerate(raw) if len(r) > LONG_WORD}
        if long:
            others = iter(self.merged([w for k, w in enumerate(words) if k not in long]))
            return [long[k] if k in long else next(others) for k in range(len(raw))]
        lengths = np.array([len(r) for r in raw], np.int64)
        symbols = v.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), lengths)
        done_symbols, done_words = [], []
        while len(symbols):
            at, rank = self._ranks(symbols, word)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(word)])
            of_word = np.repeat(lowest, sizes)
            open_ = of_word != NONE
            if not open_.all():  # words without a pair to merge are ready
                done_symbols.append(symbols[~open_])
                done_words.append(word[~open_])
                symbols, word, at, rank = symbols[open_], word[open_], at[open_], rank[open_]
                of_word = of_word[open_]
                if not len(symbols):
                    break
            hit = rank == of_word
            # Of places in a row (only where both symbols are alike) every other one counts.
            place = np.arange(len(hit))
            begins = hit & ~np.r_[False, hit[:-1]]
            first = np.maximum.accumulate(np.where(begins, place, 0))
            hit &= (place - first) % 2 == 0
            symbols = np.where(hit, v.made[at], symbols)
            keep = ~np.r_[False, hit[:-1]]
            symbols, word = symbols[keep], word[keep]
        if not done_symbols:
            return [b""] * len(raw)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        flat = symbols[order].astype(np.int32).tobytes()
        ends = (4 * np.searchsorted(word[order], np.arange(len(raw) + 1))).tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:])]

    def merged_long(self, raw: bytes) -> bytes:
        """The ids of one long word. A round takes only the places of the lowest rank, which wait
        by rank, and looks up only the pairs that its merges have made."""
        v = self.vocabulary
        symbols = v.of_byte[np.frombuffer(raw, np.uint8)]
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n)  # neighbours; the last place is no symbol
        at, rank = self._ranks(symbols, np.zeros(n, np.int64))
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[rank[places] != NONE]
            if not len(places):
                return
            places = places[np.argsort(rank[places], kind="stable")]
            found = rank[places]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            for part in np.split(places, cuts) if len(cuts) else [places]:
                number = int(rank[part[0]])
                if number not in waiting:
                    waiting[number] = []
                    heapq.heappush(ranks, number)
                waiting[number].append(part)

        wait(np.arange(n))
        while ranks:
            lowest = heapq.heappop(ranks)
            parts = waiting.pop(lowest)
            places = np.unique(np.concatenate(parts)) if len(parts) > 1 else np.sort(parts[0])
            places = places[rank[places] == lowest]  # others were merged meanwhile
            if not len(places):
                continue
            # Of places in a row (only where both symbols are alike) every other one counts.
            follows = np.zeros(len(places), bool)
            follows[1:] = after[places[:-1]] == places[1:]
            if follows.any():
                number = np.arange(len(places))
                first = np.maximum.accumulate(np.where(follows, 0, number))
                places = places[(number - first) % 2 == 0]
            gone = after[places]
            symbols[places] = v.made[at[places]]
            rank[gone] = NONE
            after[places] = after[gone]
            before[after[gone]] = places
            changed = before[places]
            changed = np.unique(np.concatenate([places, changed[changed >= 0]]))
            right = after[changed]
            inside = right < n
            rank[changed] = NONE
            changed, right = changed[inside], right[inside]
            wanted = symbols[changed] * v.size + symbols[right]
            found = np.minimum(np.searchsorted(v.keys, wanted), len(v.keys) - 1)
            hit = v.keys[found] == wanted
            at[changed[hit]] = found[hit]
            rank[changed[hit]] = v.ranks[found[hit]]
            wait(changed[hit])
        kept, place = [], 0
        after_list = after.tolist()
        while place < n:
            kept.append(place)
            place = after_list[place]
        return symbols[kept].astype(np.int32).tobytes()

    def _ranks(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each symbol with its neighbour: place among the pair keys, and rank."""
        v = self.vocabulary
        at = np.zeros(len(symbols), np.int64)
        rank = np.full(len(symbols), NONE)
        inside = word[1:] == word[:-1]
        wanted = symbols[:-1] * v.size + symbols[1:]
        found = np.minimum(np.searchsorted(v.keys, wanted), len(v.keys) - 1)
        hit = inside & (v.keys[found] == wanted)
        at[:-1] = np.where(hit, found, 0)
        rank[:-1] = np.where(hit, v.ranks[found], NONE)
        return at, rank

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        parts = [self._parts(text) for text in texts]
        unknown = set().union(*parts).difference(self.known)
        if len(self.known) + len(unknown) > KEPT_WORDS:  # the words of two batches stay
            self.before, self.known = self.known, {}
            unknown = set().union(*parts)
        for word in unknown & self.before.keys():
            self.known[word] = self.before[word]
        fresh = [word for word in unknown if word not in self.known]
        self.known.update(zip(fresh, self.merged(fresh), strict=True))
        ids_of = self.known.__getitem__
        return [np.frombuffer(b"".join(map(ids_of, part)), np.int32) for part in parts]

    def _parts(self, text: str) -> list[str]:
        if self.cut is None or not self.cut.search(text):
            return self._words(text)
        special = self.vocabulary.special
        parts: list[str] = []
        for piece in self.cut.split(text):
            if piece in special:
                self.known[piece] = np.array([special[piece]], np.int32).tobytes()
                parts.append(piece)
            else:
                parts += self._words(piece)
        return parts

    def _words(self, text: str) -> list[str]:
        return (self.ascii_words if text.isascii() else self.words).findall(text)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder per worker process, so that its tasks share the known words."""
    vocabulary = shared.value
    if vocabulary.digest not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary.digest] = Encoder(vocabulary)
    return _ENCODERS[vocabulary.digest]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def slices(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many characters; a longer text is a run of its own."""
    begin, size = 0, 0
    for end, text in enumerate(texts):
        if size and size + len(text) > most:
            yield begin, end
            begin, size = end, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def _broadcast(spark: SparkSession, path: str | None):
    with open(path or default_vocabulary(), encoding="utf-8") as file:
        return spark.sparkContext.broadcast(Vocabulary(file.read()))


def encoded(docs: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text"):
    """``key``, ``ids`` (array of int) and ``decoded`` (text made from the ids) per row."""
    shared = _broadcast(docs.sparkSession, vocabulary)
    kind = docs.schema[key].dataType

    def work(batches):
        encoder = _encoder(shared)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts, SLICE_CHARS):
                ids = encoder.encode_batch(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(ids, pa.list_(pa.int32())),
                        pa.array([encoder.decode(i) for i in ids], pa.string()),
                    ],
                    names=["key", "ids", "decoded"],
                )

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    result = rows.mapInArrow(work, f"key {kind.simpleString()}, ids array<int>, decoded string")
    return result.withColumnRenamed("key", key)


def digests(docs: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text"):
    """``key``, ``n_tokens`` and the digests of the ids and of the text decoded from them.

    The same encoder as ``encoded``; ids and texts are digested where they are made.
    """
    shared = _broadcast(docs.sparkSession, vocabulary)
    kind = docs.schema[key].dataType

    def work(batches):
        encoder = _encoder(shared)
        digits = [str(n) for n in range(shared.value.size)]
        sha = hashlib.sha256
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts, SLICE_CHARS):
                ids = encoder.encode_batch(texts[a:b])
                joined = [",".join(map(digits.__getitem__, i.tolist())).encode() for i in ids]
                decoded = [encoder.decode(i).encode() for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array([sha(x).hexdigest() for x in joined], pa.string()),
                        pa.array([sha(x).hexdigest() for x in decoded], pa.string()),
                    ],
                    names=["key", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    result = rows.mapInArrow(
        work,
        f"key {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
    return result.withColumnRenamed("key", key)
