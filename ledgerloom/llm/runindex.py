"""A run-length compressed Burrows-Wheeler index over many short strings.

The strings are sorted as suffixes, each ending in a mark that is smaller than any byte; equal
suffixes stand in the order of their strings. Of the transform only its runs are kept: where they
begin, their byte, how often the byte came before, and the text position of the suffixes at both
ends of each run. Intervals of suffixes that share their first ``window`` bytes, and one byte fewer,
are kept where they have more than one member, with the least of the positions that the caller gave.
So the index grows with what differs among the strings, not with how often it is repeated.

Strings are streamed through the index from right to left, all of them in step. The state of each
is its matching statistic: the length of the match that begins here, at most ``window``, the interval
of suffixes that begin with it, and one place in the text where it stands. A byte in front narrows
the interval by counts of that byte in the runs; a match that would grow past ``window`` first loses
its last byte, which widens the interval to the kept one that encloses it. The row of each string's
last whole window is kept too: where only windows are asked for, streaming starts there.
"""

from __future__ import annotations

import numpy as np

FIRST = 7  # bytes compared at once: 9 bits each, in 63


def _doubled(ranks: np.ndarray, left: np.ndarray, size: int, step: int) -> np.ndarray:
    """Ranks by the first ``size + step`` bytes, from ranks by ``size`` (``step`` at most that)."""
    other = np.zeros_like(ranks)
    inside = np.flatnonzero(left > step)  # otherwise the string has ended before
    other[inside] = ranks[inside + step] + 1
    other += ranks * (len(ranks) + 1)
    return _ranked(other)


def _order(values: np.ndarray) -> np.ndarray:
    """The places of the values (of 0 and above) in order, equal ones as they stand."""
    n = len(values)
    bits = max(1, (n - 1).bit_length())
    if not n or int(values.max()).bit_length() + bits > 63:
        return np.argsort(values, kind="stable")
    # Sorting numbers is several times faster than sorting their places.
    return np.sort((values << bits) | np.arange(n)) & ((1 << bits) - 1)


def _ranked(values: np.ndarray) -> np.ndarray:
    """For each value, how many different ones are smaller."""
    order = _order(values)
    ordered = values[order]
    new = np.zeros(len(values), np.int64)
    new[1:] = ordered[1:] != ordered[:-1]
    ranks = np.empty(len(values), np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


class RunIndex:
    def __init__(self, strings: list[bytes], order: np.ndarray, window: int):
        """``order`` gives, for each byte of all strings, the place that ``earliest`` compares."""
        self.window = window
        lengths = np.array([len(s) for s in strings], np.int64) + 1
        ends = np.cumsum(lengths)
        self.begins = ends - lengths
        n = int(ends[-1]) if len(strings) else 0
        symbols = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
        symbols[ends - 1] = 0
        left = np.repeat(ends, lengths) - np.arange(n)  # symbols up to the mark, it included
        places = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends - 1] = False
        places[inside] = order

        packed = np.zeros(n, np.int64)
        for k in range(FIRST):
            here = np.flatnonzero(left > k)
            packed[here] += symbols[here + k] << (9 * (FIRST - 1 - k))
        ranks = _ranked(packed)
        size, half, half_size = FIRST, None, 0
        while size < int(lengths.max(initial=0)):
            if size <= window - 1 <= 2 * size:
                half, half_size = ranks, size
            ranks = _doubled(ranks, left, size, size)
            size *= 2
        if half is None:
            half, half_size = ranks, size  # the strings are shorter than a window
        suffixes = _order(ranks)
        del ranks, packed

        ahead = np.r_[0, symbols[:-1]]
        ahead[self.begins] = 0
        before = ahead[suffixes]
        rows = np.empty(n, np.int64)
        rows[suffixes] = np.arange(n)
        last = ends - 1 - window  # of strings that have a window
        self.entries = np.where(last >= self.begins, rows[np.maximum(last, 0)], -1) if n else last
        self.entry_places = last
        cut = np.ones(n, bool)
        cut[1:] = before[1:] != before[:-1]
        self.run_starts = np.flatnonzero(cut)
        run_ends = np.r_[self.run_starts[1:], n]
        self.heads = before[self.run_starts]
        self.first_samples = suffixes[self.run_starts]
        self.last_samples = suffixes[run_ends - 1]
        self.size = n
        # Runs of one byte stand together, with the number of that byte in the runs before.
        by_byte = np.lexsort((self.run_starts, self.heads))
        self._keys = self.heads[by_byte] * (n + 1) + self.run_starts[by_byte]
        self._starts = self.run_starts[by_byte]
        self._runs = by_byte
        sizes = (run_ends - self.run_starts)[by_byte]
        total = np.cumsum(sizes) - sizes
        firsts = np.r_[True, self.heads[by_byte][1:] != self.heads[by_byte][:-1]] if n else cut
        group = np.maximum.accumulate(np.where(firsts, np.arange(len(firsts)), 0))
        self._before = total - total[group]
        self._sizes = sizes
        self._smaller = np.r_[0, np.cumsum(np.bincount(symbols, minlength=257))]

        def repeated(length: int) -> tuple[np.ndarray, np.ndarray]:
            """Intervals of at least two suffixes that share ``length`` bytes."""
            if n < 2 or length < half_size or length > 2 * half_size:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            fits = left[suffixes] > length
            a, b = suffixes[:-1], suffixes[1:]
            shift = length - half_size
            far = np.minimum(suffixes + shift, n - 1)
            same = fits[:-1] & fits[1:] & (half[a] == half[b]) & (half[far[:-1]] == half[far[1:]])
            edge = np.diff(np.r_[0, same.astype(np.int8), 0])
            return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1

        self.long_starts, self.long_ends = repeated(window)
        self.wide_starts, self.wide_ends = repeated(window - 1)
        self.long_samples = suffixes[self.long_starts]
        self.wide_samples = suffixes[self.wide_starts]
        if len(self.long_starts):
            spans = np.stack([self.long_starts, self.long_ends], axis=1).reshape(-1)
            ordered = np.r_[places[suffixes], np.iinfo(np.int64).max]
            self.earliest = np.minimum.reduceat(ordered, spans)[::2]
        else:
            self.earliest = np.zeros(0, np.int64)

    def _count(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often the symbol stands before the row in the transform."""
        at = np.searchsorted(self._keys, symbol * (self.size + 1) + row, side="right") - 1
        at = np.maximum(at, 0)
        of_it = (self.heads[self._runs[at]] == symbol) & (self._starts[at] <= row)
        inside = np.minimum(row - self._starts[at], self._sizes[at])
        return np.where(of_it, self._before[at] + inside, 0)

    def _next(self, symbol: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        """A text place for the first suffix after the byte was put in front: that of the row if it
        lies in a run of the byte, else the sample at the start of the next such run."""
        run = np.searchsorted(self.run_starts, row, side="right") - 1
        at = np.searchsorted(self._keys, symbol * (self.size + 1) + row, side="left")
        after = self.first_samples[self._runs[np.minimum(at, len(self._runs) - 1)]]
        return np.where(self.heads[run] == symbol, place, after) - 1

    def stream(self, strings: list[bytes], windows_only: bool = False):
        """Matching statistics of the strings that the index was built of, from right to left.

        Yields ``(which, at, length, low, high, place)``: for these strings, the match that begins
        at byte ``at`` has ``length`` bytes, stands at rows ``low`` to ``high`` and at ``place``.
        """
        lengths = np.array([len(s) for s in strings], np.int64)
        offsets = np.r_[0, np.cumsum(lengths)]
        text = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
        which = np.argsort(-lengths, kind="stable")
        if windows_only:
            which = which[lengths[which] >= self.window]
            at = lengths[which] - self.window
            low = self.entries[which]
            place = self.entry_places[which]
            low, high, place = self._enclosing(low, self.long_starts, self.long_ends, self.long_samples, place)
            length = np.full(len(which), self.window)
            yield which, at, length, low, high, place
        else:
            which = which[lengths[which] > 0]
            at = lengths[which]
            low, high = np.zeros(len(which), np.int64), np.full(len(which), self.size)
            place = np.full(len(which), self.first_samples[0] if self.size else 0)
            length = np.zeros(len(which), np.int64)
        while True:
            going = np.flatnonzero(at > 0)
            if not len(going):
                return
            if len(going) < len(at):
                which, at, low, high = which[going], at[going], low[going], high[going]
                place, length = place[going], length[going]
            full = np.flatnonzero(length == self.window)
            low[full], high[full], place[full] = self._enclosing(
                low[full], self.wide_starts, self.wide_ends, self.wide_samples, place[full], high[full]
            )
            at = at - 1
            symbol = text[offsets[which] + at]
            place = self._next(symbol, low, place)
            base = self._smaller[symbol]
            low, high = base + self._count(symbol, low), base + self._count(symbol, high)
            length = np.minimum(length + 1, self.window)
            yield which, at, length, low, high, place

    @staticmethod
    def _enclosing(low, starts, ends, samples, place, high=None):
        """The kept intervals around rows, or the rows alone; and a place of the first row."""
        high = low + 1 if high is None else high
        if not len(starts):
            return low, high, place
        at = np.maximum(np.searchsorted(starts, low, side="right") - 1, 0)
        inside = (starts[at] <= low) & (low < ends[at])
        return (
            np.where(inside, starts[at], low),
            np.where(inside, ends[at], high),
            np.where(inside, samples[at], place),
        )

    def repeats(self, strings: list[bytes]):
        """``which, at, earliest`` of all windows of the strings that stand at other places too."""
        for which, at, length, low, high, _ in self.stream(strings, windows_only=True):
            found = np.flatnonzero(high - low > 1)
            if len(found):
                row = np.searchsorted(self.long_starts, low[found])
                yield which[found], at[found], self.earliest[row]
