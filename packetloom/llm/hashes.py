"""Array arithmetic on texts: words, polynomial prefix hashes and content-defined runs of windows.

All hashes are modulo 2^64 over random unit values, so one cumulative sum gives the hash of
any stretch: ``(prefix[b] - prefix[a]) * base^-a``. Two bases make 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, (256,), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Units that array code holds temporaries for at a time.
BLOCK = 1 << 16


class Powers:
    """Powers of a number: those below ``BLOCK``, and those of multiples of ``BLOCK``, as far as asked for."""

    known: dict[int, "Powers"] = {}

    def __init__(self, base: int):
        self.low = self._row(base)
        self.step = pow(base, BLOCK, 1 << 64)
        self.high = np.ones(1, dtype=np.uint64)

    @staticmethod
    def _row(base: int, n: int = BLOCK) -> np.ndarray:
        return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, base, dtype=np.uint64)])

    @classmethod
    def of(cls, base: int, n: int) -> "Powers":
        """Able to give the powers up to ``n``."""
        if base not in cls.known:
            cls.known[base] = cls(base)
        own = cls.known[base]
        if len(own.high) <= n // BLOCK:
            own.high = cls._row(own.step, 2 * (n // BLOCK) + 2)
        return own

    def at(self, exponents: np.ndarray) -> np.ndarray:
        return self.low[exponents & (BLOCK - 1)] * self.high[exponents >> 16]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prefix:
    """Hashes of stretches of one array of unit values."""

    def __init__(self, values: np.ndarray, base: int = BASES[0]):
        n = len(values)
        up, self.down = Powers.of(base, n), Powers.of(pow(base, -1, 1 << 64), n)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        for k, lo in enumerate(range(0, n, BLOCK)):
            part = values[lo:lo + BLOCK]
            own = self.sums[lo + 1:lo + 1 + len(part)]
            np.cumsum(part * (up.low[:len(part)] * up.high[k]), out=own)
            own += self.sums[lo]

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down.at(start)

    def windows(self, width: int, first: int = 0, end: int | None = None) -> np.ndarray:
        """Hash of every stretch of ``width`` units that starts from ``first`` on and before ``end``."""
        end = len(self.sums) - width if end is None else end
        if end <= first:
            return np.zeros(0, dtype=np.uint64)
        return (self.sums[first + width:end + width] - self.sums[first:end]) * self.down.at(np.arange(first, end))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets), without nulls."""
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    edges = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[edges[0]:edges[-1]] if data is not None and edges[-1] > edges[0] else np.zeros(0, dtype=np.uint8)
    return raw, edges - edges[0]


def word_values(data: np.ndarray, edges: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets of each text's words)."""
    if lower:
        data = LOWER[data]
    inside = ~IS_SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[edges] = True
    start = np.flatnonzero(inside & (cut[:-1] | np.r_[True, ~inside[:-1]]))
    end = np.flatnonzero(inside & (cut[1:] | np.r_[~inside[1:], True])) + 1
    hashes = mixed(Prefix(BYTE[data]).spans(start, end) + (end - start).astype(np.uint64)) if len(start) else np.zeros(0, dtype=np.uint64)
    return hashes, np.searchsorted(start, edges)


def owners(edges: np.ndarray) -> np.ndarray:
    """The text number of every unit."""
    return np.repeat(np.arange(len(edges) - 1), np.diff(edges))


class Runs:
    """Consecutive windows of a text that share their anchor, the least of the short grams inside a window.

    Which windows make a run, and where its anchor lies, follows from the units in them alone, so equal passages
    of any two texts are cut alike. Arrays by run: ``text``, ``ordinal`` within the text, ``first`` window
    (a position in the text), ``count`` of windows, ``lead`` units before the anchor, ``anchor`` and ``content`` hashes.
    """

    def __init__(self, values: np.ndarray, edges: np.ndarray, window: int, gram: int):
        empty = np.zeros(0, dtype=np.int64)
        long = np.flatnonzero(np.diff(edges) >= window)
        if len(long):
            prefix = Prefix(values)
            first, last, place, self.text = self._cut(prefix, edges, long, window, gram)
            self.first, self.count, self.lead = first - edges[self.text], last - first + 1, place - first
            self.anchor = mixed(prefix.spans(place, place + gram))
            del prefix
            whole = Prefix(values, BASES[1]).spans(first, last + window)
            self.content = mixed(whole + mixed((self.lead << 32 | self.count).astype(np.uint64)))
        else:
            self.text = self.first = self.count = self.lead = empty
            self.anchor = self.content = np.zeros(0, dtype=np.uint64)
        fresh = np.flatnonzero(np.r_[True, np.diff(self.text) != 0]) if len(self.text) else empty
        self.ordinal = np.arange(len(self.text)) - np.repeat(fresh, np.diff(np.r_[fresh, len(self.text)]))

    @staticmethod
    def _cut(prefix: Prefix, edges: np.ndarray, long: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
        """(first window, last window, anchor's place, text) of every run, a block of windows at a time."""
        opened, ended = [], []
        before = (-2, -1)  # the window before this block, and its anchor
        begin, end = edges[long], edges[long + 1] - window + 1
        wide = window - gram + 1
        for lo in range(int(begin[0]), int(end[-1]), BLOCK):
            hi = min(lo + BLOCK, int(end[-1]))
            met = slice(np.searchsorted(end, lo, side="right"), np.searchsorted(begin, hi))
            starts = np.maximum(begin[met], lo)
            sizes = np.minimum(end[met], hi) - starts
            total = int(sizes.sum())
            if not total:
                continue
            at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
            grams = mixed(prefix.windows(gram, lo, hi + wide - 1))
            least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
            span = 1
            while span * 2 <= wide:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            if span < wide:
                least = np.minimum(least[:len(least) - (wide - span)], least[wide - span:])
            anchor = (least[at - lo] & np.uint64(0xFFFFFFFF)).astype(np.int64) + lo
            heads = np.flatnonzero((np.diff(anchor, prepend=before[1]) != 0) | (np.diff(at, prepend=before[0]) != 1))
            opened.append((at[heads], anchor[heads], np.repeat(long[met], sizes)[heads]))
            ended.append(np.where(heads > 0, at[heads - 1], before[0]))
            before = (int(at[-1]), int(anchor[-1]))
        first, place, text = (np.concatenate(x) for x in zip(*opened))
        return first, np.r_[np.concatenate(ended)[1:], before[0]], place, text
