"""Words of whole columns of texts, found with numpy in the bytes that Arrow hands over."""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts are looked at in parts of about this many bytes; a longer text is a part of its own.
PART_BYTES = 4 << 20
# Word hashes are computed over blocks of this many bytes, cut between words.
BLOCK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
# Digits, small letters and all bytes of characters beyond ASCII.
WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[ord("0") : ord("9") + 1] = True
WORD_BYTES[ord("a") : ord("z") + 1] = True
WORD_BYTES[0x80:] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ODD = np.uint64(0xBF58476D1CE4E5B9)


class Words(NamedTuple):
    """Words of consecutive texts: lowered bytes, and for each word its span, text and hash."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    rows: int

    def text(self, first: int, count: int) -> str:
        """Words `first` to `first + count - 1`, joined by single spaces."""
        spans = zip(self.start[first : first + count], self.end[first : first + count])
        return b" ".join(self.data[a:b].tobytes() for a, b in spans).decode("utf-8", "replace")

    def bounds(self) -> np.ndarray:
        """Index of the first word of each text, and the number of words at the end."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))


def mix(hashes: np.ndarray) -> np.ndarray:
    """Spread 64-bit hashes over all their bits."""
    hashes = (hashes ^ (hashes >> np.uint64(32))) * _ODD
    hashes = (hashes ^ (hashes >> np.uint64(29))) * _BASE
    return hashes ^ (hashes >> np.uint64(32))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its texts in them. A missing text is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def parts(column: pa.Array, part_bytes: int = PART_BYTES):
    """(first row, bytes, offsets) of consecutive texts of about `part_bytes` together."""
    data, offsets = utf8(column)
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + part_bytes, "right")) - 1
        last = max(last, first + 1)
        own = offsets[first : last + 1]
        yield first, data[own[0] : own[-1]], own - own[0]
        first = last


def _powers(base: np.uint64, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    if n:
        powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


_cached = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > BLOCK_BYTES + 1:
        return _powers(_BASE, n), _powers(_INVERSE, n)
    if not _cached:
        _cached["both"] = _powers(_BASE, BLOCK_BYTES + 1), _powers(_INVERSE, BLOCK_BYTES + 1)
    return _cached["both"]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; spans are ordered and do not overlap.

    Differences of a running polynomial sum, so the cost does not depend on the number of spans.
    Different spans may share a hash: whoever needs certainty compares the bytes.
    """
    hashes = np.empty(len(start), np.uint64)
    first = 0
    while first < len(start):
        low = int(start[first])
        last = max(int(np.searchsorted(end, low + BLOCK_BYTES, "right")), first + 1)
        high = int(end[last - 1])
        powers, inverses = _power_tables(high - low)
        sums = np.zeros(high - low + 1, np.uint64)
        values = (data[low:high].astype(np.uint64) + np.uint64(1)) * powers[: high - low]
        np.cumsum(values, out=sums[1:])
        a, b = start[first:last] - low, end[first:last] - low
        hashes[first:last] = (sums[b] - sums[a]) * inverses[a]
        first = last
    return mix(hashes + (end - start).astype(np.uint64) * _ODD)


def find_words(data: np.ndarray, offsets: np.ndarray, word_bytes=WORD_BYTES) -> Words:
    """Words of texts that lie one behind another in `data`, with A-Z in lower case."""
    data = LOWER[data]
    n = len(data)
    inside = word_bytes[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    firsts = offsets[:-1][offsets[:-1] < n]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    begins[firsts] = inside[firsts]
    ends[lasts] = inside[lasts]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(data, start, end, row, hash_spans(data, start, end), len(offsets) - 1)


def hash_word(word: str) -> np.uint64:
    """The hash that `find_words` gives to this word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return hash_spans(LOWER[data], np.array([0]), np.array([len(data)]))[0]


def grams(words: Words, n: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `n` words, and whether such a run lies within one text."""
    hashes = words.hash if hashes is None else hashes
    count = max(len(hashes) - n + 1, 0)
    sums = np.zeros(count, np.uint64)
    for i in range(n):
        sums = sums * _BASE + hashes[i : i + count]
    return mix(sums), words.row[:count] == words.row[n - 1 : n - 1 + count]
