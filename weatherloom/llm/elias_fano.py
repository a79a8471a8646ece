"""Monotone sequences in Elias-Fano form, looked up in bulk with numpy, and files of arrays to map.

A value is cut into low bits, stored as they are, and a high part, stored in unary: for each high part
a one per value that has it, then a zero. The zero before a high part and the zero behind it bound the
few values that share it, so a successor search selects two zeros and compares low bits in between.
"""

import json
import uuid

import numpy as np
import pyarrow as pa

from .warc import open_store

_WORD = 64
_ALIGNED = 8
# Values whose low bits are packed at a time; a multiple of 8, so that a block's bits end with a byte.
_BLOCK = 1 << 16


def _low_bits(values: np.ndarray, n: int) -> np.ndarray:
    """The `n` lowest bits of each value, lowest first."""
    bits = np.empty((len(values), n), np.uint8)
    for i in range(n):
        bits[:, i] = (values >> np.uint64(i)) & np.uint64(1)
    return bits.ravel()


def _words(data: np.ndarray) -> np.ndarray:
    """Bytes of packed bits as 64-bit words with one word to spare."""
    words = np.zeros(-(-len(data) // 8) + 1, np.uint64)
    words.view(np.uint8)[: len(data)] = data
    return words


def _select(words, before, k):
    """Places of the k-th set bits; `before` counts those in front of each word."""
    word = np.searchsorted(before, k, side="right") - 1
    rest, x = k - before[word], words[word]
    at = word * _WORD
    for width in (32, 16, 8, 4, 2, 1):
        low = x & np.uint64((1 << width) - 1)
        count = np.bitwise_count(low).astype(np.int64)
        beyond = rest >= count
        at += width * beyond
        rest -= count * beyond
        x = np.where(beyond, x >> np.uint64(width), low)
    return at


class EliasFano:
    """A sorted sequence of 64-bit unsigned values."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, low_bits, base = (int(x) for x in arrays["shape"])
        self.low_bits, self.base = np.uint64(low_bits), np.uint64(base)
        self.low, self.high = arrays["low"], arrays["high"]
        ones = np.bitwise_count(self.high).astype(np.int64)
        before = np.cumsum(ones) - ones
        self.zeros_before = np.arange(len(ones)) * _WORD - before
        self.ones_before = before
        self.buckets = int(arrays["buckets"][0])

    @staticmethod
    def arrays(values: np.ndarray) -> dict[str, np.ndarray]:
        """The arrays that hold sorted values."""
        values = np.asarray(values, np.uint64)
        n = len(values)
        base = values[0] if n else np.uint64(0)
        own = values - base
        spread = int(own[-1]) // n if n else 0
        low_bits = max(spread.bit_length() - 1, 0)
        low = [
            np.packbits(_low_bits(own[i : i + _BLOCK], low_bits), bitorder="little")
            for i in range(0, n, _BLOCK)
        ]
        high = (own >> np.uint64(low_bits)).astype(np.int64)
        buckets = int(high[-1]) + 1 if n else 0
        unary = np.zeros(n + buckets, np.uint8)
        high += np.arange(n)
        unary[high] = 1
        return {
            "shape": np.array([n, low_bits, base], np.uint64),
            "buckets": np.array([buckets], np.int64),
            "low": _words(np.concatenate(low) if low else np.zeros(0, np.uint8)),
            "high": _words(np.packbits(unary, bitorder="little")),
        }

    def _low_at(self, i):
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * self.low_bits
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        bits = self.low[word] >> shift
        bits |= (self.low[word + 1] << np.uint64(1)) << (np.uint64(63) - shift)
        return bits & np.uint64((1 << int(self.low_bits)) - 1)

    def __getitem__(self, i) -> np.ndarray:
        """Values at places `i`."""
        i = np.asarray(i, np.int64)
        high = _select(self.high, self.ones_before, i) - i
        return self.base + ((high.astype(np.uint64) << self.low_bits) | self._low_at(i))

    def successor(self, x) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first value that is `x` or more, whether it is `x`); n if there is none."""
        x = np.asarray(x, np.uint64)
        place, equal = np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        own = x - self.base
        high = own >> self.low_bits
        inside = (x >= self.base) & (high < np.uint64(self.buckets))
        place[(x >= self.base) & ~inside] = self.n
        which = np.flatnonzero(inside)
        if not len(which):
            return place, equal
        high = high[which].astype(np.int64)
        low = own[which] & np.uint64((1 << int(self.low_bits)) - 1)
        zeros, before = ~self.high, self.zeros_before
        first = np.where(high > 0, _select(zeros, before, np.maximum(high - 1, 0)) - high + 1, 0)
        last = _select(zeros, before, high) - high
        end = last.copy()
        while True:
            left = np.flatnonzero(first < last)
            if not len(left):
                break
            middle = (first[left] + last[left]) // 2
            less = self._low_at(middle) < low[left]
            first[left] = np.where(less, middle + 1, first[left])
            last[left] = np.where(less, last[left], middle)
        place[which] = first
        there = first < end
        equal[which[there]] = self._low_at(first[there]) == low[there]
        return place, equal


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays in one file that `map_arrays` opens: a line of names and places, then the arrays."""
    places, at = {}, 0
    for name, array in arrays.items():
        places[name] = [array.dtype.str, at, len(array)]
        at += -(-array.nbytes // _ALIGNED) * _ALIGNED
    head = json.dumps(places).encode()
    head += b" " * (-(len(head) + 1) % _ALIGNED) + b"\n"
    store, path = open_store(uri)
    # A repeated task writes a file of its own, and the one that is mapped already stays whole.
    own = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as file:
        file.write(head)
        for array in arrays.values():
            file.write(np.ascontiguousarray(array).tobytes())
            file.write(b"\0" * (-array.nbytes % _ALIGNED))
    store.move(own, path)


def map_arrays(uri: str) -> dict[str, np.ndarray]:
    """Arrays of a file, mapped into memory where the store is a file system, else read."""
    store, path = open_store(uri)
    if isinstance(store, pa.fs.LocalFileSystem):
        with pa.memory_map(path) as file:
            data = file.read_buffer()
    else:
        with store.open_input_file(path) as file:
            data = file.read_buffer()
    data = np.frombuffer(data, np.uint8)
    head = data[: 1 << 16].tobytes().split(b"\n", 1)[0]
    start, arrays = len(head) + 1, {}
    for name, (kind, at, n) in json.loads(head).items():
        size = n * np.dtype(kind).itemsize
        arrays[name] = data[start + at : start + at + size].view(kind)
    return arrays
