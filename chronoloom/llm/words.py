"""Words of whole texts as numpy arrays, straight from Arrow buffers.

A block of texts is lower-cased (A-Z only), cut into words and hashed in a few vector operations. The hash of a word
is a polynomial over random byte values modulo 2**64, mixed; equal words have equal hashes in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words of anything but white space: [^\x20\x09-\x0D]+
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words of lower-case letters, digits and all that isn't ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
PLAIN = np.zeros(256, dtype=bool)
PLAIN[0x30:0x3A] = PLAIN[0x61:0x7B] = PLAIN[0x80:] = True

_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C13
_P_INV = pow(_P, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(1 << max(12, int(n - 1).bit_length()), base, dtype=np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


class Words:
    """The words of a block of texts: hash, first and past-last byte, and for each text where its words begin."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, kind: np.ndarray):
        low = _LOWER[raw]
        n = len(low)
        inside = kind[low]
        edge = np.zeros(n + 1, dtype=bool)
        edge[at] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:n]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.start, at)
        self.low, self.text_at = low, at
        if n:
            part = _BYTE[low]
            part *= _power(_P, n)
            total = np.empty(n + 1, dtype=np.uint64)
            total[0] = 0
            np.cumsum(part, out=total[1:])
            self._total, self._back = total, _power(_P_INV, n)[self.start]
            self.hash = mix((total[self.end] - total[self.start]) * self._back)
        else:
            self._total = self._back = np.zeros(1, dtype=np.uint64)
            self.hash = np.zeros(0, dtype=np.uint64)

    def __len__(self) -> int:
        return len(self.hash)

    def prefix_hash(self, n_bytes: int) -> tuple[np.ndarray, np.ndarray]:
        """(words longer than n_bytes, hashes of their first n_bytes, which differ from those of whole words)."""
        long = np.flatnonzero(self.end - self.start > n_bytes)
        first = self.start[long]
        return long, mix((self._total[first + n_bytes] - self._total[first]) * self._back[long] + np.uint64(n_bytes))


def _cuts(at: np.ndarray, block_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``block_bytes``; a longer text is a range of its own."""
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + block_bytes, side="right")) - 1)
        yield lo, hi
        lo = hi


class ShardWords:
    """The words of a large block of texts, as ``Words`` has them, hashed a smaller block at a time.

    So the arrays of a number a byte are as long as a small block, and only those of a number a word as long as the whole.
    """

    def __init__(self, raw: np.ndarray, at: np.ndarray, kind: np.ndarray, block_bytes: int = 1 << 19):
        none = np.zeros(0, np.int64)
        hashes, starts, ends, begins, n = [np.zeros(0, np.uint64)], [none], [none], [none], 0
        for lo, hi in _cuts(at, block_bytes):
            words = Words(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], kind)
            hashes.append(words.hash)
            starts.append(words.start + at[lo])
            ends.append(words.end + at[lo])
            begins.append(words.at[:-1] + n)
            n += len(words)
        self.hash, self.start, self.end, self.at = (np.concatenate(x) for x in (hashes, starts, ends, [*begins, np.array([n])]))

    def __len__(self) -> int:
        return len(self.hash)


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", block_bytes: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Arrow batches cut into blocks of whole texts of about ``block_bytes``; a longer text is a block of its own."""
    for batch in batches:
        raw, at = text_buffers(batch.column(batch.schema.get_field_index(column)))
        for lo, hi in _cuts(at, block_bytes):
            yield batch.slice(lo, hi - lo), raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]


def word_blocks(batches: Iterator[pa.RecordBatch], kind: np.ndarray, column: str = "text", block_bytes: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch, raw, at in text_blocks(batches, column, block_bytes):
        yield batch, Words(raw, at, kind)


def sum_by(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i+1]], empty ranges being 0."""
    total = np.zeros(len(values) + 1, dtype=values.dtype)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def hash_of(words: list[bytes]) -> np.ndarray:
    """Hashes of single words, the same as in a text."""
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return Words(np.frombuffer(b"".join(words), dtype=np.uint8), at, np.ones(256, dtype=bool)).hash


def long_lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))


def raw_strings(column: pa.Array) -> list[bytes | None]:
    """The bytes of a string column, whether they are valid UTF-8 or not; null stays None."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    return pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(column), column.buffers(), column.null_count, column.offset).to_pylist()


def string_column(values: list[bytes | None], kind: pa.DataType) -> pa.Array:
    """A string column of given bytes, which aren't checked."""
    held = pa.array(values, pa.large_binary() if pa.types.is_large_string(kind) else pa.binary())
    return pa.Array.from_buffers(kind, len(held), held.buffers(), held.null_count, held.offset)
