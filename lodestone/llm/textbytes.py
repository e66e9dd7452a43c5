"""Words of whole texts as numpy arrays over the UTF-8 bytes of an Arrow batch.

Everything here works inside a Spark task on a bounded slice of a batch: a few
megabytes of text, or one document if that is longer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time, within a task.
SLICE_BYTES = 1 << 20

#: Words of at most so many bytes are named by these bytes themselves.
_SHORT = 7
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def _lower_table(word_byte) -> np.ndarray:
    """For each byte 0 if it ends words, else one more than the byte in lower case."""
    lower = lambda b: b + 32 if 65 <= b <= 90 else b
    return np.array([lower(b) + 1 if word_byte(lower(b)) else 0 for b in range(256)], np.uint16)


#: Words are runs of anything but white space (space and bytes 9 to 13).
SPACE_SPLIT = _lower_table(lambda b: not (b == 0x20 or 9 <= b <= 0x0D))
#: Words are runs of digits, ASCII letters and all that is not ASCII.
ALNUM_SPLIT = _lower_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins and ends. Null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, len(column) + 1, column.offset * 8) if at else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Whole documents, about ``limit`` bytes at a time: the rows, their bytes and offsets."""
    for batch in batches:
        data, offsets = utf8(batch.column(text))
        row, rows = 0, batch.num_rows
        while row < rows:
            last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
            last = min(last, rows)
            yield batch.slice(row, last - row), data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
            row = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def digests(parts: list[bytes]) -> np.ndarray:
    """Two 64-bit halves of a cryptographic digest of each string: strings can't be made to share them."""
    return np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=16).digest() for p in parts), "<i8").reshape(-1, 2)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash's factor, and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES)
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, f)])) for f in (_FACTOR, _INVERSE)]
    return _powers[0][:n], _powers[1][:n]


class Words:
    """The words of a slice: ``start`` and ``end`` byte, ``doc`` row and 64-bit ``hash`` of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        value = table[data]
        on = value != 0
        before = np.empty_like(on)
        before[:1] = False
        before[1:] = on[:-1]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        self.start = np.flatnonzero(on & ~before)
        after = np.empty_like(on)
        after[-1:] = False
        after[:-1] = on[1:]
        inner = offsets[1:-1]
        after[inner[inner > 0] - 1] = False
        self.end = np.flatnonzero(on & ~after) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.counts = np.bincount(self.doc, minlength=len(offsets) - 1)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self._low = np.zeros(len(data) + 8, np.uint8)
        np.subtract(value, 1, out=self._low[: len(data)], casting="unsafe")
        self.hash = self._names()

    def _names(self) -> np.ndarray:
        """Short words are their own names, with their lengths; the names of longer ones are cryptographic digests."""
        size = (self.end - self.start).astype(np.uint64)
        packed = np.ndarray((len(self._low) - 7,), "<u8", self._low, 0, (1,))[self.start]
        names = mix(packed & ((np.uint64(1) << np.uint64(8) * np.minimum(size, np.uint64(_SHORT))) - np.uint64(1)) | size << np.uint64(56))
        long = np.flatnonzero(size > _SHORT)
        raw = self._low.tobytes() if len(long) else b""
        words = [raw[a:b] for a, b in zip(self.start[long].tolist(), self.end[long].tolist(), strict=True)]
        known = list(set(words))
        name_of = dict(zip(known, digests(known)[:, 0].tolist(), strict=True))
        names[long] = np.fromiter(map(name_of.__getitem__, words), np.int64, len(words)).view(np.uint64)
        return names

    def window_hashes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For each window of ``size`` words within a document, its first word and its hash."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total *= _FACTOR
            total += self.hash[k : k + n]
        return at, mix(total[at])

    def text(self, first: int, last: int) -> bytes:
        """Words ``first`` to ``last`` in lower case, joined by one space."""
        return b" ".join(self._low[a:b].tobytes() for a, b in zip(self.start[first:last], self.end[first:last], strict=True))


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """The hash that ``window_hashes`` gives to exactly these words."""
    total = np.zeros(1, np.uint64)
    for h in hashes:
        total *= _FACTOR
        total += h
    return mix(total)[0]
