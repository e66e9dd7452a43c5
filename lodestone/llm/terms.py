"""Words of whole texts as Arrow arrays of bytes, told apart by the bytes themselves."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa


class Terms(NamedTuple):
    """The words of a slice of texts in lower case (A-Z), where each begins, and the row it belongs to."""

    words: pa.BinaryArray
    start: np.ndarray
    doc: np.ndarray


def cut(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Terms:
    """``table``: for each byte 0 if it ends words, else one more than the byte in lower case. Words don't cross rows."""
    value = table[data]
    on = value != 0
    begins, ends = on.copy(), on.copy()
    begins[1:] &= ~on[:-1]
    ends[:-1] &= ~on[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = on[inner]
    ends[inner - 1] = on[inner - 1]
    start = np.flatnonzero(begins)
    sizes = np.flatnonzero(ends) + 1 - start
    return Terms(binary(np.cumsum(sizes), (value[on] - 1).astype(np.uint8)), start, np.searchsorted(offsets, start, "right") - 1)


def binary(ends: np.ndarray, data: np.ndarray) -> pa.BinaryArray:
    """Strings of bytes that lie end to end in ``data``."""
    at = np.concatenate([[0], ends]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


def raw(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings, end to end, and the offsets of each (no nulls)."""
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int32, len(column) + 1, column.offset * 4) if at else np.zeros(1, np.int32)
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]
