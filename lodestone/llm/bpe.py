"""Byte-level BPE encoding and decoding by merge replay over the words of a slice of the corpus.

A task cuts the texts of a slice into the pattern's pieces, and replays the
merges over the distinct pieces it has not met yet, all at once: an inverted
index names for each rank the places where a pair with that rank stands, the
lowest rank is applied at all its places at once, and only the neighbours of
changed places enter the index anew. A piece costs what its own merges cost,
however long it is. A worker keeps known pieces up to a bound, then forgets them.

Nothing is shuffled. Defined cases: null and empty texts have no tokens, and the
digests of nothing; ids that the vocabulary lacks can't be decoded and raise
``ValueError``; of pairs of one rank that share a token the left one is joined;
repeated rows get equal results, a null id is an id like others, and an empty
table gives no rows. Other columns are not looked at, whatever their names; a
key named like a result column raises ``AnalysisException``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodestone.llm import worker
from lodestone.llm.textbytes import slices

#: Bytes of pieces a task remembers before it starts afresh.
KNOWN_BYTES = 16 << 20
#: Bytes of text whose new pieces are replayed together.
SLICE = 1 << 20


def ranks(path: str) -> dict[bytes, int]:
    """A rank file's tokens; a token's rank is its id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """A rank file's tokens, and for each pair of tokens that a merge joins the rank of the result."""

    def __init__(self, path: str):
        tokens = ranks(path)
        self.bytes_of: list[bytes | None] = [None] * (max(tokens.values()) + 1)
        for token, rank in tokens.items():
            self.bytes_of[rank] = token
        self._width = np.int64(len(self.bytes_of))
        self.byte_ids = np.array([tokens[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in tokens.items():
            for k in range(1, len(token)):
                left, right = tokens.get(token[:k]), tokens.get(token[k:])
                if left is not None and right is not None:
                    pairs[left * int(self._width) + right] = rank
        self._keys = np.array(sorted(pairs), np.int64)
        self._ranks = np.array([pairs[k] for k in self._keys.tolist()], np.int64)
        self.lengths = np.array([-1 if t is None else len(t) for t in self.bytes_of])
        self.pool = np.frombuffer(b"".join(t or b"" for t in self.bytes_of), np.uint8)
        self.starts = np.cumsum(np.maximum(self.lengths, 0)) - np.maximum(self.lengths, 0)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for a pair that no merge joins."""
        key = left * self._width + right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], -1)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        if len(ids) and (ids.max() >= len(self.lengths) or (self.lengths[ids] < 0).any()):
            raise ValueError("an id stands for no token")
        size = self.lengths[ids]
        place = np.repeat(self.starts[ids] - (np.cumsum(size) - size), size)
        return self.pool[place + np.arange(len(place))].tobytes()


def replay(words: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """The token ids of each word (none of them empty), as little-endian unsigned 32-bit integers."""
    if not words:
        return []
    data = vocabulary.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    token, after, before = data.copy(), np.arange(1, len(data) + 1), np.arange(-1, len(data) - 1)
    after[ends - 1], before[starts] = -1, -1
    rank = np.full(len(data), -1)
    pairs = np.flatnonzero(after >= 0)
    rank[pairs] = vocabulary.rank(token[pairs], token[pairs + 1])

    # The inverted index: the places where a pair with a rank stands, or stood when it was entered.
    pairs = pairs[rank[pairs] >= 0]
    pairs = pairs[np.argsort(rank[pairs], kind="stable")]
    waiting, first = np.unique(rank[pairs], return_index=True)
    waiting = waiting.tolist()
    index = {r: part.tolist() for r, part in zip(waiting, np.split(pairs, first[1:]), strict=True)} if waiting else {}
    while waiting:
        now = heapq.heappop(waiting)
        at = np.array(index.pop(now))
        at = np.unique(at[rank[at] == now])
        if not len(at):
            continue
        right = after[at]
        near = np.searchsorted(at, right)
        if (at[np.minimum(near, len(at) - 1)] == right).any():  # pairs that share a token: the left one goes first
            taken, kept = set(), []
            for p, q in zip(at.tolist(), right.tolist(), strict=True):
                if p not in taken:
                    kept.append(p)
                    taken.add(q)
            at = np.array(kept)
            right = after[at]
        beyond = after[right]
        token[at], token[right], rank[right] = now, -1, -1
        after[at] = beyond
        inner = beyond >= 0
        before[beyond[inner]] = at[inner]
        rank[at] = -1
        touched = np.concatenate([at[inner], before[at]])
        touched = touched[touched >= 0]
        new = vocabulary.rank(token[touched], token[after[touched]])
        rank[touched] = new
        for r, p in zip(new.tolist(), touched.tolist(), strict=True):
            if r >= 0:
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heapq.heappush(waiting, r)
    alive = token >= 0
    ids = token[alive].astype("<u4").tobytes()
    last = (np.cumsum(alive)[ends - 1] * 4).tolist()
    return [ids[a:b] for a, b in zip([0, *last[:-1]], last, strict=True)]


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit integers; and back."""

    def __init__(self, path: str, pattern: str):
        self._vocabulary = Vocabulary(path)
        self._pieces = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self._known: dict[str, bytes] = {}
        self._size = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self._pieces(t) for t in texts]
        new = set().union(*cut).difference(self._known)
        if new and self._size > KNOWN_BYTES:
            self._known.clear()
            self._size, new = 0, set().union(*cut)
        new = list(new)
        self._known.update(zip(new, replay([p.encode() for p in new], self._vocabulary), strict=True))
        self._size += sum(250 + 8 * len(p) for p in new)
        known = self._known.__getitem__
        return [b"".join(map(known, pieces)) for pieces in cut]

    def decode(self, ids: bytes) -> bytes:
        return self._vocabulary.decode(np.frombuffer(ids, "<u4").astype(np.int64))


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder, which keeps what it knows from task to task."""
    return worker.keep((path, pattern), lambda: Encoder(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids binary`` (little-endian unsigned 32-bit integers) of each whole text."""
    narrow = docs.select(key, text)

    def run(batches):
        coder = encoder(path, pattern)
        for rows, _, _ in slices(batches, text, SLICE):
            ids = coder.encode([t or "" for t in rows.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([rows.column(key), pa.array(ids, pa.binary())], [key, "ids"])

    return narrow.mapInArrow(run, f"{key} {narrow.schema[key].dataType.simpleString()}, ids binary")


def decode(tokens: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, text binary``: the bytes that the ids stand for, null for null."""
    narrow = tokens.select(key, ids)

    def run(batches):
        coder = encoder(path, pattern)
        for rows in batches:
            raw = [None if x is None else coder.decode(x) for x in rows.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(key), pa.array(raw, pa.binary())], [key, "text"])

    return narrow.mapInArrow(run, f"{key} {narrow.schema[key].dataType.simpleString()}, text binary")


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256``, and ``ids`` if asked for: encoding and decoding of each text, digested where it is made."""
    narrow = docs.select(key, text)
    sha = lambda values: pa.array([hashlib.sha256(v).hexdigest() for v in values])

    def run(batches: Iterable[pa.RecordBatch]):
        coder = encoder(path, pattern)
        for rows, _, _ in slices(batches, text, SLICE):
            ids = coder.encode([t or "" for t in rows.column(text).to_pylist()])
            columns = [rows.column(key), pa.array([len(x) // 4 for x in ids], pa.int64()), sha(ids), sha(map(coder.decode, ids))]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return narrow.mapInArrow(run, f"{key} {narrow.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
