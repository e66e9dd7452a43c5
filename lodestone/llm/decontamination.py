"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over training text.

Test items and documents are lower-cased (A-Z) and cut into words. A window is
``size`` consecutive words of an item; an item with fewer words, but not none,
is one window. The hashes of all windows are broadcast in a block whose size is
checked; a larger test set is split by item into several such blocks. These are
scanned one after the other: the driver holds one at a time, and the documents
carry what was found so far from block to block through a written table. A
window of a document whose hash is in the set is compared word by word before
it counts.

Defined cases: a null or wordless text has no words and no hits; a null or
wordless item has no windows; an item with a null id but a text hits and isn't
named; repeated documents are judged one by one; equal items under two ids are
both named; an empty benchmark contaminates nothing, and an empty table of
documents gives an empty one; a text of any length is scanned whole; further
columns stay in ``remove`` whatever their names and types, and ``scan`` reads
none but its key and text (a key named as one of its results is refused).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.patterns import spare
from lodestone.llm.shared import Scratch
from lodestone.llm.textbytes import ALNUM_SPLIT, Words, sequence_hash, slices, utf8

#: Words in a window.
SIZE = 13
#: Bytes of test text whose windows are broadcast at a time.
BLOCK_BYTES = 8 << 20
#: A document is contaminated if one word in so many is hit.
SHARE = 20
_FILTER_BITS = 22

_SPANS = "array<struct<first: long, last: long, begin: long, end: long>>"
SCANNED = f"n_words long, n_hit long, item_ids array<string>, spans {_SPANS}"
_SPAN = pa.struct([(x, pa.int64()) for x in ("first", "last", "begin", "end")])


class Windows(NamedTuple):
    """The windows of one block of test items: for each length, what the hashes stand for."""

    known: dict[int, dict[int, dict[bytes, list[str]]]]

    @classmethod
    def of(cls, items: list[tuple[str | None, str]], size: int) -> Windows:
        known: dict = {}
        for item_id, text in items:
            data, offsets = utf8(pa.array([text], pa.string()))
            words = Words(data, offsets, ALNUM_SPLIT)
            n = len(words.hash)
            width = min(n, size)
            for k in range(n - width + 1 if width else 0):
                key = int(sequence_hash(words.hash[k : k + width]))
                owners = known.setdefault(width, {}).setdefault(key, {}).setdefault(words.text(k, k + width), [])
                if item_id is not None and item_id not in owners:
                    owners.append(item_id)
        return cls(known)

    def filters(self) -> dict[int, np.ndarray]:
        """A bitmap by the upper bits of the hashes: most windows are ruled out by one look."""
        out = {}
        for width, keys in self.known.items():
            out[width] = np.zeros(1 << _FILTER_BITS, bool)
            out[width][np.fromiter(keys, np.uint64, len(keys)) >> np.uint64(64 - _FILTER_BITS)] = True
        return out


def _scan(words: Words, windows: Windows, filters: dict[int, np.ndarray]) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Which words are hit, and for each document the items whose windows occur."""
    edge = np.zeros(len(words.hash) + 1, np.int64)
    items: dict[int, set[str]] = defaultdict(set)
    for width, keys in windows.known.items():
        at, hashes = words.window_hashes(width)
        maybe = np.flatnonzero(filters[width][hashes >> np.uint64(64 - _FILTER_BITS)])
        for k in maybe.tolist():
            if (texts := keys.get(int(hashes[k]))) and (owners := texts.get(words.text(at[k], at[k] + width))) is not None:
                edge[at[k]] += 1
                edge[at[k] + width] -= 1
                items[int(words.doc[at[k]])].update(owners)
    return np.cumsum(edge[:-1]) > 0, items


def _runs(words: Words, hit: np.ndarray, doc: int, offset: int) -> list[dict]:
    """Runs of hit words of a document: its words ``first`` to ``last`` (not included), and their bytes."""
    a, b = words.first[doc], words.first[doc + 1]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]])))
    return [{"first": int(x), "last": int(y), "begin": int(words.start[a + x] - offset), "end": int(words.end[a + y - 1] - offset)} for x, y in zip(edges[::2], edges[1::2], strict=True)]


class _Found(NamedTuple):
    """What a slice of rows holds, by the blocks so far: which words are hit, how many by document, and whose windows they are."""

    rows: pa.RecordBatch
    words: Words
    hit: np.ndarray
    n_hit: np.ndarray
    items: dict[int, set[str]]
    offsets: np.ndarray

    def runs(self) -> pa.Array:
        return pa.array([_runs(self.words, self.hit, d, self.offsets[d]) if self.n_hit[d] else [] for d in range(self.rows.num_rows)], pa.list_(_SPAN))

    def item_ids(self) -> pa.Array:
        return pa.array([sorted(self.items.get(d, ())) for d in range(self.rows.num_rows)], pa.list_(pa.string()))


def _scanner(broadcast, text: str, results: Callable[[_Found], pa.RecordBatch], held: tuple[str, str] | None):
    """``held``: the columns with the hit words and items of earlier blocks."""

    def run(batches):
        windows = broadcast.value
        filters = windows.filters()
        for rows, data, offsets in slices(batches, text):
            words = Words(data, offsets, ALNUM_SPLIT)
            hit, items = _scan(words, windows, filters)
            if held:
                for d, (spans, ids) in enumerate(zip(*(rows.column(c).to_pylist() for c in held), strict=True)):
                    for span in spans:
                        hit[words.first[d] + span["first"] : words.first[d] + span["last"]] = True
                    if ids:
                        items[d].update(ids)
            yield results(_Found(rows, words, hit, np.bincount(words.doc[hit], minlength=rows.num_rows), items, offsets))

    return run


def _over_blocks(docs: DataFrame, benchmark: DataFrame, size: int, text: str, item_id: str, item_text: str, block_bytes: int, results: Callable[[_Found], pa.RecordBatch], schema) -> DataFrame:
    """``results`` of the documents after all blocks of test items; one item is never split.

    One pass and nothing written while the test set fits a block. Otherwise each
    block but the last writes the documents with what it and its predecessors found.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).filter("t IS NOT NULL").distinct()
    n = max(1, -(-items.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0))).first()[0] // block_bytes))
    held = None
    if n > 1:
        spans = spare("_spans", docs.columns)
        held = (spans, spare("_items", [*docs.columns, spans]))
        docs = docs.withColumns({held[0]: F.array().cast(_SPANS), held[1]: F.array().cast("array<string>")})

    def carry(found: _Found) -> pa.RecordBatch:
        rows = found.rows
        for name, column in zip(held, (found.runs(), found.item_ids()), strict=True):
            rows = rows.set_column(rows.schema.get_field_index(name), name, column)
        return rows

    scratch = Scratch(spark, "decontamination") if n > 1 else None
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64(F.coalesce("i", "t")), F.lit(n)) == k)
        block = spark.sparkContext.broadcast(Windows.of([(r.i, r.t) for r in part.collect()], size))
        if k == n - 1:
            return docs.mapInArrow(_scanner(block, text, results, held), schema)
        docs = scratch.write(docs.mapInArrow(_scanner(block, text, carry, held), docs.schema), f"block-{k}")
        block.destroy()


def scan(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``key, n_words, n_hit, item_ids, spans`` per document; spans are byte ranges of its UTF-8 text. No shuffle of documents."""
    names = [key, "n_words", "n_hit", "item_ids", "spans"]
    if key in names[1:]:
        raise ValueError(f"the key is named as a result: {key}")
    narrow = docs.select(key, text)

    def results(found: _Found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([found.rows.column(key), pa.array(found.words.counts, pa.int64()), pa.array(found.n_hit, pa.int64()), found.item_ids(), found.runs()], names)

    return _over_blocks(narrow, benchmark, size, text, item_id, item_text, block_bytes, results, f"`{key}` {narrow.schema[key].dataType.simpleString()}, {SCANNED}")


def remove(docs: DataFrame, benchmark: DataFrame, how: str = "documents", size: int = SIZE, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without contaminated ones, or (``how="spans"``) without their hit bytes. All columns stay; no shuffle of documents."""
    columns = docs.columns

    def results(found: _Found) -> pa.RecordBatch:
        rows = found.rows.select(columns)
        if how == "documents":
            return rows.filter(pa.array((found.n_hit == 0) | (found.n_hit * SHARE < found.words.counts)))
        column, kept = rows.schema.get_field_index(text), rows.column(text).to_pylist()
        for d in np.flatnonzero(found.n_hit).tolist():
            raw, parts, at = kept[d].encode(), [], 0
            for run in _runs(found.words, found.hit, d, found.offsets[d]):
                parts.append(raw[at : run["begin"]])
                at = run["end"]
            kept[d] = b"".join([*parts, raw[at:]]).decode()
        return rows.set_column(column, rows.schema.field(column), pa.array(kept, rows.schema.field(column).type))

    return _over_blocks(docs, benchmark, size, text, item_id, item_text, block_bytes, results, docs.schema)


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """The columns of the query: counts, a digest of the item ids, and the verdict."""
    return scanned.select(
        key,
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words"))).alias("contaminated"),
    )
