"""Ranked lexical search: a set of query items against all documents, by classes of equal bags.

Documents are restricted to the items' vocabulary: what is left of one is its
number of terms and the vector of its term frequencies. A document's score for
an item depends on nothing but that vector and its length factor m, so documents
with equal ones form a class: vectors are hashed, and compared in full where
hashes agree. Each class is scored once, by postings from terms to items. A
task keeps the best classes of each item, by score and then by the smallest id
in the class; the best of all tasks' are unfolded into their members by
ascending id. An item's ``top`` documents lie in its ``top`` best classes, and
are among the ``top`` smallest ids of each, so nothing else is unfolded.

The items are searched in blocks of bounded text, whose vocabulary and postings
are broadcast; a larger set of items takes a pass over the documents for each.
Classes are formed by partial aggregation, so that a class with most of the
documents is a row for each task.

Defined cases: a null text has no terms; a document without terms counts in
nothing; an item without terms has no results; equal rows of items are one item,
and items with one id but several texts are ranked each by itself under that id;
a null id is an id, and a document's null id comes last among equal scores;
repeated documents are ranked each by itself; empty tables give no rows; a text
of any length is searched whole; other columns are not looked at, whatever their
names.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import Scratch
from lodestone.llm.terms import cut
from lodestone.llm.textbytes import ALNUM_SPLIT, slices, utf8

TOP = 10
#: Bytes of items that are searched together.
BLOCK_BYTES = 8 << 20
#: Bytes of text restricted together; scores, and sums that go into them, held at a time.
SLICE, SCORES, SUMS = 4 << 20, 1 << 21, 1 << 22


class Items(NamedTuple):
    """A block of items: their terms, and for each term the items that hold it, with how often."""

    terms: pa.BinaryArray
    first: np.ndarray
    item: np.ndarray
    times: np.ndarray
    number: int

    @classmethod
    def of(cls, texts: list[str]) -> Items:
        words, _, item = cut(*utf8(pa.array(texts, pa.string())), ALNUM_SPLIT)
        encoded = words.dictionary_encode()
        key, times = np.unique(encoded.indices.to_numpy().astype(np.int64) * max(len(texts), 1) + item, return_counts=True)
        term, item = key // max(len(texts), 1), key % max(len(texts), 1)
        return cls(encoded.dictionary, np.searchsorted(term, np.arange(len(encoded.dictionary) + 1)), item, times, len(texts))


def _restrict(items, key: str, text: str):
    """For each document its number of terms, and those that items hold, by number, with their frequencies."""

    def run(batches):
        terms = items.value.terms
        size = max(len(terms), 1)
        for rows, data, offsets in slices(batches, text, SLICE):
            words, _, doc = cut(data, offsets, ALNUM_SPLIT)
            found = pc.index_in(words, terms)
            on = found.is_valid().to_numpy(zero_copy_only=False)
            held, times = np.unique(doc[on] * size + found.drop_null().to_numpy(), return_counts=True)
            at = pa.array(np.searchsorted(held, np.arange(rows.num_rows + 1) * size).astype(np.int32))
            vectors = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (held % size, times)]
            yield pa.RecordBatch.from_arrays([rows.column(key), pa.array(np.bincount(doc, minlength=rows.num_rows), pa.int64()), *vectors], ["doc_id", "n", "terms", "tfs"])

    return run


def _best(items, weights, top: int):
    """The best classes of each item in a task: ``item, score, class, least``."""

    def scores(term, tf, row, m, number) -> np.ndarray:
        own, weight = items.value, weights.value
        each = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
        out = np.zeros(len(m) * number, np.int64)
        count = own.first[term + 1] - own.first[term]
        ends = np.cumsum(count)
        begin = 0
        while begin < len(term):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SUMS, "right")))
            part = slice(begin, end)
            entry = np.repeat(np.arange(begin, end), count[part])
            place = np.arange(len(entry)) - np.repeat(ends[part] - count[part] - (ends[begin - 1] if begin else 0), count[part]) + own.first[term[entry]]
            np.add.at(out, row[entry] * number + own.item[place], each[entry] * own.times[place])
            begin = end
        return out.reshape(len(m), number)

    def run(batches):
        number = items.value.number
        rows_at_once = max(1, SCORES // max(number, 1))
        held, least = None, np.ones(number, np.int64)  # a score counts from the least that may still be among the best
        for batch in batches:
            for begin in range(0, batch.num_rows, rows_at_once):
                rows = batch.slice(begin, rows_at_once)
                lists = rows.column("terms")
                size = pc.list_value_length(lists).to_numpy()
                term, tf = (pc.list_flatten(rows.column(c)).to_numpy().astype(np.int64) for c in ("terms", "tfs"))
                got = scores(term, tf, np.repeat(np.arange(rows.num_rows), size), rows.column("m").to_numpy(), number)
                row, item = np.nonzero(got >= least)
                if not len(row):
                    continue
                new = pa.table({"item": pa.array(item, pa.int32()), "score": pa.array(got[row, item], pa.int64()), "class": rows.column("class").take(pa.array(row)), "least": rows.column("least").take(pa.array(row))})
                held = (pa.concat_tables([held, new]) if held else new).sort_by([("item", "ascending"), ("score", "descending"), ("least", "ascending")])
                item = held.column("item").to_numpy()
                rank = np.arange(len(item)) - np.searchsorted(item, item)
                full = np.flatnonzero(rank == top - 1)
                least[item[full]] = held.column("score").to_numpy()[full]
                held = held.filter(pa.array(rank < top)).combine_chunks()
        if held:
            yield from held.to_batches()

    return run


def search(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item with a score above 0."""
    wanted = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).filter("text IS NOT NULL").distinct()
    blocks = max(1, -(-wanted.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0] // block_bytes))
    parts = [_block(docs, wanted if blocks == 1 else wanted.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k), top, key, text) for k in range(blocks)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _block(docs: DataFrame, wanted: DataFrame, top: int, key: str, text: str) -> DataFrame:
    """The search for the items of one block."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "search")
    rows = sorted(wanted.collect(), key=repr)
    items = Items.of([r.text for r in rows])
    names = spark.createDataFrame([(k, r.item_id) for k, r in enumerate(rows)], f"item int, item_id {wanted.schema['item_id'].dataType.simpleString()}")
    shared = spark.sparkContext.broadcast(items)
    id_type = docs.schema[key].dataType.simpleString()
    bags = scratch.write(docs.select(key, text).mapInArrow(_restrict(shared, key, text), f"doc_id {id_type}, n long, terms array<int>, tfs array<int>"), "bags")
    n_docs, n_terms = bags.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = F.expr(f"25 + CAST(CAST(75 * n AS DECIMAL(18,0)) * {n_docs} DIV {max(n_terms, 1)} AS BIGINT)")
    bag = ["hash", "m", "terms", "tfs"]
    marked = bags.filter(F.size("terms") > 0).withColumn("m", m).withColumn("hash", F.xxhash64("m", "terms", "tfs")).select("doc_id", *bag)
    grouped = marked.groupBy(*bag).agg(F.min("doc_id").alias("least"), F.count("*").alias("docs"))
    classes = scratch.write(grouped.withColumn("class", F.monotonically_increasing_id()), "classes")
    weights = np.zeros(max(len(items.terms), 1), np.int64)
    for term, df in classes.select(F.explode("terms").alias("t"), "docs").groupBy("t").agg(F.sum("docs")).collect():
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    scored = classes.select("terms", "tfs", "m", "class", "least").mapInArrow(_best(shared, spark.sparkContext.broadcast(weights), top), f"item int, score long, class long, least {id_type}")
    chosen = scored.withColumn("rank", F.expr("row_number() OVER (PARTITION BY item ORDER BY score DESC, least NULLS LAST)")).filter(F.col("rank") <= top).select("item", "score", "class")
    chosen = scratch.write(chosen, "chosen")
    vectors = scratch.write(classes.join(chosen.select("class").distinct().hint("merge"), "class").select("class", *bag), "vectors")
    # As many hashes as chosen classes: ``top`` for each item of the block at most.
    near = marked.join(F.broadcast(vectors.select("hash").distinct()), "hash", "left_semi")
    members = near.withColumn("place", F.expr("row_number() OVER (PARTITION BY hash, m, terms, tfs ORDER BY doc_id NULLS LAST)")).filter(F.col("place") <= top)
    own = members.join(vectors.hint("merge"), bag).select("class", "doc_id")
    found = chosen.join(own.hint("merge"), "class").withColumn("rank", F.expr("row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)")).filter(F.col("rank") <= top)
    return found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
