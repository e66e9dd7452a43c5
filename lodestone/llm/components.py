"""Connected components of links, by union-find in tasks and star steps between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import Scratch

#: Links that a task unites at a time.
BLOCK_LINKS = 200_000


def unite(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over the links of a block: each node that isn't the smallest of its set, and that one."""
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(at[: len(left)].tolist(), at[len(left) :].tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    roots = np.fromiter((find(x) for x in range(len(nodes))), np.int64, len(nodes))
    moved = roots != np.arange(len(nodes))
    return nodes[moved], nodes[roots[moved]]


def _contract(batches):
    held, n = [], 0

    def flush():
        both = pa.Table.from_batches(held)
        a, b = unite(both.column(0).to_numpy(), both.column(1).to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["node", "root"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= BLOCK_LINKS:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root`` for every node of the two columns of ``links`` but the roots themselves.

    A root is the smallest node reachable. Tasks first shrink their own links
    to forests. Then star steps repeat until nothing changes: a large step
    moves the greater neighbours of each node to its smallest neighbour, a small
    step the others. Minima are taken with partial aggregation, so a node with
    very many links is one row per task; the joins back to the links can be
    split by Spark where a node is hot.
    """
    a, b = links.columns[:2]
    links = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b")
    tree = scratch.write(links.mapInArrow(_contract, "node long, root long").distinct(), "forest")
    mark = None
    while True:
        both = tree.unionByName(tree.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("least")).select(F.col("node").alias("root"), F.least("least", "node").alias("least"))
        large = tree.join(least.hint("merge"), "root").select("node", F.col("least").alias("root")).distinct()
        low = large.groupBy("node").agg(F.min("root").alias("least"))
        small = large.join(low.hint("merge"), "node").select(F.when(F.col("root") == F.col("least"), F.col("node")).otherwise(F.col("root")).alias("node"), F.col("least").alias("root"))
        new = scratch.write(small.filter("node <> root").distinct(), "stars")
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("node", "root") % (1 << 40))).first())
        scratch.drop(tree)
        tree = new
        if now == mark:
            return tree
        mark = now
