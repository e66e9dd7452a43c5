"""Tracing of records to sources, and comparison of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import patterns as P


def trace_orphans(records: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """``key`` of the records whose source does not exist. A null key is an orphan."""
    return records.select(key).join(sources.select(key), key, "left_anti")


def trace_coverage(records: DataFrame, sources: DataFrame, key: str, group: str) -> DataFrame:
    """``group, n, traced``: sources per group, and how many of them have a record."""
    mark = P.spare("_have", [key, group])
    have = records.select(key).distinct().withColumn(mark, F.lit(1))
    joined = sources.select(key, group).join(have, key, "left")
    return joined.groupBy(group).agg(F.count("*").alias("n"), F.count(mark).alias("traced"))


def snapshot_reconcile(source: DataFrame, snapshot: DataFrame, source_key: str, snapshot_key: str) -> DataFrame:
    """``status, n``: distinct keys in both, missing in the snapshot, or unexpected in it.

    A grouping of the two key columns stands in for a full outer join: repeated
    keys merge before the shuffle, so no key is hot, and null keys count as one.
    """
    keys = source.select(F.col(source_key).alias("k"), F.lit(1).alias("s"), F.lit(0).alias("t")).unionByName(
        snapshot.select(F.col(snapshot_key).alias("k"), F.lit(0).alias("s"), F.lit(1).alias("t"))
    )
    per_key = keys.groupBy("k").agg(F.max("s").alias("s"), F.max("t").alias("t"))
    status = F.when(F.col("s") + F.col("t") == 2, "both").when(F.col("s") == 1, "missing_in_snapshot").otherwise("unexpected")
    return per_key.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def golden_diff(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows whose number differs, with ``side`` (of the table with more of them) and ``copies``.

    A multiset comparison by one grouping: equal rows merge before the shuffle.
    Columns are matched by name; nulls equal nulls.
    """
    columns = expected.columns
    d = P.spare("_d", columns)
    both = actual.select(*columns, F.lit(1).alias(d)).unionByName(expected.select(*columns, F.lit(-1).alias(d)))
    sums = both.groupBy(*columns).agg(F.sum(d).alias(d)).filter(F.col(d) != 0)
    return sums.select(*columns, F.when(F.col(d) > 0, "actual").otherwise("expected").alias("side"), F.abs(d).alias("copies"))
