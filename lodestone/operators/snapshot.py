"""A snapshot brought up to date from a log of changes that were not merged into it yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _ordered(kind: T.DataType) -> bool:
    """Whether values of the type have an order: those that hold a map have none."""
    if isinstance(kind, T.StructType):
        return all(_ordered(f.dataType) for f in kind)
    return _ordered(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def merge_log(snapshot: DataFrame, log: DataFrame, key: list[str], order: list[str], deletes: Column, commits: Column | None = None, since: Column | None = None) -> DataFrame:
    """``key``, the snapshot's other columns, and ``change``: ``unchanged``, ``updated`` or ``inserted``; deleted keys are left out.

    The log has the snapshot's columns and those of ``order``, by which changes
    follow each other; of a key's changes the last one counts. ``deletes`` marks
    changes that delete. What comes after the last change that ``commits`` marks
    is no part of the log yet; rows that ``since`` doesn't mark are older than
    the snapshot and already in it.

    One grouping by key does it: a key's changes merge before the shuffle, so a
    key with very many is a row for each task. Equal changes (by ``order``) count
    as one if they are the same; of different ones with equal order, deletions
    come first and the greatest columns win (those that have an order). A null key is a key like others; of
    several snapshot rows with one key the greatest stays.
    """
    values = [c for c in snapshot.columns if c not in key]
    place = F.struct(*[F.col(c) for c in order])
    rows = log.filter(since) if since is not None else log
    if commits is not None:
        rows = rows.filter(place <= log.filter(commits).agg(F.max(place)).scalar())
    row = lambda: F.struct(*[F.col(c) for c in values])
    changes = rows.select(*key, place.alias("place"), (~F.coalesce(deletes, F.lit(False))).alias("stays"), row().alias("row"), F.lit(False).alias("old"))
    empty = F.lit(None).cast(changes.schema["place"].dataType)
    base = snapshot.select(*key, empty.alias("place"), F.lit(True).alias("stays"), row().alias("row"), F.lit(True).alias("old"))
    # A null place comes before all others.
    by = F.struct("place", "stays", *[F.col("row")[c] for c in values if _ordered(snapshot.schema[c].dataType)])
    both = base.unionByName(changes).groupBy(*key).agg(F.max_by(F.struct("place", "stays", "row"), by).alias("top"), F.max("old").alias("had"))
    change = F.when(F.col("top.place").isNull(), "unchanged").when(F.col("had"), "updated").otherwise("inserted")
    return both.filter("top.stays").select(*key, *[F.col("top.row")[c].alias(c) for c in values], change.alias("change"))


def merge_summary(snapshot: DataFrame, merged: DataFrame, key: list[str]) -> DataFrame:
    """``change, n`` of a merge, deleted keys of the snapshot included."""
    counts = merged.groupBy("change").agg(F.count("*").alias("n"))
    marked = snapshot.select(*key, F.lit(1).alias("_s"), F.lit(0).alias("_m")).unionByName(merged.select(*key, F.lit(0).alias("_s"), F.lit(1).alias("_m")))
    gone = marked.groupBy(*key).agg(F.max("_s").alias("_s"), F.max("_m").alias("_m")).filter("_s = 1 AND _m = 0").agg(F.count("*").alias("n")).filter("n > 0")
    return counts.unionByName(gone.select(F.lit("deleted").alias("change"), "n"))
