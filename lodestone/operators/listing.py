"""Audit of a listing of items: sizes, classes and required content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.patterns import first_class, spare

# What a hand-over leaves out, in order; the first match decides.
# Main database files match none of them and are kept.
EXCLUDED = [
    ("ide_settings", r"(^|/)(\.idea|\.vscode|\.claude|\.cursor)/"),
    ("credential", r"(^|/)(\.env|credentials|[^/]*\.pem|[^/]*\.key)$"),
    ("venv_cache", r"(^|/)(\.?venv|__pycache__|\.pytest_cache)/"),
    ("node_modules", r"(^|/)node_modules/"),
    ("build_output", r"(^|/)(\.aws-sam|build|dist)/"),
    ("coverage", r"(^|/)(htmlcov/|\.coverage$|coverage\.xml$)"),
    ("db_sidecar", r"\.(sqlite3?|db)-(wal|shm|journal)$"),
]


def size_census(items: DataFrame, group: str, key: str, size: Column) -> DataFrame:
    """``group, bytes, max_bytes, largest_id`` per group; of equal sizes the smaller id wins.

    Partial sums and one struct per group and task are shuffled. A null size
    counts as 0.
    """
    id_, bytes_ = spare("_key", [group]), spare("_size", [group])
    sized = items.select(F.col(group), F.col(key).alias(id_), F.coalesce(size.cast("long"), F.lit(0)).alias(bytes_))
    return sized.groupBy(group).agg(
        F.sum(bytes_).alias("bytes"), F.max(bytes_).alias("max_bytes"), F.max_by(id_, F.struct(bytes_, -F.col(id_))).alias("largest_id")
    )


def oversize_untracked(items: DataFrame, tracked: DataFrame, key: str, size: Column, limit: int) -> DataFrame:
    """``key, bytes`` of the items above ``limit`` that are not in ``tracked``.

    The limit is applied in the scan, so only large items reach the join.
    """
    large = items.select(key, size.cast("long").alias("bytes")).filter(F.col("bytes") > limit)
    return large.join(tracked.select(key), key, "left_anti")


def path_class(items: DataFrame, rules: list[tuple[str, str]] = EXCLUDED, path: str = "path", other: str = "kept") -> DataFrame:
    """``class, n``: each path has the class of the first rule that it matches."""
    return items.groupBy(first_class(F.col(path), rules, other).alias("class")).agg(F.count("*").alias("n"))


def tracked_but_excluded(tracked: DataFrame, rules: list[tuple[str, str]] = EXCLUDED, path: str = "path") -> DataFrame:
    """``path, class`` of tracked items that an exclusion rule would drop. No shuffle."""
    classed = tracked.select(path, first_class(F.col(path), rules, "kept").alias("class"))
    return classed.filter(F.col("class") != "kept")


def required_coverage(required: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """``key, n``: how many items each required class has, 0 where it has none.

    Items are counted before the join, so a class with most of the rows is one
    row there, and the join's sides have a row per class.
    """
    counts = items.groupBy(key).agg(F.count("*").alias("n"))
    return required.select(key).distinct().join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))
