"""Directories of a listing: sizes at all depths, and the licence that is nearest to each path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.scratch import Scratch

#: Names of licence files, without what follows a dot; in lower case.
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([.-][^/]*)?$"


def parent(path: Column) -> Column:
    """The directory that holds a path; of what lies at the root, the empty one. Slashes at the ends don't count."""
    return F.regexp_replace(F.regexp_replace(path, "^/+|/+$", ""), "/*[^/]*$", "")


def directory_sizes(items: DataFrame, size: Column, path: str = "path", without: tuple[str, ...] = ()) -> DataFrame:
    """``directory, depth, files, bytes`` of all that lies below each directory, at any depth; ``""`` is the root.

    ``without`` names directories whose subtrees don't count. Files are summed
    by their directory first. Then the deepest level is added to the one above
    it, and so on up: a level shuffles a row for each of its directories and
    task, twice at most, however many files there are. Null sizes count 0; a
    null path is a file at the root; repeated paths are files each.
    """
    scratch = Scratch(items.sparkSession, "tree")
    clean = F.coalesce(F.col(path), F.lit(""))
    rows = items.select(parent(clean).alias("directory"), F.coalesce(size.cast("long"), F.lit(0)).alias("bytes"))
    if without:
        rows = rows.filter(~F.arrays_overlap(F.split("directory", "/+"), F.array(*[F.lit(x) for x in without])))
    sums = rows.groupBy("directory").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    depth = F.when(F.col("directory") == "", 0).otherwise(F.size(F.split("directory", "/+")))
    own = scratch.write(sums.withColumn("depth", depth), "own")
    deepest = own.agg(F.max("depth")).first()[0]
    if deepest is None:
        return own.select("directory", "depth", "files", "bytes")
    columns = ["directory", "depth", "files", "bytes"]
    levels, below = [], None
    for d in range(deepest, -1, -1):
        level = own.filter(F.col("depth") == d).select(columns)
        if below is not None:
            level = level.unionByName(below.select(parent(F.col("directory")).alias("directory"), F.lit(d).alias("depth"), "files", "bytes"))
        level = level.groupBy("directory", "depth").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
        below = scratch.write(level.select(columns), f"level-{d}")
        levels.append(below)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def nearest_licence(items: DataFrame, path: str = "path", names: str = LICENCE_FILE) -> DataFrame:
    """``path, licence`` for each row: the licence file of the deepest directory at or above the path's own that has one, or null.

    Of several in one directory the one that sorts first counts; a licence file
    is under itself or its neighbour that sorts first. The search is made once
    for each distinct directory. A null path has none.
    """
    listed = items.select(F.col(path).alias("path"), parent(F.col(path)).alias("directory"))
    name = F.regexp_extract("path", "[^/]*$", 0)
    held = listed.filter(name.rlike(names)).groupBy("directory").agg(F.min("path").alias("licence"))
    own = listed.select("directory").distinct().filter("directory IS NOT NULL").withColumn("c", F.filter(F.split("directory", "/+"), lambda x: x != ""))
    above = own.select(F.col("directory").alias("own"), F.explode(F.sequence(F.lit(0), F.size("c"))).alias("depth"), "c").withColumn("directory", F.array_join(F.slice("c", F.lit(1), F.col("depth")), "/"))
    found = above.join(held.hint("merge"), "directory").groupBy("own").agg(F.max_by("licence", "depth").alias("licence"))
    # Directories with very many files are split by adaptive execution.
    return listed.join(found.withColumnRenamed("own", "directory").hint("merge"), "directory", "left").select("path", "licence")
