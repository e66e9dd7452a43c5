"""Ignore and attribute files, each in force below its directory.

Rules become a table with one row per line: the directory of the file, the
line's number, the expression that its pattern stands for, and a key that a path
must bring to fit it (its last component, its extension, or nothing). Every path
is unfolded into the directories above it and itself, and each of these into the
directories whose rules may concern it; an equi-join by directory and key brings
it together with those rules alone that can fit. The last match of the deepest
directory decides, by one ``max_by``.

Rules are broadcast up to ``BROADCAST_BYTES``, and shuffled with the paths
beyond; there a directory above most paths is a hot key, which adaptive
execution splits on the paths' side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import globs

#: Bytes of rules that are broadcast.
BROADCAST_BYTES = 32 << 20
RULES = "directory string, line int, pattern string, negated boolean, value string, regex string, key string, sure boolean, directories boolean"


def _table(files: DataFrame, rows: Callable[[str | None], Iterator[tuple]]) -> DataFrame:
    """Rules of files ``path, text``, whose directory is that of the path. A null path is that of a file at the root."""
    names = [c.split()[0] for c in RULES.split(", ")]

    def run(batches):
        for batch in batches:
            out = [(directory or "", *rule) for directory, text in zip(batch["directory"], batch["text"], strict=True) for rule in rows(text)]
            yield pd.DataFrame(out, columns=names)

    directory = F.array_join(_components(F.regexp_replace(F.coalesce(F.col("path"), F.lit("")), "[^/]*$", "")), "/")
    return files.select(directory.alias("directory"), F.col("text").cast("string").alias("text")).mapInPandas(run, RULES)


def ignore_rules(files: DataFrame) -> DataFrame:
    """The rules of ignore files, given as ``path, text``. A null text has none; a pattern that fits nothing is left out."""

    def rows(text):
        for line, negated, pattern in globs.lines(text):
            if glob := globs.translate(pattern):
                yield line, pattern, negated, None, glob.regex, glob.key, glob.sure, glob.directories

    return _table(files, rows)


def attribute_rules(files: DataFrame, attribute: str) -> DataFrame:
    """The rules of attribute files about one attribute, with its value. Patterns for directories fit nothing there."""

    def rows(text):
        for line, pattern, given in globs.attribute_lines(text):
            if attribute in given and (glob := globs.translate(pattern)) and not glob.directories:
                yield line, pattern, False, given[attribute], glob.regex, glob.key, glob.sure, False

    return _table(files, rows)


def _components(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def _matches(items: DataFrame, rules: DataFrame, path: str, itself: bool) -> DataFrame:
    """``path, level, levels, depth`` and the rule, for each rule that fits a path (``level`` = ``levels``) or, unless ``itself``, a directory above it.

    ``depth`` is that of the rule's directory. A path that ends in a slash is a directory.
    """
    size = rules.agg(F.coalesce(F.sum(F.octet_length("regex") + F.octet_length("directory") + 64), F.lit(0))).first()[0]
    join = "broadcast" if size <= BROADCAST_BYTES else "merge"
    paths = items.select(F.col(path).alias("path")).distinct().select("path", _components(F.col("path")).alias("c"), F.col("path").endswith("/").alias("folder"))
    paths = paths.withColumn("levels", F.size("c")).filter("levels > 0")
    levels = paths.withColumn("level", F.col("levels") if itself else F.explode(F.sequence(F.lit(1), "levels")))
    probes = levels.withColumn("depth", F.explode(F.expr("sequence(0, level - 1)"))).withColumn("directory", F.array_join(F.slice("c", F.lit(1), F.col("depth")), "/"))
    if join == "broadcast":  # most directories have no rules
        probes = probes.join(F.broadcast(rules.select("directory").distinct()), "directory", "left_semi")
    name = F.element_at("c", F.col("level"))
    keys = F.array_compact(F.array(F.concat(F.lit("n:"), name), F.when(name.contains("."), F.concat(F.lit("e:"), F.substring_index(name, ".", -1))), F.lit("*")))
    probes = probes.select("path", "c", "level", "levels", "depth", "directory", (F.col("folder") | (F.col("level") < F.col("levels"))).alias("is_directory"), F.explode(keys).alias("key"))
    met = probes.join(rules.hint(join), ["directory", "key"]).filter("is_directory OR NOT directories")
    below = F.array_join(F.slice("c", F.col("depth") + 1, F.col("level") - F.col("depth")), "/")
    return met.filter(F.when(F.col("sure"), F.lit(True)).otherwise(F.regexp_like(below, F.col("regex")))).select("path", "level", "levels", "depth", *[c.split()[0] for c in RULES.split(", ")])


def ignored(items: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """``path, ignored, directory, line, pattern`` for each distinct path, with the rule that decides.

    A path is ignored if the last rule that fits it says so, or if a directory
    above it is: nothing below an ignored directory is brought back. Without a
    fitting rule the last three are null. Null and empty paths fit no rule.
    """
    found = _matches(items, rules, path, itself=False)
    rule = F.struct("negated", "directory", "line", "pattern")
    each = found.groupBy("path", "level", "levels").agg(F.max_by(rule, F.struct("depth", "line")).alias("rule"))
    # The first ignored level decides; without one, the rule about the path itself.
    decisive = F.min(F.when(~F.col("rule.negated"), F.struct("level", "rule")))
    own = F.max(F.when(F.col("level") == F.col("levels"), F.struct("level", "rule")))
    verdict = each.groupBy("path").agg(decisive.isNotNull().alias("ignored"), F.coalesce(decisive, own).alias("by"))
    paths = items.select(F.col(path).alias("path")).distinct()
    out = paths.join(verdict, "path", "left")
    return out.select("path", F.coalesce("ignored", F.lit(False)).alias("ignored"), F.col("by.rule.directory").alias("directory"), F.col("by.rule.line").alias("line"), F.col("by.rule.pattern").alias("pattern"))


def attributes(items: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """``path, value`` for each distinct path that a rule gives a value, other than null; the last fitting rule of the deepest directory does."""
    found = _matches(items, rules, path, itself=True)
    last = found.groupBy("path").agg(F.max_by(F.struct("value"), F.struct("depth", "line")).alias("last"))
    return last.select("path", F.col("last.value").alias("value")).filter("value IS NOT NULL")


def oversize_by_pattern(items: DataFrame, rules: DataFrame, size: Column, limit: int, value: str = "lfs", path: str = "path") -> DataFrame:
    """``path, bytes`` of the items above ``limit`` whose path isn't tracked as a large file, that is, whose attribute isn't ``value``.

    Only the large items' paths meet the rules. Repeated paths stay repeated; a null path is tracked by nothing.
    """
    large = items.select(F.col(path).alias("path"), size.cast("long").alias("bytes")).filter(F.col("bytes") > limit)
    tracked = attributes(large, rules).filter(F.col("value") == value).select("path")
    return large.join(tracked, "path", "left_anti")
