"""Path classes by a rule table of any size, by an index of what the rules' patterns require.

A rule is a row ``priority, class, pattern``; the rule with the least priority
that is found in a path decides. Most patterns hold a run of plain characters
without which they can't be found. The first characters of it are the rule's
key; every path is cut into its substrings of the keys' lengths and meets, by an
equi-join, only the rules whose key it holds. These are tried in full. Rules
without such a run meet every path. The plan is the same for ten rules and for
a million.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.literals import required
from lodestone.operators.ignore import BROADCAST_BYTES
from lodestone.sources.scratch import Scratch

#: Characters of a key, at least and at most.
SHORTEST, LONGEST = 3, 8


def keyed(rules: DataFrame) -> DataFrame:
    """The rules with ``key`` and ``literal``; both are empty where a rule requires too little. Rows with a null pattern or priority are left out."""

    def run(batches):
        for batch in batches:
            found = [(x if x and len(x) >= SHORTEST else "") for x in map(required, batch["pattern"])]
            yield pd.DataFrame({"priority": batch["priority"], "class": batch["class"], "pattern": batch["pattern"], "literal": found, "key": [x[:LONGEST] for x in found]})

    narrow = rules.filter("pattern IS NOT NULL AND priority IS NOT NULL").select(F.col("priority").cast("long").alias("priority"), F.col("class").cast("string").alias("class"), "pattern")
    return narrow.mapInPandas(run, "priority long, class string, pattern string, literal string, key string")


def classify(items: DataFrame, rules: DataFrame, path: str = "path", other: str = "kept") -> DataFrame:
    """``path, n, class``: each distinct path, how many rows have it, and the class of its first rule, or ``other``.

    Of rules with equal priority the class that sorts first counts. A null path
    fits no rule. Rules are broadcast up to a checked size and shuffled with the
    substrings beyond it; rules without a key are always broadcast in that case
    if they fit, as every path needs them.
    """
    index = Scratch(items.sparkSession, "rule-index").write(keyed(rules), "keyed")
    size, lengths = index.agg(F.coalesce(F.sum(F.octet_length("pattern") + F.octet_length("literal") + 64), F.lit(0)), F.sort_array(F.collect_set(F.length("key")))).first()
    join = "broadcast" if size <= BROADCAST_BYTES else "merge"
    paths = items.groupBy(F.col(path).alias("path")).agg(F.count("*").alias("n"))
    parts = [F.expr(f"transform(sequence(1, greatest(length(path) - {k - 1}, 1)), i -> substring(path, i, {k}))") for k in lengths if k]
    substrings = F.array_distinct(F.flatten(F.array(F.array(F.lit("")), *parts)))
    probes = paths.filter("path IS NOT NULL").select("path", F.explode(substrings).alias("key"))
    met = probes.join(index.hint(join), "key").filter(F.col("path").contains(F.col("literal"))).filter(F.regexp_like("path", F.col("pattern")))
    first = met.groupBy("path").agg(F.min(F.struct("priority", "class")).alias("first"))
    return paths.join(first.hint("merge"), "path", "left").select("path", "n", F.when(F.col("first").isNull(), F.lit(other)).otherwise(F.col("first.class")).alias("class"))


def class_counts(items: DataFrame, rules: DataFrame, path: str = "path", other: str = "kept") -> DataFrame:
    """``class, n``: rows of each class."""
    return classify(items, rules, path, other).groupBy("class").agg(F.sum("n").alias("n"))
