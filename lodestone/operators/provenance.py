"""Where records come from, over any number of hops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.scratch import Scratch


def origins(records: DataFrame, key: str, source: str) -> DataFrame:
    """``key, state, origin, hops`` for each distinct key: the record that it comes from in the end, and in how many steps.

    ``rooted``: the origin names no source. ``broken``: the origin names a source
    that doesn't exist. ``cycle``: the sources lead into a circle; the origin is
    the smallest key on it, and hops are null. A record is its own origin after 0
    hops. Of a key's several sources the smallest counts, and a row without one
    counts least; rows with a null key are left out, since nothing can name them.

    Pointer doubling: in each round a record's pointer takes over the pointer of
    the record that it points at, so rounds grow as the logarithm of the longest
    chain. Records that have arrived leave the loop. Pointers that haven't after
    as many hops as there are records are on a circle or lead to one; on a
    circle, the smallest key met grows along with the pointers.
    """
    scratch = Scratch(records.sparkSession, "provenance")
    one = records.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(source).alias("source"))
    one = scratch.write(one, "records")
    known = one.select(F.col("id").alias("source"), F.lit(True).alias("known"))
    first = one.join(known.hint("merge"), "source", "left")
    # ``at`` is null where a record has arrived: it is its own origin, and state says which kind.
    state = F.when(F.col("source").isNull(), "rooted").when(F.col("known").isNull(), "broken")
    moving = first.select("id", F.when(F.col("known"), F.col("source")).alias("at"), F.when(state.isNotNull(), F.col("id")).alias("origin"), state.alias("state"), F.when(state.isNotNull(), 0).otherwise(1).cast("long").alias("hops"), F.least("id", F.when(F.col("known"), F.col("source"))).alias("least"))
    now = scratch.write(moving, "round")
    total = one.count()
    done, longest = [], 1
    while True:
        left = now.filter("state IS NULL")
        if not left.head(1):
            done.append(now)
            break
        if longest > total:
            done.append(now.filter("state IS NOT NULL"))
            # Each pointer has gone round at least once: its target lies on the circle, whose smallest key the target's walk has met.
            least = now.select(F.col("id").alias("at"), F.col("least").alias("lowest"))
            done.append(left.join(least.hint("merge"), "at").select("id", F.lit(None).cast(left.schema["at"].dataType).alias("at"), F.col("lowest").alias("origin"), F.lit("cycle").alias("state"), F.lit(None).cast("long").alias("hops"), "least"))
            break
        # Records that many point at are split by adaptive execution.
        ahead = now.select(F.col("id").alias("at"), F.col("at").alias("at2"), F.col("origin").alias("origin2"), F.col("state").alias("state2"), F.col("hops").alias("hops2"), F.col("least").alias("least2"))
        moved = left.join(ahead.hint("merge"), "at").select("id", F.col("at2").alias("at"), F.col("origin2").alias("origin"), F.col("state2").alias("state"), (F.col("hops") + F.col("hops2")).alias("hops"), F.least("least", "least2").alias("least"))
        now = scratch.write(moved.unionByName(now.filter("state IS NOT NULL")), "round")
        longest *= 2
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(F.col("id").alias(key), "state", "origin", "hops")


def origin_summary(traced: DataFrame) -> DataFrame:
    """``state, n, deepest``: how many records end in each way, and the longest chain."""
    return traced.groupBy("state").agg(F.count("*").alias("n"), F.max("hops").alias("deepest"))
