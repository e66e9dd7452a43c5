"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks.

Every source's documents are shuffled into a stream of words (by a hash of their
ids) which is cut into blocks of equal numbers of words; a source whose target
exceeds its size runs through its stream again. The mix is a sequence of slots.
Slot t stands at the golden-ratio point ``t * g mod slots`` (g next to slots /
1.618..., without a common factor, so that each point occurs once); the source
whose interval of cumulative quotas holds the point has the slot. Slots are
ranked within their source by t, and slot number k of a source takes block k of
its stream. So any stretch of the mix holds the sources near their shares, and
the whole mix holds exactly the targets' whole words: the last block of a source
ends at its target.

Targets: sources in the order of their names (code points, null last) have the
weights in turn, and share ``percent`` of all words. A source gets no more than
``repeats`` times its words; what is above goes to the others by weight. The
sources are sorted by the factor at which they are full, so one running sum
tells how many are.

Nothing but DataFrame functions. Running sums are taken in two steps, within
buckets of bounded size and over the buckets' sums, so that a source with most
of the rows is dealt over many tasks. Pieces and slots meet by source and block
number, of which none is hot.

Defined cases: a null or wordless text has size 0 and is never taken; a null
source is a source, last in order; rows with one id are placed by id and size
and each taken by itself; an empty table gives no rows; a source without words
has target 0; other columns are not looked at, whatever their names. Reruns
agree, however the rows are partitioned.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import Scratch

WEIGHTS, PERCENT, REPEATS = (3, 1, 2), 150, 2
#: Words in a block; larger if the mix would have more slots than ``SLOTS`` otherwise.
BLOCK, SLOTS = 1024, 1 << 30
#: Rows in a bucket, about, and slots that a row of a source stands for before they are unfolded.
BUCKET, CHUNK = 50_000, 4096
#: Enters the shuffle's hash.
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"


def _running(frame: DataFrame, group: str, order: list[Column], amount: Column, name: str, more: DataFrame | None = None) -> DataFrame:
    """``frame``, which has a ``bucket``, with the sum of ``amount`` over the rows of its group in earlier buckets, or earlier by ``order`` in its own.

    ``more``: further columns by group, joined to the buckets' sums.
    """
    sums = frame.groupBy(group, "bucket").agg(F.sum(amount).alias("own"))
    ahead = sums.select(group, "bucket", F.expr(f"coalesce(sum(own) OVER (PARTITION BY {group} ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)").alias("ahead"))
    if more is not None:
        ahead = ahead.join(more.hint("merge"), group)
    joined = frame.join(ahead.hint("merge"), [group, "bucket"])
    within = Window.partitionBy(group, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(name, F.col("ahead") + F.coalesce(F.sum(amount).over(within), F.lit(0))).drop("ahead", "bucket")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, repeats: int = REPEATS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row per source.

    With ``f`` the share of a unit of weight, a source's target is the smaller of
    ``f * weight`` and ``repeats * source_size``. Comparisons are exact.
    """
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    rows = sizes.withColumn("no", F.expr("row_number() OVER (ORDER BY source NULLS LAST)")).withColumn("weight", F.element_at(cycle, (F.col("no") - 1) % len(weights) + 1))
    rows = rows.withColumn("most", F.col("source_size") * repeats)
    # In the order in which sources become full as f grows: what the full ones before hold, and the weight of the rest.
    by = "OVER (ORDER BY source_size / weight, no ROWS BETWEEN"
    rows = rows.withColumn("left", F.expr(f"{percent} * sum(source_size) OVER () - 100 * coalesce(sum(most) {by} UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))
    rows = rows.withColumn("rest", F.expr(f"sum(weight) {by} CURRENT ROW AND UNBOUNDED FOLLOWING)"))
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    rows = rows.withColumn("full", wide("left") * F.col("weight") >= wide("most") * (F.col("rest") * 100).cast("decimal(18,0)"))
    rows = rows.withColumn("f", F.expr(f"first_value(CASE WHEN NOT full THEN struct(left, rest) END, true) {by} UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"))
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise((F.col("f.left") * F.col("weight")).cast("double") / (F.col("f.rest") * 100).cast("double"))
    return rows.select("no", "source", "source_size", target.alias("target"))


class Mix:
    """The documents, the sources and the schedule of one mix, as tables of ``scratch``."""

    def __init__(self, docs: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, repeats: int = REPEATS, block: int = BLOCK, slots: int = SLOTS, seed: str = SEED, key: str = "doc_id", text: str = "text", source: str = "source"):
        self.repeats = repeats
        mark = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("long")
        size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
        named = docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"), mark.alias("mark"))
        # A null source has a name of its own among the groups.
        sized = scratch.write(named.withColumn("stream", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), "sizes")
        totals = sized.groupBy("stream", "source").agg(F.sum("size").alias("source_size"))
        judged = scratch.write(targets(totals.select("source", "source_size"), weights, percent, repeats), "targets")
        words = F.floor("target")
        mixed, rows = judged.agg(F.coalesce(F.sum(words), F.lit(0))).first()[0], sized.count()
        self.block = max(block, -(-mixed // slots))
        quota = F.expr(f"CAST(ceil(floor(target) / {self.block}) AS BIGINT)")
        self.sources = scratch.write(
            judged.select("no", "source", "source_size", "target", words.alias("words"), quota.alias("quota")).withColumn("low", F.expr("coalesce(sum(quota) OVER (ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)")), "sources"
        )
        self.slots = self.sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
        figures = self.sources.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("stream"), "no", "source_size", "target", "words")
        wide = -(-(1 << 60) // max(1, -(-rows // BUCKET)))
        placed = _running(sized.withColumn("bucket", F.expr(f"mark DIV {wide}L")), "stream", [F.col("mark"), F.col("doc_id"), F.col("size")], F.col("size"), "start", figures)
        #: ``doc_id, source, size, no, source_size, target, words, start``, and ``place``, which with ``no`` tells the rows with words apart.
        self.docs = scratch.write(placed.withColumn("place", F.when(F.col("size") > 0, F.col("start")).otherwise(-1 - F.col("mark"))).drop("stream", "mark"), "placed")

    def schedule(self) -> DataFrame:
        """``slot, no, block``: which source's block a slot of the mix takes."""
        n = max(1, self.slots)
        step = round(n / ((1 + 5**0.5) / 2)) or 1
        while gcd(step, n) > 1:
            step += 1
        back = pow(step, -1, n)
        chunks = self.sources.filter("quota > 0").select("no", "low", "quota", F.explode(F.expr(f"sequence(0L, (quota - 1) DIV {CHUNK})")).alias("chunk")).repartition("no", "chunk")
        points = chunks.select("no", F.explode(F.expr(f"sequence(low + chunk * {CHUNK}, low + least(quota, (chunk + 1) * {CHUNK}) - 1)")).alias("point"))
        slots = points.select("no", F.expr(f"point * {back}L % {n}L").alias("slot"))
        return _running(slots.withColumn("bucket", F.expr(f"slot DIV {BUCKET}")), "no", [F.col("slot")], F.lit(1).cast("long"), "block")

    def pieces(self) -> DataFrame:
        """``no, block, place, doc_id, first, n``: the words ``first`` to ``first + n`` of a document that lie in a block of its source's stream."""
        turns = self.docs.filter("size > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(self.repeats - 1))))
        ends = turns.withColumn("begin", F.col("start") + F.col("turn") * F.col("source_size")).withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("words"))).filter("begin < end")
        cut = ends.withColumn("block", F.explode(F.expr(f"sequence(begin DIV {self.block}, (end - 1) DIV {self.block})")))
        low, high = F.greatest(F.col("begin"), F.col("block") * self.block), F.least(F.col("end"), (F.col("block") + 1) * self.block)
        return cut.select("no", "block", "place", "doc_id", (low - F.col("begin")).alias("first"), (high - low).alias("n"))

    def rows(self) -> DataFrame:
        """``slot, no, block, place, doc_id, first, n``: the mix; order by slot, and within one by place."""
        return self.schedule().join(self.pieces().hint("merge"), ["no", "block"])

    def taken(self) -> DataFrame:
        """``doc_id, size, source_size, target, taken``: the words that the mix takes of each document, repeats counted."""
        sums = self.rows().groupBy("no", "place").agg(F.sum("n").alias("taken"))
        return self.docs.join(sums.hint("merge"), ["no", "place"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mix(docs: DataFrame, **options) -> Mix:
    """The mix of all documents; see ``Mix`` for the options."""
    return Mix(docs, Scratch(docs.sparkSession, "mixture"), **options)
