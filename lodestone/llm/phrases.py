"""Phrase collocations by stripes: each prefix keys an associative counter of its next words.

The stripe of a prefix holds, for each word that follows it, how often that does.
A task cuts the stripes of a slice of texts, and equal prefixes' stripes are
merged element by element after one shuffle. Level k has the prefixes of k words:
the empty prefix of each language keys its vocabulary, words key pairs, pairs key
triples. The merged stripes give all that the scores need: the counters are the
counts of phrases that are one word longer, the count of a prefix is its own
counter one level up (all words, for the empty one), and the greatest counter of
a stripe is what may subsume its prefix.

Only phrases that occur ``least`` times can be a candidate or a part of one, so
a level looks at prefixes and next words that the level before found frequent. A
bitmap of fixed size over their hashes rules most others out; what it lets
through by chance is counted in full and dropped by its count.

Hot prefixes: the stripe of a prefix with more than a share of all words is
split into parts by the next word's hash, as many as its count asks for; the
list of such prefixes has ``PARTS`` rows at most. A merge reads a sorted
partition as a stream and holds one stripe's part.

Defined cases: a null or empty text has no words; a null language is ``und``,
together with documents that are labelled so; repeated documents count each
time; equal scores are ordered by count and then by the phrase's UTF-8 bytes; an
empty table gives no rows; a text of any length is cut whole; other columns are
not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import Scratch
from lodestone.llm.terms import binary, cut, raw
from lodestone.llm.textbytes import digests, mix, slices

#: Words of the longest phrase; occurrences of a candidate; the share of a phrase's occurrences within a longer one that drops it; phrases of a language that are returned.
LONGEST, LEAST, PERCENT, TOP = 3, 10, 50, 2000
#: A prefix has one part more for each such share of all words that it takes; the vocabulary of a language has so many.
PARTS = 512
#: Bytes of text whose stripes are cut together, and of stripes that are merged together.
SLICE, CHUNK = 4 << 20, 4 << 20
#: Bits of the bitmap over frequent phrases (as a power of two).
BITS = 26
#: Places that a language's candidates are dealt to for its first ranking.
SALTS = 64
UND = "und"

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_ENDS_PIECE = np.isin(np.arange(256), np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
_LOWER = np.array([0 if _ENDS_PIECE[b] or b in b" \t" else (b + 32 if 65 <= b <= 90 else b) + 1 for b in range(256)], np.uint16)

STRIPE = "lang string, prefix string, part int, total long, next binary, counts binary"
MERGED = "lang string, prefix string, total long, top long, next array<string>, n array<long>, states array<long>"


def _after(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase with one word more."""
    return mix(state * _FACTOR + word)


def _names(words: pa.Array) -> np.ndarray:
    return digests(words.cast(pa.binary()).to_pylist())[:, 0].view(np.uint64) if len(words) else np.zeros(0, np.uint64)


def _stripes(k: int, frequent, hot):
    """Cuts the stripes of the prefixes of ``k`` words; ``frequent`` and ``hot`` are broadcast (None at level 0)."""

    def run(batches):
        bitmap = frequent.value if frequent else None
        parts_of = hot.value if hot else {}
        hot_names = pa.array([f"{lang}\t{prefix}" for lang, prefix in parts_of], pa.string())
        hot_parts = np.fromiter(parts_of.values(), np.int64, len(parts_of))
        for rows, data, offsets in slices(batches, "text", SLICE):
            words, start, doc = cut(data, offsets, _LOWER)
            if len(words) <= k:
                continue
            encoded = words.dictionary_encode()
            code, distinct = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary
            size, name = len(distinct), _names(distinct)
            langs = rows.column("lang").dictionary_encode()
            lang, lang_names = langs.indices.to_numpy().astype(np.int64)[doc], _names(langs.dictionary)
            piece = np.cumsum(_ENDS_PIECE[data], dtype=np.int32)[start]
            linked = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
            # The places where a prefix begins, and its hash.
            at = np.arange(len(code) - k + 1 if k else len(code))
            for j in range(k - 1):
                at = at[linked[at + j]]
            state = lang_names[lang[at]]
            for j in range(k):
                state = _after(state, name[code[at + j]])
            if k:
                bit = state >> np.uint64(64 - BITS)
                on = bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1) != 0
                at, state = at[on], state[on]
            if not len(at):
                continue
            # Each distinct prefix: one of its places, and its number of occurrences.
            own = lang[at]
            for j in range(k):
                _, own = np.unique(own * size + code[at + j], return_inverse=True)
            _, place, own, total = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
            total = np.zeros_like(total) if k else total  # of other prefixes the level above has the count
            # A prefix is extended where the phrase from its second to the next word is a prefix itself.
            if k:
                extended = np.zeros(len(code) + 1, bool)
                extended[at] = True
                with_next = extended[at + 1] & np.append(linked, False)[at + k - 1]
            else:
                with_next = np.ones(len(at), bool)
            key, count = np.unique(own[with_next] * size + code[at[with_next] + k], return_counts=True)
            prefix_of, next_of = key // size, key % size
            lang_of = langs.dictionary.take(pa.array(lang[at[place]]))
            prefix = _prefixes(distinct, [code[at[place] + j] for j in range(k)], len(place))
            parts = np.full(len(place), 1 if k else PARTS)
            if len(hot_names):
                found = pc.index_in(pc.binary_join_element_wise(lang_of, prefix, "\t"), hot_names)
                is_hot = found.is_valid().to_numpy(zero_copy_only=False)
                parts[is_hot] = hot_parts[found.drop_null().to_numpy()]
            head = np.cumsum(parts) - parts
            row_of = head[prefix_of] + (name[next_of] % parts[prefix_of].astype(np.uint64)).astype(np.int64)
            order = np.argsort(row_of, kind="stable")
            n_rows = int(parts.sum())
            entries = np.bincount(row_of, minlength=n_rows)
            ends = np.cumsum(entries)
            spaced = pc.binary_join_element_wise(distinct, b"", b" ").take(pa.array(next_of[order]))
            bytes_, at_byte = raw(spaced)
            owner = np.repeat(np.arange(len(place)), parts)
            part = np.arange(n_rows) - head[owner]
            if k:  # prefixes that nothing extends tell nothing
                some = np.flatnonzero(entries)
                owner, part, ends = owner[some], part[some], ends[some]
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [
                    lang_of.take(take),
                    prefix.take(take),
                    pa.array(part, pa.int32()),
                    pa.array(total[owner], pa.int64()),
                    binary(at_byte[ends], bytes_),
                    binary(8 * ends, count[order].astype("<i8").view(np.uint8)),
                ],
                ["lang", "prefix", "part", "total", "next", "counts"],
            )

    return run


def _prefixes(words: pa.Array, codes: list[np.ndarray], n: int) -> pa.Array:
    """Words joined by spaces; without any, empty strings."""
    if not codes:
        return pa.array([""] * n, pa.string())
    columns = [words.take(pa.array(c)) for c in codes]
    return (columns[0] if len(columns) == 1 else pc.binary_join_element_wise(*columns, b" ")).cast(pa.string())


def _states(lang: pa.Array, prefix: pa.Array, k: int) -> np.ndarray:
    """The hashes of prefixes of ``k`` words."""
    langs = lang.dictionary_encode()
    state = _names(langs.dictionary)[langs.indices.to_numpy()]
    words = pc.list_flatten(pc.split_pattern(prefix, " ")).dictionary_encode()
    name = _names(words.dictionary)[words.indices.to_numpy()]
    for j in range(k):
        state = _after(state, name[j::k])
    return state


def _merge_rows(rows: pa.Table, k: int, least: int, last: bool) -> tuple[pa.RecordBatch, pa.Table | None]:
    """Adds up the stripes of sorted rows: the merged stripes with a frequent next word, and the last stripe, which may go on (unless ``last``)."""
    rows = rows.combine_chunks()
    column = {c: rows.column(c).combine_chunks() for c in rows.column_names}
    change = np.zeros(rows.num_rows, bool)
    change[0] = True
    for c in ("lang", "prefix", "part"):
        change[1:] |= pc.not_equal(column[c][1:], column[c][:-1]).to_numpy(zero_copy_only=False)
    heads = np.flatnonzero(change)
    group = np.cumsum(change) - 1
    total = np.add.reduceat(column["total"].to_numpy(), heads)
    data, _ = raw(column["next"])
    counts, at = raw(column["counts"])
    counts = np.frombuffer(counts.tobytes(), "<i8")
    space = data == 0x20
    ends = np.flatnonzero(space)
    sizes = np.diff(ends, prepend=-1) - 1
    encoded = binary(np.cumsum(sizes), data[~space]).dictionary_encode()
    distinct, width = encoded.dictionary, max(len(encoded.dictionary), 1)
    key = np.repeat(group, np.diff(at) // 8) * width + encoded.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    sums = np.add.reduceat(counts[order], first) if len(first) else counts
    key = key[first]
    owner, code = key // width, key % width
    rest = None
    done = len(heads)
    if not last:
        done -= 1
        own = np.flatnonzero(owner == done)
        spaced, _ = raw(pc.binary_join_element_wise(distinct, b"", b" ").take(pa.array(code[own])))
        head = rows.slice(int(heads[done]), 1)
        rest = head.set_column(head.column_names.index("total"), "total", pa.array([total[done]], pa.int64()))
        rest = rest.set_column(rest.column_names.index("next"), "next", pa.array([spaced.tobytes()], pa.binary()))
        rest = rest.set_column(rest.column_names.index("counts"), "counts", pa.array([sums[own].astype("<i8").tobytes()], pa.binary()))
    keep = np.flatnonzero((sums >= least) & (owner < done))
    owner, code, sums = owner[keep], code[keep], sums[keep]
    stripes, begin = np.unique(owner, return_index=True)
    lists = pa.array(np.append(begin, len(owner)).astype(np.int32))
    place = pa.array(heads[stripes])
    lang, prefix = column["lang"].take(place), column["prefix"].take(place)
    state = np.repeat(_states(lang, prefix, k), np.diff(np.append(begin, len(owner))))
    used, at_used = np.unique(code, return_inverse=True)
    used = pa.array(used)
    whole = distinct.take(pa.array(code)).cast(pa.string())
    merged = pa.RecordBatch.from_arrays(
        [
            lang,
            prefix,
            pa.array(total[stripes], pa.int64()),
            pa.array(np.maximum.reduceat(sums, begin) if len(begin) else sums, pa.int64()),
            pa.ListArray.from_arrays(lists, whole),
            pa.ListArray.from_arrays(lists, pa.array(sums, pa.int64())),
            pa.ListArray.from_arrays(lists, pa.array(_after(state, _names(distinct.take(used))[at_used]).view(np.int64))),
        ],
        ["lang", "prefix", "total", "top", "next", "n", "states"],
    )
    return merged, rest


def _merge(k: int, least: int):
    def run(batches):
        held, size, bound = [], 0, CHUNK
        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                size += batch.nbytes
            if size > bound:
                merged, rest = _merge_rows(pa.concat_tables(held), k, least, False)
                yield merged
                held, size = [rest], rest.nbytes
                bound = max(CHUNK, 2 * size)  # a growing stripe is merged anew only when it has doubled
        if held:
            yield _merge_rows(pa.concat_tables(held), k, least, True)[0]

    return run


def _bitmap(merged: DataFrame) -> np.ndarray:
    """A bit for each frequent phrase, at the upper bits of its hash."""
    bits = merged.select(F.explode("states").alias("state")).select(F.shiftrightunsigned("state", 64 - BITS).alias("bit"))
    words = bits.selectExpr("bit DIV 64 AS w", "shiftleft(1L, CAST(bit % 64 AS INT)) AS b")
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << BITS - 6, np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
    return out


def _phrases(merged: DataFrame, k: int) -> DataFrame:
    """The frequent phrases of ``k + 1`` words, with their counts ``a``."""
    rows = merged.select("lang", "prefix", F.inline(F.arrays_zip(F.col("next").alias("next"), F.col("n").alias("a"))))
    phrase = F.concat_ws(" ", "prefix", "next") if k else F.col("next")
    return rows.select("lang", phrase.alias("phrase"), F.lit(k + 1).alias("words"), "a")


def stripes(docs: DataFrame, scratch: Scratch, longest: int = LONGEST, least: int = LEAST, text: str = "text", lang: str = "lang") -> list[DataFrame]:
    """The merged stripes of the prefixes of 0 to ``longest - 1`` words, as written tables: ``lang, prefix, total, top, next, n, states``. The total is that of all words, on level 0 alone."""
    context = docs.sparkSession.sparkContext
    narrow = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(UND)).alias("lang"))
    out, frequent, hot, words = [], None, None, 0
    for k in range(longest):
        cut_ = narrow.mapInArrow(_stripes(k, frequent, hot), STRIPE)
        merged = scratch.write(cut_.repartition("lang", "prefix", "part").sortWithinPartitions("lang", "prefix", "part").mapInArrow(_merge(k, least), MERGED), f"stripes-{k}")
        out.append(merged)
        if k == 0:
            words = merged.groupBy("lang").agg(F.max("total").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if k + 1 < longest:
            crowded = _phrases(merged, k).filter(F.col("a") * PARTS >= words).collect()
            frequent, hot = context.broadcast(_bitmap(merged)), context.broadcast({(r.lang, r.phrase): 1 + r.a * PARTS // words for r in crowded})
    return out


def score() -> Column:
    """``1000000 * a * a / (l * r)`` rounded down, exact for counts of up to 15 digits."""
    return F.expr("CAST(1000000 * (CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))) DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0))) AS BIGINT)")


def mine(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, percent: int = PERCENT, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of 2 to ``longest`` words.

    A phrase is cut into two parts where ``1000000 * a * a / (l * r)`` is least;
    it is left out if one with a word more holds ``percent`` of its occurrences
    (longer ones hold no more, so these alone are asked).
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    levels = stripes(docs, scratch, longest, least, text, lang)
    every = _phrases(levels[0], 0)
    for k, merged in enumerate(levels[1:], 1):
        every = every.unionByName(_phrases(merged, k))
    every = scratch.write(every, "phrases")
    candidates = every.filter("words > 1").withColumn("w", F.split("phrase", " "))
    count = lambda part, name: every.select("lang", F.col("phrase").alias(part), F.col("a").alias(name)).hint("merge")
    between = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", between(F.lit(1), F.col("k")).alias("first"), between(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    cuts = cuts.join(count("first", "l"), ["lang", "first"]).join(count("rest", "r"), ["lang", "rest"])
    best = cuts.withColumn("score", score()).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    by_left = candidates.groupBy("lang", between(F.lit(2), F.col("words") - 1).alias("phrase")).agg(F.max("a").alias("longer"))
    for merged in levels[2:]:
        by_left = by_left.unionByName(merged.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.max("top").alias("longer")))
    longer = by_left.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = best.join(longer.hint("merge"), ["lang", "phrase"], "left").filter(f"longer IS NULL OR 100 * longer < {percent} * a").select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    ranked = scratch.write(left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))), "scored")
    order = "ORDER BY score DESC, a DESC, phrase"
    first = ranked.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang, salt {order})")).filter(F.col("rank") <= top)
    chosen = first.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang {order})").cast("long")).filter(F.col("rank") <= top)
    n = levels[0].groupBy("lang").agg(F.max("total").alias("n"))
    return chosen.join(n.hint("merge"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
