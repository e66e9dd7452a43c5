"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

A document's set holds its distinct runs of ``k`` words (A-Z lower-cased, words
are anything between white space); with fewer words the whole sequence is the
one element, without words the set is empty and the document linked with
nothing. Two documents are linked if 100 * |intersection| >= percent * |union|.

1. One pass makes each document's set size, a 128-bit digest of its set, and
   its SuperMinHash signature.
2. Documents with equal sets are one class, represented by the smallest id.
3. Signatures are cut into bands. In each bucket (equal band) every class is
   paired with the bucket's smallest, its hub. Pairs whose signatures agree too
   rarely are left out, the others are verified on their full sets.
4. Verified links are united. Where a bucket still holds several components,
   the pairs between different ones are tried too: buckets of up to
   ``SMALL_BUCKET`` classes by a join, larger ones block against block, where
   tasks verify on the spot and return only links that join components. Pairs
   within a component need no test, so nothing is lost and a large group of
   copies is never expanded into pairs.

A linked pair is missed if no band agrees: with 25 bands of 4 a chance of 1e-8
at a similarity of 0.85 and 2e-6 at 0.8. A pair at the threshold is left out by
its signature with a chance below 1e-6.

Words are named by their bytes or a cryptographic digest, so that no text can be
made to pass for another one.

Defined cases: a null or empty text, and one without words, has an empty set and
is linked with nothing; repeated rows get equal results; rows with one id and
different texts are one document, which is linked by any of its texts, and each
row has the set size of its own text; a row with a null id has its set, links
with nothing under an id of its own, and has a null component; of equally small
candidates none is preferred, since the smallest id decides; an empty table
gives no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import worker
from lodestone.llm.components import components
from lodestone.llm.shared import Scratch
from lodestone.llm.textbytes import SPACE_SPLIT, Words, digests, mix, slices, utf8

K = 5
PERCENT = 80
BANDS = 25
ROWS = 4
SMALL_BUCKET = 16
#: Rows of a large bucket that are compared with as many others at a time.
BLOCK = 512
#: Shingles of a block, about, which bounds the text that a task holds.
BLOCK_SHINGLES = 400_000
#: Members of a hub that are verified in one place.
SALT_ROWS = 200
_STEP = np.uint64(1 << 57)


def shingle_sets(words: Words, docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each document, sorted, one document after the other; and where each begins."""
    at, hashes = words.window_hashes(k)
    doc = words.doc[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        whole = np.empty(len(short), np.uint64)
        for size in range(1, k):
            pick = words.counts[short] == size
            total = np.zeros(int(pick.sum()), np.uint64)
            for j in range(size):
                total = total * np.uint64(0x9E3779B97F4A7C15) + words.hash[words.first[short[pick]] + j]
            whole[pick] = mix(total)
        doc, hashes = np.concatenate([doc, short]), np.concatenate([hashes, whole])
        order = np.argsort(doc, kind="stable")
        doc, hashes = doc[order], hashes[order]
    first = np.searchsorted(doc, np.arange(docs + 1))
    hashes = hashes.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.searchsorted(doc[new], np.arange(docs + 1))


def superminhash(elements: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """The SuperMinHash signatures (documents x m) of sets laid end to end.

    Each element has a random permutation of the ``m`` places, and the value
    ``j + r`` (r random below 1) at the place of its rank ``j``; a place keeps
    the smallest value. All sets take rank 0, then rank 1, and so on; a set
    whose places are all filled is done, since later ranks only bring greater
    values. Permutations are made rank by rank, by swaps.
    """
    docs = len(first) - 1
    sizes = np.diff(first)
    out = np.full((docs, m), np.iinfo(np.uint64).max, np.uint64)
    doc = np.repeat(np.arange(docs), sizes)
    flat = out.reshape(-1)
    places = None
    for j in range(m):
        drawn = mix(elements + np.uint64((j + 1) * 0xD1342543DE82EF95 % (1 << 64)))
        value = (drawn >> np.uint64(7)) + np.uint64(j) * _STEP
        swap = j + ((mix(drawn) >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if places is None:
            np.minimum.at(flat, doc * m + swap, value)
        else:
            row = np.arange(len(elements))
            mine = places[row, swap].astype(np.int64)
            places[row, swap] = places[:, j]
            np.minimum.at(flat, doc * m + mine, value)
        open_ = (out.max(1) >= np.uint64(j + 1) * _STEP) & (sizes > 0)
        stay = open_[doc]
        if not stay.any():
            break
        if places is None:
            places = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (int(stay.sum()), 1))
            places[np.arange(len(places)), swap[stay]] = 0
        elif not stay.all():
            places = places[stay]
        elements, doc = elements[stay], doc[stay]
    return out


def _signer(key: str, text: str, k: int, m: int):
    def run(batches):
        worker.drop()
        for rows, data, offsets in slices(batches, text):
            n = rows.num_rows
            words = Words(data, offsets, SPACE_SPLIT)
            sets, first = shingle_sets(words, n, k)
            sizes = np.diff(first)
            full = np.flatnonzero(sizes)
            names = np.zeros((n, 2), np.int64)
            for half, seed in enumerate((0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)):
                if len(full):
                    names[full, half] = np.add.reduceat(mix(sets ^ np.uint64(seed)), first[full]).view(np.int64)
            # One shingle alone: its hash is too short to name it among very many.
            single = np.flatnonzero(sizes == 1)
            names[single] = digests([words.text(words.first[d], words.first[d] + min(k, words.counts[d])) for d in single.tolist()])
            signature = (mix(superminhash(sets, first, m)) >> np.uint64(48)).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [rows.column(key).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([s.tobytes() for s in signature], pa.binary())], ["doc_id", "n", "h1", "h2", "sig"]
            )

    return run


def _alike(least: int):
    """Keeps pairs whose signatures agree in ``least`` places."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
                yield batch.filter(pa.array((one == two).sum(1) >= least)).select(["a", "b"])

    return run


def _linked(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of hashes are similar enough."""
    if not len(one) or not len(two):
        return False
    at = np.searchsorted(one, two)
    both = int((one[np.minimum(at, len(one) - 1)] == two).sum())
    return 100 * both >= percent * (len(one) + len(two) - both)


def _across(least: int, percent: int, k: int):
    """Links between two blocks of a bucket that join different components, verified on the spot.

    At most one link less than there are components comes out, however many
    pairs are alike.
    """

    def run(table: pa.Table) -> pa.Table:
        ids, n, comp = (table.column(c).to_numpy() for c in ("rep", "n", "comp"))
        side, i, j = table.column("side").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(len(ids), -1)
        data, offsets = utf8(table.column("t").combine_chunks())
        sets, first = shingle_sets(Words(data, offsets, SPACE_SPLIT), len(ids), k)
        mine = lambda d: sets[first[d] : first[d + 1]]
        comp = np.unique(comp, return_inverse=True)[1]
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        out = []
        for x in left.tolist():
            near = right[(comp[right] != comp[x]) & (ids[right] != ids[x]) & (np.minimum(n[right], n[x]) * 100 >= percent * np.maximum(n[right], n[x]))]
            if i == j:
                near = near[ids[near] > ids[x]]
            agree = (sig[near] == sig[x]).sum(1)
            for y in near[np.argsort(-agree, kind="stable")][: int((agree >= least).sum())].tolist():
                if comp[y] != comp[x] and _linked(mine(x), mine(y), percent):
                    out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
                    comp[comp == comp[y]] = comp[x]
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _verifier(text: str, k: int, percent: int):
    """Reads each hub's text, then its members', and keeps those that are linked with it."""

    def run(batches):
        worker.drop()
        hub, own = None, []  # the sets of the hub's texts
        for rows, data, offsets in slices(batches, text):
            sets, first = shingle_sets(Words(data, offsets, SPACE_SPLIT), rows.num_rows, k)
            hubs, members, found = rows.column("a").to_pylist(), rows.column("b").to_pylist(), []
            for d, (a, b) in enumerate(zip(hubs, members, strict=True)):
                mine = sets[first[d] : first[d + 1]]
                if a == b:
                    own = own if a == hub else []
                    hub = a
                    if not any(np.array_equal(mine, x) for x in own):
                        own.append(mine.copy())
                elif a == hub and any(_linked(x, mine, percent) for x in own):
                    found.append(d)
            yield rows.select(["a", "b"]).take(pa.array(found, pa.int64()))

    return run


def verify(pairs: DataFrame, docs: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` that are linked. Texts travel, which are smaller than their sets.

    A hub ``a`` with very many members is dealt to several places, each with a
    copy of the hub's text ahead of its share of the members.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).alias("salts"))
    dealt = pairs.join(salts.hint("merge"), "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").alias("salt"))
    needs = dealt.unionByName(salts.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")))
    texts = docs.select(F.col(key).cast("long").alias("b"), F.col(text).alias("t"))
    rows = texts.join(needs.hint("merge"), "b").select("a", "salt", (F.col("a") != F.col("b")).alias("member"), "b", "t")
    ordered = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "member", "b").select("a", "b", "t")
    return ordered.mapInArrow(_verifier("t", k, percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, k: int = K, bands: int = BANDS, rows: int = ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "minhash")
    m = bands * rows
    least = int(m * percent / 100 - 5 * (m * percent / 100 * (1 - percent / 100)) ** 0.5)
    sets = scratch.write(docs.select(key, text).mapInArrow(_signer(key, text, k, m), "doc_id long, n long, h1 long, h2 long, sig binary"), "sets")
    classes = scratch.write(sets.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig")), "classes")
    reps = classes.filter("rep IS NOT NULL").select("rep", "n", "sig")
    band = lambda b: F.xxhash64(F.lit(b), F.substring("sig", 2 * rows * b + 1, 2 * rows))
    buckets = reps.select("rep", F.explode(F.array(*[band(b) for b in range(bands)])).alias("bucket"))

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs whose set sizes and signatures allow a link."""
        one = reps.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
        two = reps.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
        near = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
        return near.select("a", "b", "sig_a", "sig_b").mapInArrow(_alike(least), "a long, b long")

    hubs = buckets.groupBy("bucket").agg(F.min("rep").alias("a"), F.count("*").alias("size")).filter("size > 1")
    starred = scratch.write(buckets.join(hubs.hint("merge"), "bucket").select("bucket", F.col("rep").alias("b"), "a", "size"), "buckets")
    tried = scratch.write(likely(starred.filter("a <> b").select("a", "b").distinct()), "hub-pairs")
    links = verify(tried, docs, key, text, k, percent)
    # An id with several texts joins the classes of all of them.
    several = sets.filter("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("n", "h1", "h2")).alias("low"), F.max(F.struct("n", "h1", "h2")).alias("high")).filter("low <> high").select("doc_id")
    if several.head(1):
        own = sets.join(several.hint("merge"), "doc_id").join(classes.select("n", "h1", "h2", "rep").hint("merge"), ["n", "h1", "h2"])
        links = links.unionByName(own.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b").distinct())
    links = scratch.write(links, "links")
    united = components(links, scratch)

    placed = starred.select("bucket", "size", F.col("b").alias("rep")).join(united.select(F.col("node").alias("rep"), "root").hint("merge"), "rep", "left").select("bucket", "size", "rep", F.coalesce("root", "rep").alias("comp"))
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 <> c2").select("bucket")
    open_ = scratch.write(placed.join(mixed.hint("merge"), "bucket"), "open")
    few = open_.filter(F.col("size") <= SMALL_BUCKET)
    one, two = few.select("bucket", F.col("rep").alias("a"), F.col("comp").alias("c1")), few.select("bucket", F.col("rep").alias("b"), F.col("comp").alias("c2"))
    small = likely(one.join(two.hint("merge"), "bucket").filter("a < b AND c1 <> c2").select("a", "b").distinct())
    more = scratch.write(small.join(tried.hint("merge"), ["a", "b"], "left_anti"), "open-pairs")
    found = [verify(more, docs, key, text, k, percent)] if more.head(1) else []
    crowded = open_.filter(F.col("size") > SMALL_BUCKET)
    if crowded.head(1):
        texts = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("t")).join(crowded.select("rep").distinct().hint("merge"), "rep").dropDuplicates(["rep", "t"])
        own = scratch.write(texts.join(reps.hint("merge"), "rep"), "crowded-texts")
        weights = crowded.join(own.groupBy("rep").agg(F.sum("n").alias("n")).hint("merge"), "rep").groupBy("bucket").agg(F.sum("n").alias("n"))
        blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("n") / BLOCK_SHINGLES))
        dealt = crowded.join(weights.hint("merge"), "bucket").withColumn("blocks", blocks).drop("n").withColumn("side", F.pmod(F.xxhash64("rep"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        many = dealt.select("bucket", "rep", "comp", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j")).join(own.hint("merge"), "rep")
        found.append(many.groupBy("bucket", "i", "j").applyInArrow(_across(least, percent, k), "a long, b long"))
    if found:
        new = scratch.write(found[0] if len(found) == 1 else found[0].unionByName(found[1]), "open-links")
        if new.head(1):
            united = components(links.unionByName(new), scratch)
    scratch.drop(starred, open_)

    whole = classes.join(united.select(F.col("node").alias("rep"), "root").hint("merge"), "rep", "left").select("n", "h1", "h2", F.coalesce("root", "rep").alias("root"))
    labelled = sets.select("doc_id", "n", "h1", "h2").join(whole.hint("merge"), ["n", "h1", "h2"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("root"))
    return labelled.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
