"""Near-duplicate lines by a segment-partition edit join.

Lines of at least ``MIN_CHARS`` characters are linked if their edit distance is
at most ``EDITS``; of each group of linked or equal lines the first (smallest
document id, then line number) stays and the others are removed. Equal lines
are grouped from ``equal`` characters on, which may be fewer: the floor guards
short lines from false links alone.

1. A line of length n is cut into EDITS + 1 segments, each indexed under its
   length class, number and content. For each length from n - EDITS to n a line
   probes the index with those of its substrings that a segment can have moved
   to. Two lines within the distance always meet in one bucket.
2. A task sends a line's buckets once, however often it meets the line, so a line
   in all texts is about a row for each task. Buckets are shuffled by their hash, sorted, and read as a stream, which lets
   only those pass that hold two different lines and an indexed one.
3. Pairs of small buckets are joined, crowded buckets are compared block
   against block; both are verified by banded bit-parallel edit distance. A
   crowded bucket returns only links that join groups.
4. Links are united; equal lines are one class from the start by their hashes.

Lines are named by the halves of a cryptographic digest: by 64 bits while links
are sought, by all 128 where lines are grouped and removed. Buckets alone have
plain hashes, since each pair in them is compared. Tables are broadcast while
their bytes are below ``BROADCAST_BYTES``, and shuffled beyond it.

Defined cases: a null text stays null and has no lines, an empty one has one
empty line; documents with a null id neither lose lines nor cause losses; an
empty table gives no rows. Rows with one id are parts of one document: of equal
lines with one id and one number all stay if they are the first. Lines below
both floors, and short lines of white space alone, always stay. Columns of the
input stay whatever their names, but a column named like the ``gone`` parameter
raises ``ValueError``. Characters are Unicode code points.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import worker
from lodestone.llm.components import components
from lodestone.llm.shared import Scratch
from lodestone.llm.textbytes import digests, mix, powers, slices

EDITS = 2
MIN_CHARS = 30
#: Equal lines of so many characters, not all white space, are grouped by the registered query and the pipeline.
EQUAL_CHARS = 1
SMALL_BUCKET = 16
BLOCK = 512
#: Lines of a block that are compared one by one before the others.
HUBS = 8
#: Bytes of a table that is broadcast at most.
BROADCAST_BYTES = 32 << 20
#: Rows of a bucket that wait for the rest of it at most; a larger one passes whole.
HELD_ROWS = 100_000
#: Names of lines that a task remembers to have sent, before it starts afresh.
SEEN = 500_000
_LINES_PER_BATCH = 20_000


def segments(length: np.ndarray, number: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment ``number`` of lines of these lengths: an even cut, longer segments last."""
    short, longer = length // (edits + 1), length % (edits + 1)
    first_long = edits + 1 - longer
    return number * short + np.maximum(number - first_long, 0), short + (number >= first_long)


class Lines:
    """The eligible lines of a slice of texts, with hashes of any of their substrings; shorter ones from ``equal`` on if they aren't blank."""

    def __init__(self, texts: list[str | None], least: int, equal: int | None = None):
        found = [(d, k, x) for d, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if len(x) >= least or (equal is not None and len(x) >= equal and not x.isspace() and x)]
        self.doc = np.array([d for d, _, _ in found], np.int64)
        self.number = np.array([k for _, k, _ in found], np.int64)
        self.text = [x for _, _, x in found]
        self.size = np.fromiter(map(len, self.text), np.int64, len(self.text))
        self.start = np.cumsum(self.size) - self.size
        self.codes = np.frombuffer("".join(self.text).encode("utf-32-le", "surrogatepass"), "<u4")
        self._sums: np.ndarray | None = None

    def hash(self, line: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Hashes of the substrings at ``at`` of these lines."""
        up, down = powers(len(self.codes) + 1)
        if self._sums is None:
            self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.codes.astype(np.uint64) + np.uint64(1)) * up[:-1])])
        a = self.start[line] + at
        return mix((self._sums[a + size] - self._sums[a]) * down[a] + size.astype(np.uint64))

    def names(self) -> np.ndarray:
        """Both halves of each line's digest."""
        return digests([x.encode("utf-8", "surrogatepass") for x in self.text])


def bucket_keys(lines: Lines, pick: np.ndarray, edits: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, bucket and whether it is indexed there, for the picked lines."""
    out = []

    def put(line, at, size, length, number, indexed):
        label = mix((length * (edits + 1) + number).astype(np.uint64))
        out.append((line, mix(lines.hash(line, at, size) ^ label).view(np.int64), np.full(len(line), indexed)))

    own = lines.size[pick]
    for number in range(edits + 1):
        home, size = segments(own, number, edits)
        put(pick, home, size, own, number, True)
        for shorter in range(edits + 1):
            length = own - shorter
            home, size = segments(length, number, edits)
            low, high = max(-number, shorter - (edits - number)), min(number, shorter + edits - number)
            for move in range(low, high + 1):
                ok = (length >= least) & (home + move >= 0) & (home + move + size <= own)
                if shorter or move:
                    put(pick[ok], (home + move)[ok], size[ok], length[ok], number, False)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _core(a: str, b: str) -> tuple[str, str]:
    """Both texts without their common beginning and end, found by bisection."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    head, high, low = low, min(len(a), len(b)) - low, 0
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[len(a) - middle : len(a) - low] == b[len(b) - middle : len(b) - low] else (low, middle - 1)
    return a[head : len(a) - low], b[head : len(b) - low]


def edit_distances(left: list[str], right: list[str], most: int) -> np.ndarray:
    """Edit distances of pairs, and ``most + 1`` wherever they are greater.

    Common beginnings and ends are set aside. Then bit-parallel over a band of
    2 * most + 1 diagonals, which moves down one row with each character; one
    step serves all pairs. ``most`` is at most 30.
    """
    if not left:
        return np.zeros(0, np.int64)
    end = "\0" * (most + 1)  # a common end changes no distance, and makes all texts longer than the band
    cores = [_core(a, b) for a, b in zip(left, right, strict=True)]
    left, right = ([c[k] + end for c in cores] for k in (0, 1))
    pairs = [(a, b) if len(a) >= len(b) else (b, a) for a, b in zip(left, right, strict=True)]
    m, n = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    codes = [np.frombuffer("".join(p[k] for p in pairs).encode("utf-32-le", "surrogatepass") + b"\0\0\0\0", "<u4") for k in (0, 1)]
    first = [np.cumsum(x) - x for x in (m, n)]
    one, top = np.uint64(1), np.uint64(1 << 63)
    vp = np.full(len(pairs), ((1 << 64) - 1) << (63 - most) & ((1 << 64) - 1), np.uint64)
    vn = np.zeros(len(pairs), np.uint64)
    mask = np.full(len(pairs), 1 << 62, np.uint64)
    score = np.full(len(pairs), most)
    result = np.where(m - n > most, most + 1, 0)
    live = np.flatnonzero(result == 0)
    for i in range(int(n.max())):
        live = live[i < n[live]]
        if not len(live):
            break
        char = codes[1][first[1][live] + i]
        match = np.zeros(len(live), np.uint64)
        for j in range(2 * most + 1):
            at = i + most - j
            if at >= 0:
                ok = at < m[live]
                match |= ((codes[0][first[0][live] + np.minimum(at, m[live] - 1)] == char) & ok).astype(np.uint64) << np.uint64(63 - j)
        p, q = vp[live], vn[live]
        d0 = (((match & p) + p) ^ p) | match | q
        hp, hn = q | ~(d0 | p), d0 & p
        diagonal = i < m[live] - most
        across = ((hp & mask[live]) != 0).astype(np.int64) - ((hn & mask[live]) != 0)
        score[live] += np.where(diagonal, (d0 & top) == 0, across)
        mask[live] = np.where(diagonal, mask[live], mask[live] >> one)
        d0 >>= one
        vp[live], vn[live] = hn | ~(d0 | hp), d0 & hp
        live = live[score[live] <= 2 * most + n[live] - m[live] + most]
    return np.where(result == 0, np.minimum(score, most + 1), result)


def _batches(columns: list[np.ndarray], names: list[str], size: int = 200_000):
    for k in range(0, len(columns[0]), size):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + size]) for c in columns], names)


def _keyed(text: str, edits: int, least: int):
    """Buckets of each line; of a line that many texts hold, about once for each task."""

    def run(batches):
        worker.drop()
        seen = np.zeros(0, np.int64)  # the names of lines that this task has sent, sorted
        for rows, _, _ in slices(batches, text):
            lines = Lines(rows.column(text).to_pylist(), least)
            if lines.text:
                ids = lines.names()[:, 0]
                own, pick = np.unique(ids, return_index=True)
                if len(seen):
                    new = seen[np.minimum(np.searchsorted(seen, own), len(seen) - 1)] != own
                    own, pick = own[new], pick[new]
                if not len(pick):
                    continue
                seen = own if len(seen) > SEEN else np.sort(np.concatenate([seen, own]))
                line, bucket, indexed = bucket_keys(lines, pick, edits, least)
                yield from _batches([bucket, ids[line], indexed], ["bucket", "id", "indexed"])

    return run


def _shared(batches):
    """Of rows sorted by bucket, those whose bucket has two different lines and an indexed one.

    The last bucket of a batch waits for the next batch, unless it is large
    already; then it passes with all its later rows, which is only less strict.
    """
    rest = known = None

    def passed(table):
        bucket, line = (table.column(c).to_numpy() for c in ("bucket", "id"))
        if not len(bucket):
            return table
        head = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1 if bucket[0] > np.iinfo(np.int64).min else bucket[0] + 1))
        some = np.maximum.reduceat(table.column("indexed").to_numpy(zero_copy_only=False), head)
        good = some & (np.minimum.reduceat(line, head) != np.maximum.reduceat(line, head))
        return table.filter(pa.array(np.repeat(good, np.diff(np.append(head, len(bucket))))))

    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
        if not table.num_rows:
            continue
        bucket = table.column("bucket").to_numpy()
        first = int(np.searchsorted(bucket, known, "right")) if known is not None else 0
        last = max(first, int(np.searchsorted(bucket, bucket[-1])))
        yield from table.slice(0, first).to_batches()
        yield from passed(table.slice(first, last - first)).to_batches()
        held = table.slice(last)
        if held.num_rows > HELD_ROWS:
            yield from held.to_batches()
            rest, known = None, bucket[-1]
        elif not held.num_rows:
            rest = None
        else:
            rest = pa.RecordBatch.from_arrays([c.combine_chunks() for c in held.columns], held.schema.names)
    if rest is not None:
        yield from passed(pa.Table.from_batches([rest])).to_batches()


def _texts(text: str, least: int, wanted=None):
    """Name and text of each line, of those wanted (a broadcast of sorted hashes) if that is given."""

    def run(batches):
        for rows, _, _ in slices(batches, text):
            lines = Lines(rows.column(text).to_pylist(), least)
            names = lines.names()
            ids = names[:, 0]
            pick = np.unique(names, axis=0, return_index=True)[1] if len(ids) else np.zeros(0, np.int64)
            if wanted is not None and len(wanted.value):
                at = np.minimum(np.searchsorted(wanted.value, ids[pick]), len(wanted.value) - 1)
                pick = pick[wanted.value[at] == ids[pick]]
            elif wanted is not None:
                pick = pick[:0]
            for k in range(0, len(pick), _LINES_PER_BATCH):
                part = pick[k : k + _LINES_PER_BATCH]
                yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(names[part, 1]), pa.array([lines.text[p] for p in part.tolist()], pa.string())], ["id", "h2", "line"])

    return run


def _bags(line: list[str]) -> np.ndarray:
    """How often each class of characters (code point modulo 64) occurs in each line."""
    size = np.array([len(x) for x in line])
    codes = np.frombuffer("".join(line).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) % 64
    return np.bincount(np.repeat(np.arange(len(line)), size) * 64 + codes, minlength=64 * len(line)).reshape(-1, 64).astype(np.int32)


def _verified(edits: int):
    def run(batches):
        for batch in batches:
            near = edit_distances(batch.column("line_a").to_pylist(), batch.column("line_b").to_pylist(), edits) <= edits
            yield batch.filter(pa.array(near, pa.bool_())).select(["a", "b"])

    return run


def _crowded(edits: int):
    """Links between two blocks of a bucket that join groups: each line against all others not yet joined with it."""

    def run(table: pa.Table) -> pa.Table:
        ids, side = table.column("id").to_numpy(), table.column("side").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        line, indexed = table.column("line").to_pylist(), table.column("indexed").to_numpy()
        bags = _bags(line)
        group, out = np.arange(len(ids)), []
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)

        def near(x: int) -> np.ndarray:
            y = right[(group[right] != group[x]) & (ids[right] != ids[x]) & (indexed[right] | indexed[x])]
            if i == j:
                y = y[ids[y] > ids[x]]
            return y[np.abs(bags[y] - bags[x]).sum(1) <= 2 * edits]  # an edit changes two counts at most

        def join(x: np.ndarray, y: np.ndarray) -> None:
            ok = edit_distances([line[k] for k in x.tolist()], [line[k] for k in y.tolist()], edits) <= edits
            for p, q in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
                if group[p] != group[q]:
                    out.append((ids[p], ids[q]))
                    group[group == group[q]] = group[p]

        # A few lines against all first, which joins most of a large group; then what is left, many pairs at a time.
        for x in left[:HUBS].tolist():
            join(np.full(len(y := near(x)), x), y)
        held, n = [], 0
        for x in left[HUBS:].tolist():
            y = near(x)
            held.append((np.full(len(y), x), y))
            n += len(y)
            if n >= 20_000:
                join(*(np.concatenate(z) for z in zip(*held, strict=True)))
                held, n = [], 0
        if held:
            join(*(np.concatenate(z) for z in zip(*held, strict=True)))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _bounded(frame: DataFrame, extra=None) -> DataFrame:
    """The frame, marked for broadcast if its bytes (of a row's columns, and ``extra``) are few enough, else for a shuffle."""
    width = F.lit(32 + 16 * len(frame.columns)) + (F.lit(0) if extra is None else extra)
    return F.broadcast(frame) if frame.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()[0] <= BROADCAST_BYTES else frame.hint("merge")


def line_links(docs: DataFrame, scratch: Scratch, text: str, edits: int, least: int) -> DataFrame:
    """``h1, h2, root``: for each line linked with another, by the halves of its name, the smallest first half of its group."""
    keyed = docs.select(text).mapInArrow(_keyed(text, edits, least), "bucket long, id long, indexed boolean")
    open_ = scratch.write(keyed.repartition("bucket").sortWithinPartitions("bucket", "id").mapInArrow(_shared, "bucket long, id long, indexed boolean").groupBy("bucket", "id").agg(F.max("indexed").alias("indexed")), "buckets")
    sizes = scratch.write(open_.groupBy("bucket").agg(F.count("*").alias("size")), "sizes")
    sized = open_.join(sizes.hint("merge"), "bucket")
    ids = scratch.write(open_.select("id").distinct(), "ids")
    if ids.count() * 8 <= BROADCAST_BYTES:
        wanted = docs.sparkSession.sparkContext.broadcast(np.sort(ids.toArrow().column(0).to_numpy()))
        lines = docs.select(text).mapInArrow(_texts(text, least, wanted), "id long, h2 long, line string")
    else:
        lines = docs.select(text).mapInArrow(_texts(text, least), "id long, h2 long, line string").join(ids.hint("merge"), "id", "left_semi")
    # Of two lines with one 64-bit name, which chance brings about once in 2**64 pairs, the one with the smaller digest is compared.
    texts = scratch.write(lines.groupBy("id").agg(F.min(F.struct("h2", "line")).alias("x")).select("id", "x.h2", "x.line"), "texts")
    body = texts.select("id", "line")

    few = sized.filter(F.col("size") <= SMALL_BUCKET)
    one, two = few.filter("indexed").select("bucket", F.col("id").alias("x")), few.select("bucket", F.col("id").alias("y"))
    pairs = one.join(two.hint("merge"), "bucket").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    shown = pairs.join(body.select(F.col("id").alias("a"), F.col("line").alias("line_a")).hint("merge"), "a").join(body.select(F.col("id").alias("b"), F.col("line").alias("line_b")).hint("merge"), "b")
    links = shown.select("a", "b", "line_a", "line_b").mapInArrow(_verified(edits), "a long, b long")
    many = sized.filter(F.col("size") > SMALL_BUCKET)
    if many.head(1):
        dealt = many.withColumn("blocks", F.ceil(F.col("size") / BLOCK)).withColumn("side", F.pmod(F.xxhash64("id"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        dealt = dealt.select("bucket", "id", "indexed", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j")).join(body.hint("merge"), "id")
        links = links.unionByName(dealt.groupBy("bucket", "i", "j").applyInArrow(_crowded(edits), "a long, b long"))
    united = components(scratch.write(links, "links"), scratch)
    every = united.unionByName(united.select(F.col("root").alias("node"), "root").distinct())
    return scratch.write(every.join(texts.select(F.col("id").alias("node"), "h2").hint("merge"), "node").select(F.col("node").alias("h1"), "h2", "root"), "linked")


def _occurrences(key: str, text: str, least: int, equal: int | None):
    def run(batches):
        for rows, _, _ in slices(batches, text):
            lines = Lines(rows.column(text).to_pylist(), least, equal)
            if lines.text:
                own = rows.column(key).cast(pa.int64()).to_numpy()[lines.doc]
                yield from _batches([own, lines.number, *lines.names().T], ["doc_id", "line_no", "h1", "h2"])

    return run


def _without(text: str, gone: str):
    def run(batches):
        for rows, _, _ in slices(batches, text):
            kept = []
            for body, numbers in zip(rows.column(text).to_pylist(), rows.column(gone).to_pylist(), strict=True):
                if body is not None and numbers:
                    numbers = set(numbers)
                    body = "\n".join(x for k, x in enumerate(body.split("\n")) if k not in numbers)
                kept.append(body)
            at = rows.schema.get_field_index(text)
            yield rows.set_column(at, rows.schema.field(at), pa.array(kept, rows.schema.field(at).type))

    return run


def dedup(docs: DataFrame, edits: int = EDITS, least: int = MIN_CHARS, key: str = "doc_id", text: str = "text", equal: int | None = None, gone: str = "_gone") -> DataFrame:
    """The documents, all columns, without lines that repeat an earlier line; ``gone`` names the removed line numbers.

    ``equal`` is the floor for equal lines, ``least`` if it is None.
    """
    if gone in docs.columns:
        raise ValueError(f"the documents have a column {gone!r} already")
    scratch = Scratch(docs.sparkSession, "lines")
    known = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    linked = line_links(known, scratch, "text", edits, least)
    found = known.mapInArrow(_occurrences("doc_id", "text", least, equal), "doc_id long, line_no long, h1 long, h2 long")
    # A linked line's class is its group's root, any other line's its own name.
    classed = found.join(_bounded(linked), ["h1", "h2"], "left").select("doc_id", "line_no", F.coalesce("root", "h1").alias("c1"), F.when(F.col("root").isNull(), F.col("h2")).alias("c2"), F.col("root").isNotNull().alias("grouped"))
    found = scratch.write(classed.withColumn("c2", F.coalesce("c2", F.lit(0))), "lines")
    by = ["c1", "c2", "grouped"]
    first = scratch.write(found.groupBy(*by).agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n")).filter("n > 1").select(*by, F.col("first.doc_id").alias("d"), F.col("first.line_no").alias("l")), "first")
    repeats = found.join(first.hint("merge"), by).filter("doc_id <> d OR line_no <> l")
    own = f"_{uuid.uuid4().hex}"
    removed = scratch.write(repeats.groupBy(F.col("doc_id").alias(own)).agg(F.array_sort(F.collect_set("line_no")).alias(gone)), "gone")
    marked = docs.join(_bounded(removed, 8 * F.size(gone)), F.col(key) == F.col(own), "left").drop(own)
    return marked.mapInArrow(_without(text, gone), marked.schema)


def counts(docs: DataFrame, edits: int = EDITS, least: int = MIN_CHARS, key: str = "doc_id", text: str = "text", equal: int | None = None) -> DataFrame:
    """``key, n_lines, n_removed, kept_sha256`` for each document."""
    lines = F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long")
    numbered = docs.select(key, text, F.when(F.col(text).isNull(), F.lit(0)).otherwise(lines).alias("n_lines"))
    kept = dedup(numbered, edits, least, key, text, equal)
    gone = F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_gone")).cast("long")
    return kept.select(key, "n_lines", gone.alias("n_removed"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("kept_sha256"))
