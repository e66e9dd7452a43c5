"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells.

1. Equal vectors are one class, represented by the smallest id.
2. Cells, about as many as the square root of the number of vectors, are fitted
   by spherical k-means on a sample of 8 vectors a cell, ``SAMPLE`` at least and
   ``SAMPLE_BYTES`` at most; it is drawn in the scan, by a threshold on the hash
   of ids that gives about so many. A vector belongs to the cell of its nearest centroid,
   and visits each cell whose border (the bisecting plane) is nearer than a
   margin; a pair is found if either vector visits the other's cell. The margin
   is ``MARGIN`` deviations that a step of the largest linked distance makes along
   a direction of the space that the data really fill: its effective dimensions
   are those of the sample or of its spread within cells, whichever are fewer. It
   is never above half the largest linked distance, which provably misses nothing
   (``exact=True`` takes that, and visits many more cells).
3. Cells are cut into blocks by hash; each pair of blocks is one product in
   double precision. A task returns for each vector the number of its links and
   the smallest vector joined with it, never the pairs. Of two cells that both
   see a pair, the one with the smaller number counts it.
4. Components are united over all tasks. One vector of each is kept.

Defined cases: null ids, null, empty and zero vectors, and such with null or
non-finite components link with nothing; vectors of other dimensions than the
sample's most frequent one are compared in one cell of each dimension; every row
is a vector and gives a row, repeated ones are linked with each other, and an id
with several vectors joins the components of all of them; an empty table gives
no rows; a cosine of exactly ``least`` is a link. Other columns are not looked
at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import components
from lodestone.llm.shared import Scratch
from lodestone.llm.textbytes import digests

LEAST = 0.95
#: Vectors that the cells are fitted on, at least, and their bytes at most, which bound the number of cells.
SAMPLE = 20_000
SAMPLE_BYTES = 128 << 20
MARGIN = 2.0
#: Vectors of a cell that are compared with as many others by one task.
BLOCK = 4096
#: Elements of a product that are held at a time.
_HELD = 1 << 20
_ROUNDS = 8


def unit_rows(x: np.ndarray) -> np.ndarray:
    """The rows at length 1; scaled first, so that squares neither vanish nor overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _nearest(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    rows = max(1, _HELD // len(centres))
    return np.concatenate([(unit[k : k + rows] @ centres.T).argmax(1) for k in range(0, len(unit), rows)] or [np.zeros(0, np.int64)])


def fit_cells(sample: np.ndarray, cells: int, seed: int = 11) -> np.ndarray:
    """Unit centroids by spherical k-means."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(_ROUNDS):
        own = _nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norms = np.linalg.norm(sums, axis=1)
        centres = np.where(norms[:, None] > 1e-12, sums / np.maximum(norms, 1e-12)[:, None], centres)
    return centres


def effective_dimensions(rows: np.ndarray) -> float:
    """In how many directions, counted as if they were equally strong, the rows spread around their mean."""
    spread = np.cov(rows, rowvar=False).reshape(rows.shape[1], -1) if len(rows) > 1 else np.zeros((1, 1))
    total = float((spread * spread).sum())
    return float(np.trace(spread)) ** 2 / total if total > 0 else 1.0


def margin_for(sample: np.ndarray, centres: np.ndarray, step: float, exact: bool) -> float:
    """How near to a border a vector visits the next cell."""
    if exact:
        return step / 2
    apart = sample - centres[_nearest(sample, centres)] if len(centres) < len(sample) else sample
    return min(step / 2, MARGIN * step / min(effective_dimensions(sample), effective_dimensions(apart)) ** 0.5)


class Cells:
    """Centroids, and how near to a border a vector visits the next cell."""

    def __init__(self, centres: np.ndarray, margin: float):
        self.centres, self.margin = centres, margin

    def sees(self, unit: np.ndarray, own: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Whether each vector, at home in ``own``, visits each of these cells."""
        home = self.centres[own]
        gain = np.einsum("ij,ij->i", unit, home)[:, None] - unit @ self.centres[cells].T
        apart = np.sqrt(np.maximum(2 - 2 * home @ self.centres[cells].T, 0))
        return (gain <= self.margin * apart) | (own[:, None] == cells[None, :])

    def visits(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The own cell of each vector; and row and cell of every visit, its own among them."""
        own, every = _nearest(unit, self.centres), np.arange(len(self.centres))
        rows, out = max(1, _HELD // len(self.centres)), []
        for k in range(0, len(unit), rows):
            at, cell = np.nonzero(self.sees(unit[k : k + rows], own[k : k + rows], every))
            out.append((at + k, cell))
        at, cell = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
        return own, at, cell


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors' dimensions, and all their components end to end, in double precision."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return sizes, column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def _placed(batch: pa.RecordBatch, cells: Cells):
    """Row, cell and own cell of every visit. Dimensions without fitted cells have a cell of their own, numbered below 0."""
    sizes, flat = _matrix(batch.column("embedding"))
    dim = cells.centres.shape[1]
    rows = np.flatnonzero(sizes == dim)
    out = []
    if len(rows):
        first = np.cumsum(sizes) - sizes
        own, at, cell = cells.visits(unit_rows(flat[first[rows][:, None] + np.arange(dim)]))
        out.append((rows[at], cell, own[at]))
    other = np.flatnonzero(sizes != dim)
    out.append((other, -sizes[other], -sizes[other]))
    return [np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True)]


def _compare(shared, least: float):
    def run(table: pa.Table) -> pa.Table:
        cells: Cells = shared.value
        cell, i, j = (table.column(c)[0].as_py() for c in ("cell", "i", "j"))
        side, own, class_, rep, copies = (table.column(c).to_numpy() for c in ("side", "own", "class", "rep", "copies"))
        sizes, flat = _matrix(table.column("embedding").combine_chunks())
        unit = unit_rows(flat.reshape(len(sizes), sizes[0]))
        a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
        link = np.zeros((len(a), len(b)), bool)
        rows = max(1, _HELD // max(len(b), 1))
        if cell >= 0:
            homes, place = np.unique(own, return_inverse=True)
            step = max(1, _HELD // len(homes))
            seen = np.concatenate([cells.sees(unit[k : k + step], own[k : k + step], homes) for k in range(0, len(own), step)])
            mine = own == cell
            # A pair of two visitors is compared elsewhere; of two cells that see a pair the smaller one counts it.
            counts = lambda p, q: mine[p][:, None] & (~seen[p][:, place[q]] | (cell <= own[q])[None, :])
        for k in range(0, len(a), rows):
            part = a[k : k + rows]
            cosine = unit[part] @ unit[b].T
            near = cosine >= least
            for p, q in zip(*np.nonzero(np.abs(cosine - least) < 1e-12), strict=True):
                u, v = unit[part[p]], unit[b[q]]
                near[p, q] = float(u @ v) / (float(np.sqrt(u @ u)) * float(np.sqrt(v @ v))) >= least
            if cell >= 0:
                near &= counts(part, b) | counts(b, part).T
            link[k : k + rows] = near
        if i == j:
            np.fill_diagonal(link, False)
        n = np.zeros(len(rep), np.int64)
        n[a] += link @ copies[b]
        if i != j:
            n[b] += link.T @ copies[a]
        root, none = rep.copy(), np.iinfo(np.int64).max
        while True:
            low = root.copy()
            for k in range(0, len(a), rows):
                part, on = a[k : k + rows], link[k : k + rows]
                low[part] = np.minimum(low[part], np.where(on, low[b][None, :], none).min(1, initial=none))
                low[b] = np.minimum(low[b], np.where(on, low[part][:, None], none).min(0, initial=none))
            if (low == root).all():
                break
            root = low
        some = n > 0
        return pa.table({"class": class_[some], "rep": rep[some], "n": n[some], "root": root[some]})

    return run


def _named(batches):
    """Each vector with the halves of a digest of its components."""
    for batch in batches:
        vectors = batch.column("embedding")
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
        flat = np.ascontiguousarray(vectors.flatten().to_numpy(zero_copy_only=False))
        raw, ends = flat.tobytes(), np.cumsum(sizes) * flat.itemsize
        names = digests([raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]) if len(sizes) else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[:, 0]), pa.array(names[:, 1])], [*batch.schema.names, "h1", "h2"])


def near_duplicates(vectors: DataFrame, least: float = LEAST, key: str = "vec_id", embedding: str = "embedding", cells: int | None = None, exact: bool = False) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each vector."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    kind = rows.schema["embedding"].dataType.simpleString()
    named = rows.filter(usable).mapInArrow(_named, f"vec_id long, embedding {kind}, h1 long, h2 long")
    once = scratch.write(named, "vectors")
    classes = scratch.write(once.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")).withColumn("class", F.monotonically_increasing_id()), "classes")
    total = classes.count()
    widest = classes.agg(F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()[0]

    wished = cells or max(1, round(total**0.5))
    bound = max(1, SAMPLE_BYTES // (8 * widest))
    drawn = min(bound, max(SAMPLE, 8 * wished))
    mark = F.pmod(F.xxhash64("rep"), F.lit(1 << 30))
    sample = classes.filter(mark < round((1 << 30) * min(1.0, drawn / max(total, 1)))).select("embedding", mark.alias("h"), "rep").toArrow().sort_by([("h", "ascending"), ("rep", "ascending")])
    sizes, flat = _matrix(sample.column(0).combine_chunks()) if sample.num_rows else (np.ones(1, np.int64), np.ones(1))
    dims, often = np.unique(sizes, return_counts=True)
    dim = int(dims[often.argmax()])
    first = (np.cumsum(sizes) - sizes)[sizes == dim]
    unit = unit_rows(flat[first[:, None] + np.arange(dim)])
    centres = fit_cells(unit, wished if cells else min(wished, -(-len(unit) // 8)))
    model = Cells(centres, margin_for(unit, centres, float(np.sqrt(2 - 2 * least)), exact))
    shared = spark.sparkContext.broadcast(model)

    def count(batches):
        for batch in batches:
            if batch.num_rows:
                cell, n = np.unique(_placed(batch, shared.value)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

    held = {r.cell: r.n for r in classes.select("embedding").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at, cell, own = _placed(batch, shared.value)
            blocks = np.array([-(-held[c] // BLOCK) for c in cell.tolist()])
            side = (batch.column("rep").to_numpy()[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % blocks
            row = np.repeat(np.arange(len(at)), blocks)
            other = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            i, j = np.minimum(side[row], other), np.maximum(side[row], other)
            for k in range(0, len(row), 20_000):
                part = slice(k, k + 20_000)
                r = row[part]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x) for x in (cell[r], i[part], j[part], side[r], own[r])), *(batch.column(c).take(pa.array(at[r])) for c in ("class", "rep", "copies", "embedding"))],
                    ["cell", "i", "j", "side", "own", "class", "rep", "copies", "embedding"],
                )

    dealt = classes.mapInArrow(deal, f"cell long, i long, j long, side long, own long, class long, rep long, copies long, embedding {kind}")
    found = scratch.write(dealt.groupBy("cell", "i", "j").applyInArrow(_compare(shared, least), "class long, rep long, n long, root long"), "links")
    # An id with several vectors joins the classes of all of them.
    several = once.groupBy("vec_id").agg(F.min(F.struct("h1", "h2")).alias("low"), F.max(F.struct("h1", "h2")).alias("high")).filter("low <> high").select("vec_id")
    shared_ids = once.select("vec_id", "h1", "h2").join(several.hint("merge"), "vec_id", "left_semi").join(classes.select("h1", "h2", "rep").hint("merge"), ["h1", "h2"]).select(F.col("rep"), F.col("vec_id").alias("root"))
    united = components(found.select("rep", "root").unionByName(shared_ids.distinct()), scratch)
    numbers = found.groupBy("class").agg(F.sum("n").alias("n"))
    whole = classes.join(numbers.hint("merge"), "class", "left").join(united.select(F.col("node").alias("rep"), "root").hint("merge"), "rep", "left")
    whole = whole.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    good = once.select("vec_id", "h1", "h2").join(whole.hint("merge"), ["h1", "h2"]).select("vec_id", "n_links", F.col("root").alias("component_id"))
    alone = rows.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
