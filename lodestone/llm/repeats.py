"""Repeated byte strings by suffix sorting.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere
else, in the same text or another, is removed. Strings never cross texts.

1. The anchor of a window of LENGTH bytes is the smallest hash of ``GRAM`` bytes
   in it. Equal windows have equal anchors at equal places, so windows are only
   compared under one anchor. Neighbouring windows of one anchor make a run; a
   run's bytes are its piece.
2. Runs are shuffled by anchor and read as a sorted stream; runs under an anchor
   that occurs once are done. Of equal pieces, by a 128-bit cryptographic digest,
   one goes on: all windows of the others are repeated. A task sends a piece twice
   at most, so one that is in all texts isn't a row for each of them.
3. The different pieces of an anchor are suffix-sorted together, many anchors at
   a time: windows smaller than the next window are sorted directly, the others
   are induced from their successors by one scan over the buckets of first
   bytes. Neighbours in this order with a common prefix of LENGTH are repeated.
   Anchors with more than ``CROWD`` different pieces are split first: windows go
   by the part of the window that the anchor stands in, and by all bytes around
   the anchor that every window of that part holds. Equal windows stay together,
   parts are halved until no group is crowded, and at the last step a group
   holds one window.
4. Repeated windows are gathered by text and cut out of it.

Texts are named by 128-bit cryptographic digests, so equal texts are handled
alike, whatever their ids: repeated rows are copies of each other. Defined
cases: a null or empty text has no bytes and loses none; texts shorter than
LENGTH lose nothing; a null id is an id like others; an empty table gives no
rows; of equal anchors in a window the leftmost counts, which changes no result.
Columns other than the key and the text are not looked at, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import worker
from lodestone.llm.shared import Scratch
from lodestone.llm.textbytes import digests, mix, powers, slices, utf8

LENGTH = 400
GRAM = 64
#: Different pieces of an anchor that are sorted in one place at most.
CROWD = 512
#: Windows sorted together.
SORTED = 100_000
#: Pieces that a task remembers to have sent, before it starts afresh.
SEEN = 200_000
#: How often parts are halved before crowded groups are looked for again.
_HALVINGS = 3
#: Places in a slice, which holds at most one text longer than itself, and no text has 2 GB.
_PLACE = np.uint64((1 << 32) - 1)
_RUN = "anchor long, t long, u long, first long, n long, d long, h1 long, h2 long, times long"
_PART = "anchor long, t long, u long, first long, n long, d long, h1 long, h2 long, piece binary"
_RANGES = "array<struct<lo: long, hi: long>>"


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` bytes. They choose anchors only; equality is never decided by them."""
    up, down = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    return mix((sums[k:] - sums[:-k]) * down[: len(sums) - k])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    rows = np.concatenate([x, np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead, behind = np.minimum.accumulate(rows, 1).ravel(), np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: len(x) - width + 1], ahead[width - 1 : len(x)])


def names(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The two halves of each text's digest."""
    raw = data.tobytes()
    return digests([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])


def _runs(text: str, length: int, gram: int):
    def run(batches):
        worker.drop()
        once, twice = set(), set()  # pieces that this task has sent
        for _, data, offsets in slices(batches, text):
            if len(data) < length:
                continue
            grams = gram_hashes(data, gram)
            # Where upper bits of hashes tie, the leftmost is taken, which depends on the window alone, too.
            least = sliding_min((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64) & _PLACE, length - gram + 1)
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            start = np.flatnonzero(doc[: len(least)] == doc[length - 1 :])
            if not len(start):
                continue
            at = (least[start] & _PLACE).astype(np.int64)
            head = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1))
            first, last = start[head], start[np.append(head[1:], len(start)) - 1]
            own = doc[first]
            anchor, place, raw = grams[at[head]], first - offsets[own], data.tobytes()
            t, u = names(data, offsets)[own].T
            h1, h2 = digests([raw[a:b] for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)]).T
            # Of equal pieces one goes on with their number. The others are known to be repeated, and spread over all tasks.
            order = np.lexsort((h2, h1, anchor))
            new = np.ones(len(order), bool)
            new[1:] = (anchor[order[1:]] != anchor[order[:-1]]) | (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
            times = np.zeros(len(order), np.int64)
            times[order[new]] = np.diff(np.append(np.flatnonzero(new), len(order)))
            # So are those that this task has sent twice: a piece in all texts is two rows for each task under its anchor.
            for k in np.flatnonzero(times).tolist():
                name = h1[k], h2[k]
                if name in twice:
                    times[k] = 0
                elif name in once or times[k] > 1:
                    twice.add(name)
                else:
                    once.add(name)
            if len(once) + len(twice) > SEEN:
                once.clear()
                twice.clear()
            anchor = np.where(times > 0, anchor, mix(t.astype(np.uint64) + place.astype(np.uint64)))
            columns = [anchor.view(np.int64), t, u, place, last - first + 1, at[head] - first, h1, h2, times]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], [x.split()[0] for x in _RUN.split(", ")])

    return run


def whole_groups(batches, key: str, limit: int):
    """Tables of about ``limit`` rows or more of a sorted stream, in which no group of equal keys is cut."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= limit:
            table = pa.Table.from_batches(held).combine_chunks()
            last = table.column(key)[-1].as_py()
            cut = pc.index(table.column(key), pa.scalar(last, table.schema.field(key).type)).as_py()
            if cut:
                yield table.slice(0, cut)
                rest = table.slice(cut)
                held, n = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _shared(batches):
    """Runs whose anchor or piece occurs twice; of a very large group the parts that are at hand pass as they are."""
    held: list[pa.RecordBatch] = []
    known = None  # an anchor of which rows have passed already

    def twice(table: pa.Table) -> list[pa.RecordBatch]:
        anchor = table.column("anchor").to_numpy()
        same = anchor[1:] == anchor[:-1]
        keep = table.column("times").to_numpy() != 1
        if known is not None:
            keep |= anchor == known
        keep[1:] |= same
        keep[:-1] |= same
        return table.filter(pa.array(keep)).to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        anchor = table.column("anchor").to_numpy()
        cut = int(np.searchsorted(anchor, anchor[-1]))
        if cut == 0 and len(anchor) > 1:
            # One anchor all through, more than once: all rows but the last pass, and that waits for the next batch.
            cut, known = len(anchor) - 1, anchor[-1]
            yield from table.slice(0, cut).to_batches()
        else:
            yield from twice(table.slice(0, cut))
        held = table.slice(cut).to_batches()
    if held:
        yield from twice(pa.Table.from_batches(held).combine_chunks())


def suffix_order(data: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """The order of the windows at ``place`` (ascending) by their ``length`` bytes, by two-stage sorting.

    A window smaller than the next byte's window is sorted directly, a greater
    one is induced. In each bucket of a first byte the induced windows come
    first, in the order of their successors.
    """
    n = len(place)
    change = np.append(np.where(data[1:] != data[:-1], np.arange(len(data) - 1), len(data)), len(data))
    change = np.minimum.accumulate(change[::-1])[::-1][place]
    inner = change - place < length - 1
    falls = np.zeros(n, bool)
    falls[inner] = data[change[inner]] > data[change[inner] + 1]
    induced = falls & np.append(np.diff(place) == 1, False)
    raw, byte = data.tobytes(), data[place].astype(np.int64)
    window = lambda k: raw[place[k] : place[k] + length]

    def directly(which: np.ndarray) -> np.ndarray:
        keys = [raw[p : p + length] for p in place[which].tolist()]
        return which[sorted(range(len(which)), key=keys.__getitem__)]

    def merged(now: np.ndarray, more: np.ndarray) -> np.ndarray:
        if not len(more) or not len(now):
            return now if len(now) else more
        return np.insert(now, [bisect.bisect_left(range(len(now)), window(k), key=lambda x: window(now[x])) for k in more.tolist()], more)

    rising = directly(np.flatnonzero(~falls))
    # The last window of a piece has no successor here: if it falls, it joins the induced ones by its bytes.
    last = directly(np.flatnonzero(falls & ~induced))
    length_of_run = change[last] - place[last]
    rises, lasts = np.searchsorted(byte[rising], np.arange(257)), np.searchsorted(byte[last], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        own, runs = last[lasts[c] : lasts[c + 1]], length_of_run[lasts[c] : lasts[c + 1]]
        now = merged(np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64), own[runs == 0])
        parts, level, deepest = [now], 0, int(runs.max(initial=0))
        while len(now) or level < deepest:  # windows of this bucket whose predecessors stand in it, too
            level += 1
            before = now[now > 0] - 1
            now = merged(before[induced[before] & (byte[before] == c)], own[runs == level])
            parts.append(now)
        bucket = np.concatenate([*parts, rising[rises[c] : rises[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced[before] & (byte[before] > c)]
        if len(before):
            by = byte[before]
            order = np.argsort(by, kind="stable")
            values, heads = np.unique(by[order], return_index=True)
            for v, part in zip(values.tolist(), np.split(before[order], heads[1:]), strict=True):
                waiting[v].append(part)
    return np.concatenate(out)


def common_prefixes(data: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """The common prefixes, of ``length`` bytes at most, of each window with the next one in this order."""
    out = np.zeros(max(len(places) - 1, 0), np.int64)
    alive = np.arange(len(out))
    words = np.ndarray((max(len(data) - 7, 0),), "<u8", data.tobytes(), 0, (1,)) if len(data) >= 8 else np.zeros(0, "<u8")
    for k in range(length // 8):
        same = words[places[alive] + 8 * k] == words[places[alive + 1] + 8 * k]
        out[alive[same]] += 8
        rest = alive[~same]
        for j in range(8):
            rest = rest[data[places[rest] + 8 * k + j] == data[places[rest + 1] + 8 * k + j]]
            out[rest] += 1
        alive = alive[same]
    for k in range(length // 8 * 8, length):
        alive = alive[data[places[alive] + k] == data[places[alive + 1] + k]]
        out[alive] += 1
    return out


def _ranges(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"lo": int(a), "hi": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def repeated_windows(data: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """For each byte of the pieces laid end to end, whether a repeated window starts there."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    place = np.flatnonzero(doc[: max(len(data) - length + 1, 0)] == doc[length - 1 :]) if len(data) >= length else np.zeros(0, np.int64)
    flags = np.zeros(len(data), bool)
    if len(place):
        order = place[suffix_order(data, place, length)]
        again = common_prefixes(data, order, length) >= length
        flags[order[1:][again]] = True
        flags[order[:-1][again]] = True
    return flags


def _sorted(length: int):
    def run(batches):
        for table in whole_groups(batches, "anchor", 1500):
            data, offsets = utf8(table.column("piece").combine_chunks())
            ends = np.searchsorted(table.column("anchor").to_numpy(), np.unique(table.column("anchor").to_numpy()), "right")
            begin = 0
            while begin < table.num_rows:  # groups of about SORTED bytes
                stop = int(ends[min(np.searchsorted(ends, np.searchsorted(offsets, offsets[begin] + 3 * SORTED)), len(ends) - 1)])
                if stop <= begin:
                    stop = int(ends[np.searchsorted(ends, begin, "right")])
                flags = repeated_windows(data[offsets[begin] : offsets[stop]], offsets[begin : stop + 1] - offsets[begin], length)
                part = table.slice(begin, stop - begin)
                found = [_ranges(flags[offsets[begin + k] - offsets[begin] : offsets[begin + k + 1] - offsets[begin]]) for k in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).combine_chunks() for c in ("t", "u", "first")), pa.array(found, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))], ["t", "u", "first", "ranges"]
                )
                begin = stop

    return run


def _cut(text: str):
    """Pieces out of texts that are joined with the runs wanted of them."""
    kinds = [pa.int64()] * 8 + [pa.binary()]

    def run(batches):
        for rows, data, offsets in slices(batches, text):
            names_, out = zip(rows.column("t").to_pylist(), rows.column("u").to_pylist(), strict=True), []
            for d, ((t, u), wanted) in enumerate(zip(names_, rows.column("wanted").to_pylist(), strict=True)):
                body = data[offsets[d] : offsets[d + 1]].tobytes()
                out += [(w["anchor"], t, u, w["first"], w["n"], w["d"], w["h1"], w["h2"], body[w["first"] : w["first"] + w["bytes"]]) for w in wanted]
            for k in range(0, len(out), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out[k : k + 5000], strict=True), kinds, strict=True)], [x.split()[0] for x in _PART.split(", ")])

    return run


def _split(length: int, gram: int, level: int):
    """Pieces cut by where in the window the anchor stands, under names of the bytes that all windows of a part hold around it."""
    places, parts = length - gram + 1, 1 << level
    edges = [places * k // parts for k in range(parts + 1)]
    kinds = [pa.int64()] * 8 + [pa.binary()]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                out = []
                for row in batch.slice(start, 1000).to_pylist():
                    piece, n, d = row["piece"], row["n"], row["d"]
                    for k in range(bisect.bisect_right(edges, d - n + 1) - 1, bisect.bisect_right(edges, d)):
                        low, high = max(edges[k], d - n + 1), min(edges[k + 1], d + 1)  # places of the anchor in windows of this part
                        if low >= high:
                            continue
                        a, b = d - high + 1, d - low
                        around = piece[d - edges[k] : d - edges[k + 1] + 1 + length]
                        own = piece[a : b + length]
                        name = int.from_bytes(hashlib.blake2b(around, digest_size=8, salt=k.to_bytes(4, "little")).digest(), "little", signed=True)
                        out.append((name, row["t"], row["u"], row["first"] + a, b - a + 1, d - a, *digests([own])[0].tolist(), own))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in _PART.split(", ")])

    return run


def _named(text: str):
    def run(batches):
        for rows, data, offsets in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(c) for c in names(data, offsets).T)], [*rows.schema.names, "t", "u"])

    return run


def _without(key: str, text: str, length: int):
    def run(batches):
        for rows, data, offsets in slices(batches, text):
            removed, spans, shas, kept = [], [], [], []
            for d, ranges in enumerate(rows.column("ranges").to_pylist()):
                body = data[offsets[d] : offsets[d + 1]]
                edge = np.zeros(len(body) + 1, np.int64)
                if ranges:
                    np.add.at(edge, [r["lo"] for r in ranges], 1)
                    np.add.at(edge, [r["hi"] + length - 1 for r in ranges], -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                kept.append(body[~gone].tobytes())
                shas.append(hashlib.sha256(kept[-1]).hexdigest())
            columns = [rows.column(key), pa.array(np.diff(offsets).astype(np.int64)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _sizes(pieces: DataFrame) -> DataFrame:
    """``anchor, kinds``: how many different pieces an anchor has, if more than one."""
    return pieces.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1")


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256, kept binary`` for each document."""
    scratch = Scratch(docs.sparkSession, "repeats")
    kind = docs.schema[key].dataType.simpleString()
    docs = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    runs = docs.select("_text").mapInArrow(_runs("_text", length, gram), _RUN).repartition("anchor").sortWithinPartitions("anchor")
    runs = scratch.write(runs.mapInArrow(_shared, _RUN), "runs")
    own = runs.filter("times > 0")
    same = ["anchor", "h1", "h2"]
    pieces = own.groupBy(*same).agg(F.sum("times").alias("times"), F.min(F.struct("t", "u", "first", "n", "d")).alias("one"))
    pieces = scratch.write(pieces.select(*same, "times", "one.*"), "pieces")
    sizes = scratch.write(_sizes(pieces), "sizes")
    wanted = pieces.join(sizes.hint("merge"), "anchor")
    by_text = wanted.groupBy("t", "u").agg(F.collect_list(F.struct("anchor", "first", "n", "d", "h1", "h2", (F.col("n") + length - 1).alias("bytes"))).alias("wanted"))

    named = docs.mapInArrow(_named("_text"), f"_id {kind}, _text string, t long, u long")
    # Of equal texts one is enough, and tasks drop the others before the shuffle; which one doesn't matter.
    having = named.select("t", "u", "_text").dropDuplicates(["t", "u"]).join(by_text.hint("merge"), ["t", "u"])
    cut = having.mapInArrow(_cut("_text"), _PART)
    span = lambda rows: rows.select("t", "u", F.col("first").alias("lo"), (F.col("first") + F.col("n")).alias("hi"))
    again = own.join(pieces.filter("times > 1").select(*same).hint("merge"), same).select(runs.columns).unionByName(runs.filter("times = 0"))
    parts, level = [span(again)], 0
    while True:
        crowds = scratch.write(sizes.filter(F.col("kinds") > CROWD).select("anchor"), "crowds")
        crowded = bool(crowds.head(1))
        if crowded:
            cut = scratch.write(cut, "cut")
        usual = cut.join(crowds.hint("merge"), "anchor", "left_anti") if crowded else cut
        ordered = usual.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sorted(length), f"t long, u long, first long, ranges {_RANGES}")
        found = ordered.select("t", "u", "first", F.inline("ranges"))
        here = found.select("t", "u", (F.col("lo") + F.col("first")).alias("lo"), (F.col("hi") + F.col("first")).alias("hi"))
        parts.append(scratch.write(here, "found") if crowded or level else here)
        if not crowded:
            break
        level += _HALVINGS
        split = scratch.write(cut.join(crowds.hint("merge"), "anchor", "left_semi").mapInArrow(_split(length, gram, level), _PART), "split")
        kinds = scratch.write(split.groupBy(*same).agg(F.count("*").alias("times"), F.min(F.struct("t", "u", "first")).alias("one")).select(*same, "times", "one.*"), "kinds")
        parts.append(scratch.write(span(split.join(kinds.filter("times > 1").select(*same).hint("merge"), same)), "equal"))
        sizes = scratch.write(_sizes(kinds), "sizes")
        cut = split.join(kinds.join(sizes.hint("merge"), "anchor").select(*same, "t", "u", "first").hint("merge"), [*same, "t", "u", "first"]).select(split.columns)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # Copies of a text bring the same ranges; without repeats a text has fewer of them than bytes.
    marks = scratch.write(every.distinct().groupBy("t", "u").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")), "marks")
    marked = named.join(marks.hint("merge"), ["t", "u"], "left").select(F.col("_id").alias(key), "_text", "ranges")
    return marked.mapInArrow(_without(key, "_text", length), f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
