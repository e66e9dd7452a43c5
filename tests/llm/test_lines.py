"""Groups of lines against all edit distances; the distance against its definition."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import lines as L
from lodestone.llm import registry
from tests.llm.test_minhash import roots, twins
from tests.oracle import same


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def within(a, b, most):
    """Whether the distance is at most ``most``: only cells that near the diagonal count."""
    old = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        row = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            row[j] = min(old.get(j, 99) + 1, row.get(j - 1, 99) + 1, old.get(j - 1, 99) + (j == 0 or x != b[j - 1]))
        if min(row.values()) > most:
            return False
        old = row
    return old.get(len(b), 99) <= most


def brute(docs, edits, least):
    every = sorted({x for d, t in docs if d is not None for x in (t or "").split("\n") if len(x) >= least})
    links = [(a, b) for k, a in enumerate(every) for b in every[k + 1 :] if abs(len(a) - len(b)) <= edits and within(a, b, edits)]
    root = roots(every, links)
    first = {}
    for d, t in sorted((x for x in docs if x[0] is not None), key=lambda x: x[0]):
        for k, x in enumerate((t or "").split("\n")):
            if len(x) >= least:
                first.setdefault(root[x], (d, k))
    out = []
    for d, t in docs:
        own = [] if t is None else t.split("\n")
        kept = [x for k, x in enumerate(own) if d is None or len(x) < least or first[root[x]] == (d, k)]
        out.append((d, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def changed(rng, text, edits):
    for _ in range(edits):
        k = rng.randrange(len(text) + 1)
        text = rng.choice([text[:k] + text[k + 1 :], text[:k] + rng.choice("abé") + text[k:], text[:k] + rng.choice("xyz") + text[k + 1 :]])
    return text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abé", min_size=1, max_size=30), st.integers(0, 5), st.randoms()), max_size=6), st.integers(0, 5))
def test_edit_distance(cases, most):
    pairs = [(a, changed(r, a, n)) for a, n, r in cases] + [("abcabcabc", "abcabcabc"), ("abcabcabc", "cabcabcab"), ("a" * 20, "b" * 20)]
    got = L.edit_distances([a for a, _ in pairs], [b for _, b in pairs], most)
    assert got.tolist() == [min(distance(a, b), most + 1) for a, b in pairs]


def test_linked_lines_share_a_bucket():
    rng = random.Random(2)
    for edits in (1, 2, 3, 4):
        for _ in range(150):
            a = "".join(rng.choices("abcde", k=rng.randrange(12, 40)))
            b = changed(rng, a, rng.randrange(edits + 1))
            if len(b) < 12 or a == b or distance(a, b) > edits:
                continue
            lines = L.Lines([a, b], 12)
            line, bucket, indexed = L.bucket_keys(lines, np.arange(2), edits, 12)
            one, two = ({(k, i) for x, k, i in zip(line, bucket, indexed, strict=True) if x == n} for n in (0, 1))
            keys = lambda s, only: {k for k, i in s if i or not only}
            assert keys(one, True) & keys(two, False) or keys(one, False) & keys(two, True), (a, b)


def family(rng, n):
    base = "".join(rng.choices("abcdefgh é", k=rng.randrange(12, 50)))
    return [changed(rng, base, rng.randrange(4)) for _ in range(n)]


@pytest.mark.parametrize("edits, small, bound", [(2, 16, 10**6), (2, 2, 0), (1, 2, 10**6), (3, 16, 0)])
def test_groups(spark, monkeypatch, edits, small, bound):
    monkeypatch.setattr(L, "SMALL_BUCKET", small)
    monkeypatch.setattr(L, "BLOCK", 3)
    monkeypatch.setattr(L, "HUBS", 1)
    monkeypatch.setattr(L, "BROADCAST_BYTES", bound)
    rng = random.Random(edits * 10 + small)
    pool = [x for _ in range(14) for x in family(rng, rng.randrange(1, 9))] + ["short", "", "ab"]
    docs = [(k * 3, "\n".join(rng.choices(pool, k=rng.randrange(1, 7)))) for k in range(40)]
    docs += [(500, None), (501, ""), (502, "\n\n"), (None, pool[0]), (None, None), (503, "long " * 4000), (504, "long " * 4000 + "x"), (0, docs[0][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS id", "1 AS line_no", "2 AS _key", "3 AS root", "4 AS h1").repartition(5)
    assert sorted(map(tuple, L.counts(frame, edits, 12).collect()), key=str) == brute(docs, edits, 12)
    kept = L.dedup(frame, edits, 12)
    assert kept.columns == [*frame.columns, "_gone"] and kept.count() == len(docs)


def test_stream_of_buckets(spark):
    rows = [(k // 3, k % 3 if k % 2 else 0, k % 5 == 0) for k in range(400)]
    frame = spark.createDataFrame(rows, "bucket long, id long, indexed boolean").coalesce(1).sortWithinPartitions("bucket", "id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r.bucket for r in frame.mapInArrow(L._shared, frame.schema).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {b for b, _, _ in rows if len({i for x, i, _ in rows if x == b}) > 1 and any(n for x, _, n in rows if x == b)}
    assert got == want


@pytest.mark.parametrize("tail", [[(7, k, False) for k in range(30, 39)], [(7, 99, True)] * 4])
def test_large_bucket_passes_whole(monkeypatch, tail):
    """A bucket above the bound keeps its last rows, be they probes only or of one line; its neighbours are judged as ever."""
    monkeypatch.setattr(L, "HELD_ROWS", 8)
    large = [(7, k, k == 0) for k in range(30)] + tail
    rows = [(1, 1, True), (1, 2, False), (5, 1, True), *large, (8, 1, False), (8, 2, False), (9, 1, True), (9, 2, False)]
    for size in (1, 3, 5, 10, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + size], strict=True)], ["bucket", "id", "indexed"]) for k in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in L._shared(iter(batches)) for r in b.to_pylist()]
        assert got == [r for r in rows if r[0] in (1, 7, 9)]


def test_query_groups_short_equal_lines(spark, tmp_path):
    """Equal lines of any length go but their first; blank lines and short lines that only look alike stay."""
    long = "A line that is long enough to be compared by its edit distance."
    docs = [(1, "Ok.\n\nAll rights reserved.\n" + long), (2, "All rights reserved.\n\n  \nAll rights reserved!"), (3, "Ok.\n  \n" + long[:-1] + "!\nx"), (4, None), (5, "x\nOk.")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    kept = {1: docs[0][1], 2: "\n  \nAll rights reserved!", 3: "  \nx", 4: "", 5: ""}
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in registry.op3_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {d: (n, hashlib.sha256(kept[d].encode()).hexdigest()) for d, n in {1: 0, 2: 1, 3: 2, 4: 0, 5: 2}.items()}


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert L.counts(frame).count() == 0


def test_query_against_brute_force(spark):
    root = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{root}/documents.parquet").collect()]
    got = sorted(map(tuple, registry.op3_line_dedup(spark, root).collect()), key=str)
    assert got == brute_quick(docs, {x for _, t in docs for x in t.split("\n")})


def test_query_and_sql(spark):
    got = same(spark, "op3_line_dedup", registry.op3_line_dedup, registry.ORACLE["op3_line_dedup"])
    assert sum(r["n_removed"] for r in got) > 1000


def test_sql_on_near_lines(spark, tmp_path):
    """Chains of edits, also of characters of several bytes; blank, short, null and empty texts."""
    rng = random.Random(8)
    pool = [changed(rng, base, rng.randrange(4)) for base in ("".join(rng.choices("abcdefgh é€😀", k=rng.randrange(29, 60))) for _ in range(12)) for _ in range(6)]
    docs = [(k, "\n".join(rng.choices([*pool, "short", "", " \t", "\u2003", "x"], k=rng.randrange(1, 8)))) for k in range(60)] + [(90, None), (91, ""), (92, "\n")]
    spark.createDataFrame(docs, "doc_id long, text string").toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    same(spark, "op3_line_dedup", registry.op3_line_dedup, registry.ORACLE["op3_line_dedup"], str(tmp_path))


def test_twins_are_told_apart(spark):
    """Lines that a polynomial hash modulo 2**64 takes for equal."""
    x, y = twins()
    docs = [(1, f"{x}\n{y}"), (2, f"{y}\n{x}\nown line")]
    got = {r.doc_id: r.n_removed for r in L.counts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 2}


def test_column_in_the_way(spark):
    frame = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, _gone int")
    with pytest.raises(ValueError, match="_gone"):
        L.dedup(frame)
    assert L.dedup(frame, gone="removed").columns == ["doc_id", "text", "_gone", "removed"]


def brute_quick(docs, every):
    """The query's result: distances only between long lines of similar lengths that share a third of one; short lines but blank ones go if they are equal."""
    by, lines = {}, {x for x in every if len(x) >= L.MIN_CHARS}
    for x in lines:
        for n in range(len(x) - L.EDITS, len(x) + L.EDITS + 1):
            by.setdefault(n, []).append(x)
    links = []
    for x in lines:
        thirds = {x[: len(x) // 3], x[len(x) // 3 : 2 * len(x) // 3], x[2 * len(x) // 3 :]}
        links += [(x, y) for y in by.get(len(x), ()) if x < y and any(t in y for t in thirds) and within(x, y, L.EDITS)]
    root = roots(lines, links) | {x: x for x in every if len(x) < L.MIN_CHARS and x.strip()}
    first = {}
    for d, t in sorted(docs):
        for k, x in enumerate(t.split("\n")):
            if x in root:
                first.setdefault(root[x], (d, k))
    out = []
    for d, t in docs:
        own = t.split("\n")
        kept = [x for k, x in enumerate(own) if x not in root or first[root[x]] == (d, k)]
        out.append((d, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)
