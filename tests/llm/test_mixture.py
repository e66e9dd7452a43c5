"""The mix against a plain computation of targets and streams, and the schedule's evenness."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

from lodestone.llm import mixture as M
from lodestone.llm import registry
from tests.oracle import same


def plain_targets(sizes, weights=(3, 1, 2), percent=150, repeats=2):
    """Shares by weight; what is above the cap is reshared until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, out, open_ = Fraction(percent * sum(sizes.values()), 100), {}, set(names)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] >= repeats * sizes[s]}
        if not full:
            out |= {s: unit * weight[s] for s in open_}
            break
        out |= {s: Fraction(repeats * sizes[s]) for s in full}
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def brute(docs, **options):
    sized = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, s, t in docs]
    sizes = Counter()
    for _, s, n in sized:
        sizes[s] += n
    goal, at, out = plain_targets(sizes, **options), defaultdict(int), []
    for d, s, n in sorted(sized, key=lambda r: (hashlib.md5(f"mix:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:15], r[0] is not None, r[0] or 0, r[2])):
        start, words = at[s], int(goal[s])
        at[s] += n
        out.append((d, n, sizes[s], float(goal[s]), sum(max(0, min(start + k * sizes[s] + n, words) - start - k * sizes[s]) for k in range(2))))
    return out


def close(got, want):
    key = lambda r: (repr(r[0]), r[1], r[2], r[4])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert all(abs(a[3] - b[3]) <= 1e-9 * max(1, b[3]) for a, b in zip(got, want, strict=True))


def cases():
    rng = random.Random(8)
    docs = [(k, rng.choice(["big", "big", "big", "É", "a", None, "z", "B"]), "w " * rng.choice([1, 5, 40, 300])) for k in range(200)]
    docs += [(300, "tiny", "one"), (301, "none", " \t"), (302, "big", None), (303, "a", ""), (304, "big", "x " * 5000), (None, "a", "no id"), (None, "a", "no id"), (7, "a", "again 7"), (7, "a", "again 7"), (7, "a", "again 7 and more")]
    return docs


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, source string, text string").selectExpr("*", "1 AS size", "'x' AS own", "map('a', 1) AS no", "2 AS target").repartition(4)


def test_against_brute_force(spark):
    docs = cases()
    for block in (1024, 16):
        close(M.mix(frame(spark, docs), block=block).taken().collect(), brute(docs))
    assert {r[4] for r in brute(docs) if r[0] == 300} == {2}
    wide = M.mix(frame(spark, docs), slots=7)
    assert wide.block > 1024 and wide.slots <= 7 + 8
    close(wide.taken().collect(), brute(docs))


def test_targets(spark):
    """Many sources, most of them at their cap, in any order."""
    rng = random.Random(2)
    for n in (1, 2, 3, 40):
        sizes = {f"s{k}": rng.choice([0, 1, 10, 1000, 123456]) for k in range(n)} | {None: 77}
        table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        for options in ({}, {"weights": (1,)}, {"percent": 190}, {"percent": 30, "repeats": 1, "weights": (5, 1)}):
            got = {r.source: r.target for r in M.targets(table, **options).collect()}
            want = plain_targets(sizes, **options)
            assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-9 * max(1, want[s]) for s in want)


def test_schedule(spark, monkeypatch):
    """Each block of each source once, in order; every stretch of the mix is near the shares; pieces fill the blocks."""
    monkeypatch.setattr(M, "BUCKET", 50)
    monkeypatch.setattr(M, "CHUNK", 7)
    mix = M.mix(frame(spark, cases()), block=16)
    rows = sorted((r.slot, r.no, r.block) for r in mix.schedule().collect())
    quota = {r.no: r.quota for r in mix.sources.collect()}
    assert [r[0] for r in rows] == list(range(mix.slots))
    seen = Counter()
    for slot, no, block in rows:
        assert block == seen[no]
        seen[no] += 1
        assert all(abs(seen[s] - (slot + 1) * q / mix.slots) <= 4 for s, q in quota.items())
    assert all(seen[s] == q for s, q in quota.items())
    words = Counter()
    for r in mix.pieces().collect():
        words[r.no, r.block] += r.n
    goal = {r.no: int(r.target) for r in mix.sources.collect()}
    assert all(n == min(16, goal[s] - 16 * b) for (s, b), n in words.items()) and len(words) == mix.slots
    close(mix.taken().collect(), brute(cases()))


def test_reruns_and_partitions(spark):
    docs = cases()
    a, b = (M.mix(frame(spark, d).repartition(n), block=32) for d, n in ((docs, 1), (docs[::-1], 7)))
    same_ = [sorted((r.slot, r.block, r.doc_id or -1, r.first, r.n) for r in m.rows().collect()) for m in (a, b)]
    assert same_[0] == same_[1] and len(same_[0]) > 400


def test_native(spark):
    """No Python worker takes part."""
    plan = M.mix(frame(spark, cases())).taken()._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    mix = M.mix(none)
    assert mix.taken().collect() == [] and mix.rows().collect() == []
    assert [tuple(r) for r in M.mix(spark.createDataFrame([(1, None, None)], none.schema)).taken().collect()] == [(1, 0, 0, 0.0, 0)]


def test_query(spark):
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = registry.op12_source_mix(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    close(got.collect(), brute(docs))


def test_against_sql(spark):
    same(spark, "op12_source_mix", registry.QUERIES["op12_source_mix"], registry.ORACLE["op12_source_mix"])
