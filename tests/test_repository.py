"""Paths, bodies and history: SQL on the given tables, plain computations on small ones."""

import io
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.functions import patterns as P
from lodestone.functions.literals import required
from lodestone.operators import pointers, provenance, rule_index, snapshot, text, tree
from lodestone.plans import repository
from lodestone.sources import ranges
from tests.oracle import same


@pytest.mark.parametrize("name", list(repository.QUERIES))
def test_against_sql(spark, name):
    rows = same(spark, name, repository.QUERIES[name], repository.ORACLE[name])
    assert rows
    kinds = {"ignored_paths": "ignored", "pointer_status": "status", "snapshot_merge": "change", "origin_of_events": "state", "large_rule_set": "class"}
    if name in kinds:
        assert len({r[kinds[name]] for r in rows}) > 1, Counter(r[kinds[name]] for r in rows)


# Byte ranges


def test_pieces_for_any_range():
    rng = random.Random(5)
    for _ in range(60):
        body = "".join(rng.choice(["a", "n", "=", "\n", "\n", "é", " ", "\r\n", "token = x"]) for _ in range(rng.randrange(80))).encode()
        cuts = [0] + [m.start() + 2 for m in re.finditer(rb"[^\s=n](?=\n)", body) if m.start() + 2 < len(body)]
        for width in (1, 2, 3, 7, 50, 1000):
            for size in (1, 4, 64):
                got = [p for k in range(0, len(body), width) for p in ranges.pieces(io.BytesIO(body), k, min(k + width, len(body)), size)]
                assert b"".join(p for _, p in got) == body
                assert {b for b, _ in got} <= set(cuts) and [b for b, _ in got] == sorted({b for b, _ in got})
                assert sum(len(p) for _, p in got) == len(body)
                for k in range(0, len(body), width):  # each cut opens a piece of its own range
                    own = [b for b, _ in ranges.pieces(io.BytesIO(body), k, min(k + width, len(body)), size)]
                    assert all(k <= b < k + width for b in own)


def test_memory_of_a_piece():
    """A piece is about as long as asked for, in a file much longer."""
    body = b"some words on a line here\n" * 100_000
    got = list(ranges.pieces(io.BytesIO(body), 0, len(body), 10_000))
    assert max(len(p) for _, p in got) < 25_000 and len(got) > 100
    assert [p for _, p in ranges.pieces(io.BytesIO(b"x" * 300_000), 0, 10, 1000)] == [b"x" * 300_000]
    assert list(ranges.pieces(io.BytesIO(b"x" * 300_000), 10, 20, 1000)) == []


def test_markers_over_ranges(spark, tmp_path):
    """Counts over the pieces are those over whole bodies, wherever ranges begin."""
    rng = random.Random(2)
    words = ["AKIA" + "A1" * 8, "ghp_" + "a" * 36, "sk-" + "b" * 25, "-----BEGIN RSA PRIVATE KEY-----", "token = abc", "token\n=\nabc", "token=", "= token=x", "plain", "n", "\n", "\n", "é", " ", "\r\n"]
    bodies = ["".join(rng.choice(words) + rng.choice(["", " ", "\n"]) for _ in range(400)) for _ in range(3)] + ["", "no line end token = 1"]
    for k, body in enumerate(bodies):
        (tmp_path / f"b{k}.txt").write_bytes(body.encode())
    (tmp_path / ".hidden").write_text("token = 9\n")
    whole = text.marker_scan(spark.createDataFrame([(b,) for b in bodies], "text string"))
    want = {r.family: (r.hits, r.docs) for r in whole.collect()}
    assert min(h for h, _ in want.values()) > 20
    for width, size in ((37, 16), (1000, 100), (1 << 20, 1 << 10)):
        pieces = ranges.read_pieces(spark, str(tmp_path), width, size)
        assert {r.family: (r.hits, r.bodies) for r in text.body_markers(pieces).collect()} == want
    one = ranges.read_pieces(spark, f"file://{tmp_path}/b0.txt", 500)
    assert "".join(r.text for r in one.orderBy("begin").collect()) == bodies[0]
    with pytest.raises(Exception, match="missing"):
        ranges.read_pieces(spark, f"{tmp_path}/missing").count()


# Large rule sets


@pytest.mark.parametrize(
    "pattern, literal",
    [("abc", "abc"), ("ab+cde", "cde"), ("abc?d", "ab"), ("ab*xyz", "xyz"), (r"a\.b/c", "a.b/c"), ("a|bcd", None), ("(abc|d)efg", "efg"), ("(abc)?", None), ("[abc]def$", "def"), ("^/x/y", "/x/y"), ("(?i)abc", None), (r"\d+abc", "abc"), (r"ab\Qcd", None), ("ab{2}cd", "cd"), ("a{2,}", None), (r"\babc\b", "abc"), ("a.cde", "cde"), (r"ab\x41cd", "ab"), ("", None), ("(ab", None), ("[a", None), ("abc+?de", "abc"), ("x]y", "x]y"), ("(?=ab)c", None)],
)
def test_required_literals(pattern, literal):
    assert required(pattern) == literal


def test_required_literals_are_in_every_match():
    rng = random.Random(3)
    for _ in range(3000):
        pattern = "".join(rng.choice(["a", "b", "c", "ab", "(a|b)", "[ab]", "x?", "b*", "c+", ".", r"\.", "^", "$", "(?:bc)?", r"\w", "a{0,2}", "|"]) for _ in range(rng.randrange(1, 7)))
        try:
            found = [m[0] for s in ("abcabc", "aabbcc", "x.abc", "cab.b", "bbb") if (m := re.search(pattern, s))]
        except re.error:
            continue
        literal = required(pattern)
        assert not literal or all(literal in f for f in found), (pattern, literal, found)


def test_rule_index_equals_nested_rules(spark, monkeypatch):
    rng = random.Random(8)
    parts = ["src", "node_modules", "build", "a.b", "lib", "x", "données", "tmp"]
    paths = ["/".join(rng.choice(parts) + rng.choice(["", str(rng.randrange(5))]) for _ in range(rng.randrange(1, 5))) for _ in range(400)] + [None, "", "ab"]
    rules = [(k, f"c{rng.randrange(6)}", p) for k, p in enumerate(["^lib$", "node_modules/.*build", r"(^|/)tmp[0-3]/", "src1|src2", "x", r"a\.b4", "données", "[x]0", "^$", r"(?i)BUILD2"] + [f"{rng.choice(parts[:5])}{k}/" for k in range(5)])]
    rng.shuffle(rules)
    frame = spark.createDataFrame(rules, "priority int, class string, pattern string").unionByName(spark.createDataFrame([(None, "n", "x"), (3, "n", None)], "priority int, class string, pattern string"))
    items = spark.createDataFrame([(p,) for p in paths], "path string").selectExpr("path", "1 AS n", "'k' AS key", "'c' AS class")
    ordered = sorted(rules)
    want = Counter(next((c for _, c, p in ordered if path is not None and re.search(p, path)), "kept") for path in paths)
    assert len(want) > 3
    plain = lambda frame: {r["class"]: r.n for r in frame.collect()}
    assert plain(rule_index.class_counts(items, frame)) == want
    assert plain(rule_index.class_counts(items, frame.limit(0))) == {"kept": len(paths)} and rule_index.class_counts(items.limit(0), frame).collect() == []
    monkeypatch.setattr(rule_index, "BROADCAST_BYTES", -1)
    assert plain(rule_index.class_counts(items, frame)) == want


def test_plan_does_not_grow_with_the_rules(spark):
    items = spark.createDataFrame([("a/b",)], "path string")
    sizes = []  # an expression for each length of a key, of which there are six at most
    for n in (1_000, 20_000, 200_000):
        rules = spark.range(n).selectExpr("id AS priority", "'c' AS class", "concat('dir', id, '/') AS pattern")
        sizes.append(len(rule_index.classify(items, rules)._jdf.queryExecution().optimizedPlan().toString()))
    assert max(sizes) < 4_000 and sizes[2] - sizes[1] < 200


# Pointers


def test_pointers(spark):
    body = "the body"
    oid = __import__("hashlib").sha256(body.encode()).hexdigest()
    head = "version https://git-lfs.github.com/spec/v1\n"
    rows = [(1, f"{head}oid sha256:{oid}\nsize 8\n"), (2, f"{head}oid sha256:{oid}\nsize 9\n"), (3, f"{head}oid sha256:{'0' * 64}\nsize 8\n"), (4, f"{head}size 8\n"), (5, "text"), (6, None), (1, f"{head}oid sha256:{oid}\nsize 8\n"), (7, f"{head}oid sha256:{oid}\nsize x\n"), (None, f"{head}ext-0-foo sha256:{'1' * 64}\noid sha256:{oid}\nsize 8\n")]
    stored = spark.createDataFrame([(body,), (body,), (None,), ("other",)], "oid string")
    got = pointers.resolve(spark.createDataFrame(rows, "id long, text string"), stored, "id", "text", "oid").collect()
    assert sorted((r.id or 0, r.status, r.copies) for r in got) == [(0, "resolved", 2), (1, "resolved", 2), (1, "resolved", 2), (2, "size_differs", 2), (3, "missing", 0), (4, "malformed", 0), (5, "no_pointer", 0), (6, "no_pointer", 0), (7, "malformed", 2)]
    assert pointers.resolve(spark.createDataFrame(rows, "id long, text string").limit(0), stored.limit(0), "id", "text", "oid").collect() == []


def test_hot_pointer(spark):
    """Most pointers name one body."""
    many = spark.range(5000).selectExpr("id", "concat('version https://git-lfs.github.com/spec/v1\noid sha256:', sha2(if(id % 10 = 0, cast(id AS string), 'x'), 256), '\nsize 1\n') AS text")
    stored = spark.range(3000).selectExpr("'x' AS body")
    got = pointers.resolve(many, stored, "id", "text", "body").groupBy("status", "copies").count().collect()
    assert {tuple(r) for r in got} == {("resolved", 3000, 4500), ("missing", 0, 500)}


# Directories


def test_directory_sizes(spark):
    files = [("a/b/c.txt", 5), ("a/b/d.txt", 7), ("a/e.txt", 1), ("/f.txt", 2), ("a//b/g", None), (None, 3), ("x/.git/h/i", 100), ("a/b/c.txt", 5), ("é/k/", 4)]
    frame = spark.createDataFrame(files, "path string, n long").selectExpr("*", "1 AS directory", "2 AS bytes")
    got = {r.directory: (r.depth, r.files, r.bytes) for r in tree.directory_sizes(frame, F.col("n"), without=(".git",)).collect()}
    assert got == {"": (0, 8, 27), "a": (1, 5, 18), "a/b": (2, 3, 17), "a//b": (2, 1, 0), "é": (1, 1, 4)}
    assert tree.directory_sizes(frame.limit(0), F.col("n")).collect() == []


def test_directory_sizes_against_plain_sums(spark):
    rng = random.Random(4)
    files = [("/".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))), rng.randrange(100)) for _ in range(500)]
    want = defaultdict(lambda: [0, 0])
    for path, n in files:
        parts = path.split("/")[:-1]
        for k in range(len(parts) + 1):
            want["/".join(parts[:k])][0] += 1
            want["/".join(parts[:k])][1] += n
    got = tree.directory_sizes(spark.createDataFrame(files, "path string, n long").repartition(7), F.col("n")).collect()
    assert {r.directory: [r.files, r.bytes] for r in got} == want and len(got) == len(want)


def test_nearest_licence(spark):
    paths = ["LICENSE", "a/x", "a/b/COPYING.txt", "a/b/LICENCE", "a/b/y", "a/b/c/z", "a/b/c/licensed.py", "d/e", None, "top", "a/x"]
    frame = spark.createDataFrame([(p,) for p in paths], "path string").selectExpr("path", "1 AS directory", "'l' AS licence")
    got = sorted(((r.path or "", r.licence) for r in tree.nearest_licence(frame).collect()), key=repr)
    best = "a/b/COPYING.txt"
    assert got == sorted([("LICENSE", "LICENSE"), ("a/x", "LICENSE"), ("a/x", "LICENSE"), (best, best), ("a/b/LICENCE", best), ("a/b/y", best), ("a/b/c/z", best), ("a/b/c/licensed.py", best), ("d/e", "LICENSE"), ("", None), ("top", "LICENSE")], key=repr)
    assert {r.licence for r in tree.nearest_licence(spark.createDataFrame([("a/b",)], "path string")).collect()} == {None}
    assert tree.nearest_licence(frame.limit(0)).collect() == []


# Snapshots


def merged(base, log, **more):
    out = snapshot.merge_log(base, log, ["k"], ["seq"], F.col("op") == "d", **more)
    return sorted(((r.k, r.v, r.change) for r in out.collect()), key=repr)


def test_merge_log(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (None, "n"), (5, "e"), (5, "f")], "k long, v string")
    log = spark.createDataFrame(
        [(10, 1, "a1", "u", False), (12, 1, "a2", "u", True), (11, 1, "late", "u", False), (12, 1, "a2", "u", True), (13, 2, None, "d", False), (14, 6, "new", "u", True), (15, 7, "gone", "u", False), (16, 7, None, "d", False), (17, 3, "c1", "u", False), (17, 3, None, "d", True), (18, None, "n1", "u", True), (19, 4, "tail", "u", False), (5, 4, "old", "u", True)],
        "seq long, k long, v string, op string, done boolean",
    )
    want = [(1, "a2", "updated"), (3, "c1", "updated"), (4, "d", "unchanged"), (5, "f", "unchanged"), (6, "new", "inserted"), (None, "n1", "updated")]
    assert merged(base, log, commits=F.col("done"), since=F.col("seq") > 9) == sorted(want, key=repr)
    assert (4, "tail", "updated") in merged(base, log) and (4, "old", "updated") in merged(base, log, commits=F.col("done"))
    assert merged(base, log, commits=F.lit(False)) == merged(base, log.limit(0)) == sorted([(1, "a", "unchanged"), (2, "b", "unchanged"), (3, "c", "unchanged"), (4, "d", "unchanged"), (5, "f", "unchanged"), (None, "n", "unchanged")], key=repr)
    assert merged(base.limit(0), log.limit(0)) == []
    shuffled = log.repartition(5).orderBy(F.rand(3))
    assert merged(base, shuffled, commits=F.col("done"), since=F.col("seq") > 9) == sorted(want, key=repr)
    out = snapshot.merge_log(base, log, ["k"], ["seq"], F.col("op") == "d", F.col("done"), F.col("seq") > 9)
    assert {r.change: r.n for r in snapshot.merge_summary(base, out, ["k"]).collect()} == {"updated": 3, "unchanged": 2, "inserted": 1, "deleted": 1}


def test_merge_log_with_clashing_and_map_columns(spark):
    base = spark.createDataFrame([(1, "a")], "k long, v string").selectExpr("*", "map('x', k) AS m", "1 AS place", "'s' AS stays", "2 AS row", "3 AS top", "4 AS old")
    log = base.selectExpr("k", "'b' AS v", "map('y', 2L) AS m", "place", "stays", "row", "top", "old", "7 AS seq", "'u' AS op")
    out = snapshot.merge_log(base, log, ["k"], ["seq"], F.col("op") == "d").collect()
    assert [(r.v, r.m, r.place, r.stays, r.change) for r in out] == [("b", {"y": 2}, 1, "s", "updated")]


# Provenance


def plain_origins(rows):
    source = {}
    for k, s in rows:
        if k is not None:
            source[k] = min((x for x in (source.get(k), s) if x is not None), default=None)
    out = {}
    for k in source:
        at, seen = k, []
        while True:
            if at in seen:
                out[k] = ("cycle", min(seen[seen.index(at) :]), None)
                break
            seen.append(at)
            to = source[at]
            if to is None or to not in source:
                out[k] = ("rooted" if to is None else "broken", at, len(seen) - 1)
                break
            at = to
    return out


def traced(frame):
    return {r.id: (r.state, r.origin, r.hops) for r in provenance.origins(frame, "id", "source").collect()}


def test_origins(spark):
    rng = random.Random(7)
    chain = [(k, k - 1 if k > 100 else None) for k in range(100, 180)]  # 79 hops
    star = [(k, 100) for k in range(300, 400)]
    circles = [(1, 2), (2, 3), (3, 1), (4, 4), (5, 3), (6, 5), (7, 6)]
    broken = [(8, 9999), (9, 8), (None, 8), (10, None), (10, 9), (10, 12), (11, 11)]
    rand = [(k, rng.choice([None, 777777, *range(1000, 1200)])) for k in range(1000, 1200)]
    rows = chain + star + circles + broken + rand
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "id long, source long").selectExpr("*", "1 AS at", "'x' AS state", "2 AS least")
    got = traced(frame)
    assert got == plain_origins(rows) and {s for s, _, _ in got.values()} == {"rooted", "broken", "cycle"}
    assert {r.state: r.deepest for r in provenance.origin_summary(provenance.origins(frame, "id", "source")).collect()}["rooted"] >= 79
    assert traced(spark.createDataFrame(chain + star, "id long, source long")) == plain_origins(chain + star)
    assert traced(frame.limit(0)) == {}


def test_rounds_grow_as_the_logarithm(spark, monkeypatch):
    rounds = []
    write = provenance.Scratch.write
    monkeypatch.setattr(provenance.Scratch, "write", lambda self, frame, name="step": (rounds.append(name), write(self, frame, name))[1])
    for n in (8, 64):
        rounds.clear()
        provenance.origins(spark.createDataFrame([(k, k - 1 if k else None) for k in range(n)], "id long, source long"), "id", "source")
        assert rounds.count("round") <= 2 + n.bit_length()


# Scratch tables


def test_scratch_needs_a_shared_folder_on_a_cluster():
    """Without one, only an all-local session gets a folder of its own."""
    from types import SimpleNamespace as N

    from lodestone.sources.scratch import folder

    settings = {}
    session = lambda master, given=None: N(sparkContext=N(master=master, getConf=lambda: N(get=lambda k: given)), conf=N(get=lambda k, d=None: settings.get(k, d), set=settings.__setitem__))
    assert folder(session("spark://host:7077", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(ValueError, match="checkpoint"):
        folder(session("spark://host:7077"))
    assert folder(session("local[2]")).startswith("file:///") and settings["spark.checkpoint.dir"]
