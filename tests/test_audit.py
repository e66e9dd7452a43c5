"""Every audit query against DuckDB, and literal cases for what the tables never hold."""

import time

import pytest
from pyspark.sql import functions as F

from lodestone.functions import patterns as P
from lodestone.operators import lineage, listing, text
from lodestone.plans import audit
from lodestone.sources import tables
from lodestone.streaming import audit as streaming
from tests.oracle import same

BIG = "A" * 16
MUST = {
    "aws_access_key": ["AK" + "IA" + BIG],
    "github_token": ["gh" + "p_" + "a1" * 18],
    "openai_key": ["s" + "k-" + "x" * 24],
    "private_key": ["-----BEGIN " + "PRIVATE KEY-----", "-----BEGIN RSA " + "PRIVATE KEY-----"],
    "assigned_token": ['token = "zz"'],
}
MUST_NOT = {
    "aws_access_key": ["AK" + "IA" + BIG[1:]],
    "github_token": ["gh" + "p_" + "a1" * 17 + "b"],
    "openai_key": ["s" + "k-" + "x" * 10],
    "private_key": ["-----BEGIN PUBLIC KEY-----"],
    "assigned_token": ["tokens are"],
}


@pytest.mark.parametrize("name", list(audit.QUERIES))
def test_against_sql(spark, name):
    same(spark, name, audit.QUERIES[name], audit.ORACLE[name])


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("family", list(P.CREDENTIALS))
def test_marker_families(spark, family):
    hit = {r.family: (r.hits, r.docs) for r in text.marker_scan(docs(spark, *MUST[family], None, "é")).collect()}
    assert hit[family] == (len(MUST[family]),) * 2 and sum(n for n, _ in hit.values()) == len(MUST[family])
    miss = {r.family: r.hits for r in text.marker_scan(docs(spark, *MUST_NOT[family])).collect()}
    assert miss[family] == 0


def test_empty_tables(spark):
    none = docs(spark).limit(0)
    assert {(r.hits, r.docs) for r in text.marker_scan(none).collect()} == {(0, 0)}
    assert text.release_gate(none).count() == text.licence_lines(none).count() == text.personal_data(none).count() == 0


def test_stub_and_gate(spark):
    stub = "version https://git-lfs.github.com/spec/v1\noid sha256:0"
    got = {r.status: r.n for r in text.stub_status(docs(spark, stub, "see " + stub, None)).collect()}
    assert got == {"pointer_only": 1, "content": 1, "missing": 1}
    got = [r.status for r in text.release_status(docs(spark, 'a@b.org token = "x"', "a@b.org licence", "Licensed", "clean", None)).orderBy("doc_id").collect()]
    assert got == ["blocked_credential", "review_personal", "review_licence", "no_marker_found", "no_marker_found"]


def test_licence_lines_count_repeats(spark):
    got = {r.line: (r.n, r.docs) for r in text.licence_lines(docs(spark, "MIT license\nx\nMIT license", "MIT license", "licenser", None)).collect()}
    assert got == {"MIT license": (3, 2)}


def test_paths(spark):
    paths = {".idea/x": "ide_settings", "a/.env": "credential", ".venv/lib": "venv_cache", "f/node_modules/a.js": "node_modules", ".aws-sam/b": "build_output", "htmlcov/i": "coverage", "d/c.sqlite3-wal": "db_sidecar", "d/c.sqlite3": "kept", "src/a.py": "kept"}
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path: r["class"] for r in listing.tracked_but_excluded(frame).collect()}
    assert got == {p: c for p, c in paths.items() if c != "kept"}
    assert {r["class"]: r.n for r in listing.path_class(frame).collect()}["kept"] == 2


def test_listing_cases(spark):
    items = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "a", None), (4, "b", 200)], "k long, g string, length long")
    got = {r.g: (r.bytes, r.max_bytes, r.largest_id) for r in listing.size_census(items, "g", "k", items.length).collect()}
    assert got == {"a": (10, 5, 1), "b": (200, 200, 4)}
    none = items.filter("k = 99")
    assert [r.k for r in listing.oversize_untracked(items, none, "k", items.length, 100).collect()] == [4]
    assert listing.oversize_untracked(items, items, "k", items.length, 100).count() == 0
    need = spark.createDataFrame([("a",), ("z",), ("a",)], "g string")
    assert {r.g: r.n for r in listing.required_coverage(need, items, "g").collect()} == {"a": 3, "z": 0}


def test_lineage_cases(spark):
    one = spark.createDataFrame([(1,), (2,), (2,), (9,), (None,)], "k long")
    two = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "k long, g string")
    assert sorted((r.k for r in lineage.trace_orphans(one, two, "k").collect()), key=str) == [9, None]
    assert {r.g: (r.n, r.traced) for r in lineage.trace_coverage(one, two, "k", "g").collect()} == {"x": (2, 2), "y": (1, 0)}
    got = {r.status: r.n for r in lineage.snapshot_reconcile(two, one.dropna(), "k", "k").collect()}
    assert got == {"both": 2, "missing_in_snapshot": 1, "unexpected": 1}


def test_golden_diff_is_a_multiset(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k long, v string")
    b = spark.createDataFrame([(2, "x"), (1, None), (3, "y")], "k long, v string")
    got = sorted((r.k, r.side, r.copies) for r in lineage.golden_diff(a, b).collect())
    assert got == [(1, "actual", 1), (3, "expected", 1)]
    assert lineage.golden_diff(a, a.repartition(3)).count() == 0


def test_files_and_rules(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.bin").write_bytes(b"1234")
    (got,) = tables.listing(spark, str(tmp_path)).collect()
    assert got.length == 4 and got.path.endswith("a/x.bin")
    (tmp_path / "rules.json").write_text('{"class": "bin", "pattern": "bin$"}\n')
    assert tables.rules(spark, str(tmp_path / "rules.json")) == [("bin", "bin$")]


def test_streams(spark, tmp_path):
    docs(spark, "a@b.org", "clean").write.parquet(str(tmp_path / "in"))
    stream = streaming.document_stream(spark, str(tmp_path / "in"), "doc_id long, text string")
    run = streaming.status_counts(stream).writeStream.outputMode("complete").format("memory").queryName("status").option("checkpointLocation", str(tmp_path / "c1")).start()
    run.processAllAvailable()
    run.stop()
    assert {r.status: r.n for r in spark.table("status").collect()} == {"review_personal": 1, "no_marker_found": 1}
    rows = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'token = a' AS body UNION ALL SELECT timestamp'2024-01-01 05:00:00', 'x'")
    rows.write.parquet(str(tmp_path / "ev"))
    events = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "ev"))
    run = streaming.marker_counts(events, "ts", "body").writeStream.outputMode("append").format("memory").queryName("marks").option("checkpointLocation", str(tmp_path / "c2")).start()
    run.processAllAvailable()
    run.stop()
    assert {r.family: r.hits for r in spark.table("marks").collect()}["assigned_token"] == 1


def test_long_tokens_take_linear_time(spark):
    """Texts of a million characters without a break, on which unbounded patterns would restart from each of them."""
    texts = ["x" * 1_000_000, "x" * 1_000_000 + "@", "1" * 1_000_000, "a@" * 500_000, "x@" + "y" * 1_000_000, "1 " * 500_000, "-----BEGIN " * 90_000, "token " * 160_000, "a." * 500_000 + "@b.org"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    began = time.perf_counter()
    found = {r.doc_id: (r.email, r.phone) for r in text.personal_data(frame).collect()}
    assert {d: e for d, (e, _) in found.items() if e} == {8: 1} and found[2][1] == 1
    assert text.release_gate(frame).count() == 2 and text.document_audit(frame).count() == len(texts)
    assert time.perf_counter() - began < 60


def test_every_text_is_counted_once(spark):
    """The plan holds each pattern once, not in a filter and again in a projection."""
    frame = spark.createDataFrame([(1, "a@b.org"), (2, None), (3, "")], "doc_id long, text string").repartition(2)
    for out in (text.personal_data(frame), text.document_audit(frame)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") <= len(P.CREDENTIALS) + len(P.PERSONAL)
    assert [r.doc_id for r in text.personal_data(frame).collect()] == [1]
    assert sorted((r.doc_id, r.status) for r in text.document_audit(frame).collect()) == [(1, "review_personal"), (2, "no_marker_found"), (3, "no_marker_found")]


def test_columns_in_the_way(spark):
    a = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "k int, _d int")
    b = spark.createDataFrame([(1, 2), (5, 6)], "k int, _d int")
    assert sorted(map(tuple, lineage.golden_diff(a, b).collect())) == [(1, 2, "actual", 1), (3, 4, "actual", 1), (5, 6, "expected", 1)]
    records = spark.createDataFrame([(1,), (1,)], "k int")
    assert list(map(tuple, lineage.trace_coverage(records, spark.createDataFrame([(1, "x"), (2, "x")], "k int, _have string"), "k", "_have").collect())) == [("x", 2, 1)]


def test_shipped_rules_over_a_listing(spark, tmp_path):
    """The rules of a hand-over, over the listing of a real folder."""
    for path in ("src/a.py", "node_modules/x/y.js", "conf/credentials", "data/cache.sqlite3", "data/cache.sqlite3-wal", "build/out.txt"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x")
    files = tables.listing(spark, str(tmp_path))
    assert {r["class"]: r.n for r in listing.path_class(files).collect()} == {"kept": 2, "node_modules": 1, "credential": 1, "db_sidecar": 1, "build_output": 1}
    assert listing.tracked_but_excluded(files).count() == 4


def test_size_census_of_groups_with_clashing_names(spark):
    frame = spark.createDataFrame([("a", 1, "xy"), ("a", 2, "xyz"), ("b", 3, None)], "_key string, _size long, t string")
    got = {tuple(r) for r in listing.size_census(frame, "_key", "_size", F.octet_length("t")).collect()}
    assert got == {("a", 5, 3, 2), ("b", 0, 0, 3)}
