"""Archives written and read back, against SQL and by hand-made records."""

import gzip
import hashlib

import pytest

from lodestone.llm import registry, warc
from tests.oracle import same

PAGES = "page_id long, url string, html string, digest string, row int"


def cases():
    same_text = "é" * 80
    rows = [(5, "u5", same_text), (3, "u3", same_text), (9, None, same_text), (7, "u\r\nx", "x" * 99), (8, "u", "x" * 99), (1, "u", None), (2, "u", ""), (11, "u", "a\r\n\r\nb" * 40_000), (12, "u", "a\r\n\r\nb" * 40_000)]
    rows += [(20, "u", "z" * 300), (20, "u", "z" * 300), (None, "u", "n" * 200), (30, "u", "n" * 200), (None, None, None)]
    return [(*r, "clash", 0) for r in rows]


def test_against_sql(spark):
    got = same(spark, "op7_warc", registry.op7_warc, registry.ORACLE["op7_warc"])
    assert len(got) == 250


@pytest.mark.parametrize("segment", [200, 1 << 20])
def test_round_trip(spark, tmp_path, segment):
    frame = spark.createDataFrame(cases(), PAGES)
    warc.write(frame, f"file://{tmp_path}/a", segment_bytes=segment)
    got = warc.read(spark, f"file://{tmp_path}/a").collect()
    assert all(r.error is None for r in got) and len(got) == len(cases())
    whole = {r.page_id: bytes(r.payload) for r in got if r.record_type == "response"}
    assert whole[11] == b"a\r\n\r\nb" * 40_000 and whole[3] == ("é" * 80).encode() and whole[1] == b""
    rows = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.pages(spark, f"file://{tmp_path}/a").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {(3, 160, sha("é" * 80), "response", None), (5, 160, sha("é" * 80), "revisit", 3), (9, 160, sha("é" * 80), "revisit", 3)} <= rows
    assert {(7, 99, sha("x" * 99), "response", None), (8, 99, sha("x" * 99), "response", None), (2, 0, sha(""), "response", None)} <= rows
    assert {(20, 300, sha("z" * 300), "response", None), (20, 300, sha("z" * 300), "revisit", 20)} <= rows
    assert {(30, 200, sha("n" * 200), "response", None), (None, 200, sha("n" * 200), "revisit", 30)} <= rows


def test_empty(spark, tmp_path):
    warc.write(spark.createDataFrame([], PAGES), f"file://{tmp_path}/e")
    assert warc.pages(spark, f"file://{tmp_path}/e").count() == 0


def record(kind, own, block, **more):
    fields = {"WARC-Type": kind, "WARC-Record-ID": own, **{k.replace("_", "-"): v for k, v in more.items()}}
    return warc._record(fields, block) + b"\r\n\r\n"


def test_segments_by_hand(spark, tmp_path):
    message = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + b"5;x=1\r\nhello\r\n3\r\n wo\r\n0\r\n\r\n"
    cut = [message[:20], message[20:60], message[60:]]

    def parts(page, blocks, total=len(message), numbers=(1, 2, 3)):
        own = f"<urn:page:{page}:0>"
        for n, block in zip(numbers, blocks, strict=True):
            end = {"WARC_Segment_Total_Length": total} if n == max(numbers) else {}
            if n == 1:
                yield record("response", own, block, WARC_Segment_Number=1, **end)
            else:
                yield record("continuation", f"<urn:page:{page}:0:{n}>", block, WARC_Segment_Number=n, WARC_Segment_Origin_ID=own, **end)

    good, gap, long_, framing = (list(x) for x in (parts(1, cut), parts(2, [cut[0], cut[2]], numbers=(1, 3)), parts(3, cut, total=9), parts(4, [cut[0], cut[1], cut[2][:5]], total=len(cut[0] + cut[1]) + 5)))
    plain = record("response", "<urn:page:5:0>", b"HTTP/1.0 200 OK\r\n\r\nas it is")
    (tmp_path / "1.gz").write_bytes(gzip.compress(good[2]) + gzip.compress(good[0]) + gzip.compress(b"".join(gap)))
    (tmp_path / "2.gz").write_bytes(gzip.compress(good[1] + plain + b"".join(long_ + framing)))
    got = {r.page_id: (r.payload and bytes(r.payload), r.error) for r in warc.read(spark, f"file://{tmp_path}").collect()}
    assert got[1] == (b"hello wo", None) and got[5] == (b"as it is", None)
    assert got[2] == (None, "segments missing or repeated") and got[3] == (None, "total length differs") and got[4][0] is None and "chunk" in got[4][1]


def test_broken_archives():
    whole = record("response", "<urn:page:1:0>", b"abc")
    for broken in (whole[:-1], b"junk" + whole, gzip.compress(whole)[:-9]):
        with pytest.raises(ValueError):
            list(warc.records_in(broken))
    for body in (b"", b"5\r\nab", b"zz\r\n", b"-1\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(body)
    for n in (0, 1, 10, 11):
        assert warc.unchunked(warc.chunked(b"x" * n, 10)) == b"x" * n


@pytest.mark.parametrize("part", [1, 7, 1 << 20])
def test_archives_are_inflated_part_by_part(monkeypatch, part):
    monkeypatch.setattr(warc, "PART_BYTES", part)
    records = [warc._record({"WARC-Type": "response", "WARC-Record-ID": f"<r:{k}>"}, b"\r\n\r\nWARC/" * k) + warc._END for k in range(20)]
    members = b"".join(gzip.compress(b"".join(records[k : k + 3])) for k in range(0, 20, 3))
    for archive in (members, b"".join(records)):
        assert [(f["warc-record-id"], b) for f, b in warc.records_in(archive)] == [(f"<r:{k}>", b"\r\n\r\nWARC/" * k) for k in range(20)]
    for broken in (members[:-9], b"".join(records)[:-1], b"".join(records) + b"WAR", b"x" + records[0]):
        with pytest.raises(ValueError):
            list(warc.records_in(broken))
    assert list(warc.records_in(b"")) == []


def test_archives_are_parsed_once(spark, tmp_path):
    """Whole and segmented records come from one written table."""
    warc.write(spark.createDataFrame(cases(), PAGES), f"file://{tmp_path}/a", segment_bytes=200)
    plan = warc.read(spark, f"file://{tmp_path}/a")._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and "content#" not in plan and plan.count("MapInArrow") == 1


def test_revisits_beyond_the_broadcast(spark, tmp_path, monkeypatch):
    """The list of revisits is shuffled where it is too long, with equal archives."""
    rows = {}
    for bound in (warc.BROADCAST_BYTES, -1):
        monkeypatch.setattr(warc, "BROADCAST_BYTES", bound)
        warc.write(spark.createDataFrame(cases(), PAGES).coalesce(1), f"file://{tmp_path}/{bound}")
        rows[bound] = sorted(map(repr, warc.pages(spark, f"file://{tmp_path}/{bound}").collect()))
    assert len({tuple(r) for r in rows.values()}) == 1


def test_clashing_names(spark, tmp_path):
    frame = spark.createDataFrame(cases(), PAGES).selectExpr("*", "'x' AS payload", "'y' AS first_page", "1 AS first_row", "map('a', 1) AS record", "2 AS total")
    warc.write(frame, f"file://{tmp_path}/a")
    assert warc.pages(spark, f"file://{tmp_path}/a").count() == len(cases())
