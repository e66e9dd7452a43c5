"""WARC archives: pages written as records, and read back by segment reassembly.

Writing. Each page becomes a record whose block is an HTTP message with the
HTML in chunked framing. Of equal payloads of at least ``REVISIT_BYTES`` bytes
the page with the smallest id is a response, the others are revisits of it,
whose blocks hold HTTP headers only. A block longer than ``SEGMENT_BYTES`` is
cut into a first record and continuation records. Tasks write gzip archives
with Spark's text writer, whose line separator is the end mark of a record.
Pages are numbered and written first; which of them are revisits is found from
digests alone, and told to the writers by broadcast up to ``BROADCAST_BYTES``, so
that payloads are only shuffled beyond that bound.

Reading. Tasks inflate archives part by part, and walk through them record by
record; each archive is parsed once, into a written table. Segments are
grouped by the identifier of their first record, ordered by segment number, and
joined if the numbers have no gap and the total length is right; then chunked
framing is decoded. Revisits take payload size and digest from the response
they name. Only segmented records are shuffled with their blocks.

Defined cases: a null or empty HTML is an empty payload; null ids come after
all others; of repeated rows one is the response; a broken group of segments or
broken framing gives a row with ``error`` and a null payload; an archive cut off
inside a record raises ``ValueError``; of equal payloads under one id the row that
Spark numbers first is the response; an empty table gives archives without pages,
and no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import Scratch

REVISIT_BYTES = 100
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
#: Records of a file, each of a segment at most, which bounds its bytes.
RECORDS_PER_FILE = 4_000
#: Bytes of the list of revisits that is broadcast to the writers.
BROADCAST_BYTES = 32 << 20
#: Bytes that a reader inflates at a time.
PART_BYTES = 1 << 20
_END = b"\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"  # fixed, so that archives of equal pages are equal
_SCHEMA = "record_id string, page_id long, url string, record_type string, refers_to_id string, refers_to long, digest string, segment int, origin string, total long, block binary"
_READ = "record_id string, page_id long, url string, record_type string, refers_to_id string, refers_to long, digest string, payload binary, error string"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in HTTP's chunked framing."""
    parts = [b"%x\r\n%b\r\n" % (len(part := payload[k : k + size]), part) for k in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body. ``ValueError`` if the framing is broken."""
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk size missing")
        try:
            size = int(body[at:line].split(b";")[0], 16)
        except ValueError:
            raise ValueError("chunk size unreadable") from None
        at = line + 2
        if size == 0:
            return b"".join(parts)
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk cut off")
        parts.append(body[at : at + size])
        at += size + 2


def payload_of(message: bytes) -> bytes:
    """The payload of an HTTP message."""
    head, found, body = message.partition(_END)
    if not found:
        raise ValueError("HTTP headers cut off")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body


def _record(fields: dict, block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]).encode() + _END + block


def _records(row: dict, segment_bytes: int) -> Iterator[bytes]:
    """The record of a page: one, or a first one and its continuations."""
    own, first = f"<urn:page:{row['page_id']}:{row['row']}>", f"<urn:page:{row['first_page']}:{row['first_row']}>"
    revisit = row["first_row"] is not None and row["first_row"] != row["row"]
    fields = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": own, "WARC-Date": _DATE, "WARC-Target-URI": None if row["url"] is None else row["url"].replace("\r", "%0D").replace("\n", "%0A"), "WARC-Payload-Digest": f"sha256:{row['digest']}"}
    if revisit:
        fields |= {"WARC-Refers-To": first, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + b"\r\nTransfer-Encoding: chunked" * (not revisit) + _END
    block = head if revisit else head + chunked(row["payload"])
    fields["Content-Type"] = "application/http;msgtype=response"
    if len(block) <= segment_bytes:
        yield _record(fields, block)
        return
    last = -(-len(block) // segment_bytes)
    for n in range(1, last + 1):
        if n > 1:
            fields = {"WARC-Type": "continuation", "WARC-Record-ID": f"{own[:-1]}:{n}>", "WARC-Date": _DATE, "WARC-Segment-Origin-ID": own}
        total = {"WARC-Segment-Total-Length": len(block)} if n == last else {}
        yield _record(fields | {"WARC-Segment-Number": n} | total, block[(n - 1) * segment_bytes : n * segment_bytes])


def _writer(segment_bytes: int):
    def run(batches):
        info = [_record({"WARC-Type": "warcinfo", "WARC-Record-ID": "<urn:lodestone:archive>", "WARC-Date": _DATE, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")]
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                records = [r for row in batch.slice(k, 256).to_pylist() for r in _records(row, segment_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(info + records, pa.binary())], ["record"])
                info = []

    return run


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", segment_bytes: int = SEGMENT_BYTES) -> None:
    """Writes one record per page to gzip archives in ``folder``."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    numbered = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload"), F.sha2(body, 256).alias("digest"), F.monotonically_increasing_id().alias("row"))
    scratch = Scratch(pages.sparkSession, "warc-write")
    numbered = scratch.write(numbered, "numbered")
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    long_ = numbered.filter(F.octet_length("payload") >= REVISIT_BYTES).select("digest", "page_id", "row")
    equal = long_.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = long_.join(equal.hint("merge"), "digest").select("row", F.col("first.page_id").alias("first_page"), F.col("first.row").alias("first_row")).filter("row <> first_row")
    again = scratch.write(again, "revisits")
    join = "broadcast" if again.count() * 32 <= BROADCAST_BYTES else "merge"
    records = numbered.join(again.hint(join), "row", "left").mapInArrow(_writer(segment_bytes), "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", _END.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)
    scratch.drop(numbered, again)


def _inflated(archive: bytes) -> Iterator[bytes]:
    """An archive's bytes, part by part; whole if it isn't compressed."""
    if archive[:2] != b"\x1f\x8b":
        yield archive
        return
    rest = archive
    while rest:
        member = zlib.decompressobj(31)
        while not member.eof:
            part = member.decompress(rest, PART_BYTES)
            rest = member.unconsumed_tail
            if part:
                yield part
            elif not rest and not member.eof:
                raise ValueError("archive cut off inside a gzip member")
        rest = member.unused_data


def _next(held: bytes, at: int, before: int) -> tuple[dict[str, str], bytes, int] | None:
    """Fields and block of the record at ``at``, and where it ends; None if it isn't there in full."""
    if not b"WARC/".startswith(held[at : at + 5]):
        raise ValueError(f"no WARC record at byte {before + at}")
    head = held.find(_END, at)
    if head < 0:
        return None
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in held[at:head].decode().split("\r\n")[1:])}
    start, size = head + 4, int(fields["content-length"])
    end = start + size + 4
    if len(held) < end:
        return None
    if held[end - 4 : end] != _END:
        raise ValueError(f"record cut off at byte {before + at}")
    return fields, held[start : end - 4], end


def records_in(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive."""
    held, before = b"", 0
    for part in _inflated(archive):
        held, at = held + part, 0
        while at < len(held) and (found := _next(held, at, before)):
            fields, block, at = found
            yield fields, block
        held, before = held[at:], before + at
    if held:
        raise ValueError(f"record cut off at byte {before}")


def _page(record_id: str | None) -> int | None:
    part = (record_id or "::").strip("<>").split(":")[2]
    return int(part) if part.lstrip("-").isdigit() else None


def _reader(batches):
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in _SCHEMA.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for archives in batches:
        for archive in archives.column(0):
            rows, held = [], 0
            for fields, block in records_in(archive.as_py()):
                kind = fields["warc-type"]
                if kind not in ("response", "revisit", "continuation"):
                    continue
                own, origin = fields["warc-record-id"], fields.get("warc-segment-origin-id")
                number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
                to = fields.get("warc-refers-to")
                rows.append((own, _page(own), fields.get("warc-target-uri"), kind, to, _page(to), fields.get("warc-payload-digest", "").removeprefix("sha256:"), number and int(number), (origin or own) if number else None, total and int(total), block))
                held += len(block)
                if held > 4 << 20:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)


def _decoder(batches):
    for batch in batches:
        payloads, errors = [], []
        for block, digest, kind, error in zip(*(batch.column(c).to_pylist() for c in ("block", "digest", "record_type", "error")), strict=True):
            payload = None
            if not error:
                try:
                    payload = payload_of(block)
                    if kind == "response" and digest and hashlib.sha256(payload).hexdigest() != digest:
                        payload, error = None, "payload digest differs"
                except ValueError as broken:
                    error = str(broken)
            payloads.append(payload)
            errors.append(error)
        kept = batch.select([x.split()[0] for x in _READ.split(", ")[:-2]])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(payloads, pa.binary()), pa.array(errors, pa.string())], [*kept.schema.names, "payload", "error"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row per page record: ids, type, digest as stated, decoded payload (empty for revisits), error."""
    records = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content").mapInArrow(_reader, _SCHEMA)
    records = Scratch(spark, "warc-read").write(records, "records")
    whole = records.filter("segment IS NULL").drop("origin", "segment", "total").withColumn("error", F.lit(None).cast("string"))
    part = F.struct("segment", "total", "block", "record_id", "page_id", "url", "record_type", "refers_to_id", "refers_to", "digest")
    groups = records.filter("segment IS NOT NULL").groupBy("origin").agg(F.array_sort(F.collect_list(part)).alias("p"))
    first, last = F.get("p", F.lit(0)), F.element_at("p", -1)
    joined = groups.select(
        F.col("origin").alias("record_id"), *[first[c].alias(c) for c in ("page_id", "url", "record_type", "refers_to_id", "refers_to", "digest")],
        F.array_join(F.transform("p", lambda x: x["block"].cast("string")), "").cast("binary").alias("block"),
        last["segment"].alias("last"), last["total"].alias("total"), F.size("p").alias("n"), F.transform("p", lambda x: x["segment"]).alias("numbers"),
    )
    gap = (F.col("n") != F.col("last")) | (F.size(F.array_distinct("numbers")) != F.col("n")) | (F.element_at("numbers", 1) != 1)
    error = F.when(gap, "segments missing or repeated").when(F.col("total").isNull(), "last segment missing").when(F.octet_length("block") != F.col("total"), "total length differs")
    joined = joined.withColumn("error", error).select(whole.columns)
    return whole.unionByName(joined).mapInArrow(_decoder, _READ)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, error`` of each page; revisits are resolved."""
    rows = Scratch(spark, "warc-pages").write(read(spark, folder).select("record_id", "page_id", "record_type", "refers_to_id", "refers_to", "error", F.octet_length("payload").cast("long").alias("own_bytes"), F.sha2("payload", 256).alias("own_digest")), "pages")
    first = rows.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("own_bytes").alias("first_bytes"), F.col("own_digest").alias("first_digest"))
    all_ = rows.join(first.hint("merge"), "refers_to_id", "left")
    revisit = F.col("record_type") == "revisit"
    return all_.select("page_id", F.when(revisit, F.col("first_bytes")).otherwise(F.col("own_bytes")).alias("payload_bytes"), F.when(revisit, F.col("first_digest")).otherwise(F.col("own_digest")).alias("payload_digest"), "record_type", "refers_to", "error")
