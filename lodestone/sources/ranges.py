"""Bodies of any size as pieces of text, read by byte ranges.

A data source, ``byte_ranges``: a file is read by as many tasks as it has ranges
of ``rangeBytes``. Files are cut where a line ends, so a piece is a run of whole
lines, and no line belongs to two ranges: as in Spark's reader of lines, a range
begins behind the first cut at or after its first byte and ends at the first cut
at or after its last. A line end is a cut only if the character before it is no
white space, ``=`` or ``n``: no pattern of the audit can reach over such a place
(the one that spans white space has ``token`` or ``=`` before it). So counts over
the pieces are those over the whole body.

A task holds about ``pieceBytes`` of a file, or the longest run without a cut if
that is longer, however large the file is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_CUT = re.compile(rb"[^\s=n]\n")


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class ByteRanges(DataSource):
    """Options: ``path`` (a file or folder that driver and executors reach, as a path or URI), ``rangeBytes``, ``pieceBytes``."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, begin long, text string"

    def reader(self, schema) -> DataSourceReader:
        return ByteRangesReader(self.options)


class ByteRangesReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangebytes") or options.get("rangeBytes") or 64 << 20)
        self.piece_bytes = int(options.get("piecebytes") or options.get("pieceBytes") or 1 << 20)
        if self.range_bytes < 1 or self.piece_bytes < 1:
            raise ValueError("rangeBytes and pieceBytes must be at least 1")

    def partitions(self) -> list[Range]:
        """Sizes come from the listing; no file is opened. Names that begin with a dot or an underscore are left out below a folder."""
        from pyarrow import fs

        store, root = _store(self.path)
        found = store.get_file_info(root)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and not any(p[0] in "._" for p in f.path[len(root) :].strip("/").split("/"))]
        return [Range(f.path, k, min(k + self.range_bytes, f.size)) for f in sorted(files, key=lambda f: f.path) for k in range(0, f.size, self.range_bytes)]

    def read(self, part: Range) -> Iterator[tuple[str, int, str]]:
        store, _ = _store(self.path)
        with store.open_input_file(part.path) as file:
            for begin, body in pieces(file, part.begin, part.end, self.piece_bytes):
                yield part.path, begin, body.decode("utf-8", "replace")


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def pieces(file, begin: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """The pieces of the range ``begin`` to ``end``: where each begins, and its bytes.

    A cut at byte ``c`` (the first byte behind a line end) opens a piece of this
    range if ``begin <= c < end``; the file's first byte is a cut.
    """
    at = begin
    if begin:
        file.seek(max(0, begin - 2))
        held = file.read(size + 2)
        low = max(0, begin - 2)
        while True:
            found = _CUT.search(held)
            if found:
                at = low + found.end()
                break
            if not held or low + len(held) >= end:
                # No cut opens within the range.
                return
            low, held = low + len(held) - 1, held[-1:]
            more = file.read(max(size, len(held)))
            if not more:
                return
            held += more
        if at >= end:
            return
    file.seek(at)
    held = b""
    while True:
        more = file.read(max(size, len(held)))  # a run without a cut is read in ever larger parts
        held += more
        if not more:
            if held:
                yield at, held
            return
        # Whole lines up to the last cut in hand; up to the first at or after the range's end, once that is reached.
        if at + len(held) >= end:
            low = max(0, end - at - 2)
            found = _CUT.search(held, low)
            if found:
                yield at, held[: found.end()]
                return
            cut = _last_cut(held, low + 1)
        else:
            cut = _last_cut(held, len(held))
        if cut:
            yield at, held[:cut]
            at, held = at + cut, held[cut:]


def _last_cut(held: bytes, limit: int) -> int:
    """Where the last cut within the first ``limit`` bytes lies, or 0."""
    at = held.rfind(b"\n", 0, limit)
    while at > 0:
        if _CUT.match(held, at - 1):
            return at + 1
        at = held.rfind(b"\n", 0, at)
    return 0


def read_pieces(spark: SparkSession, path: str, range_bytes: int = 64 << 20, piece_bytes: int = 1 << 20) -> DataFrame:
    """``path, begin, text``: the pieces of a file, or of all files of a folder. Empty files have none; bytes that are no UTF-8 become U+FFFD."""
    spark.dataSource.register(ByteRanges)
    return spark.read.format("byte_ranges").option("rangeBytes", range_bytes).option("pieceBytes", piece_bytes).load(path)
