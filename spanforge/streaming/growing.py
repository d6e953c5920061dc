"""A streaming source of lines of files that are still being written.

Offsets are bytes of each file. A trigger reads whole lines alone: what follows
the last line end is held back until its line is finished, so no line is read
twice or in parts, restarts included. New bytes are dealt out in ranges; a line
belongs to the range that its first byte is in. A path is a file or a folder, on any
file system that pyarrow knows; files whose names start with "." or "_" don't
count. A file that becomes shorter than what has been read of it is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from spanforge import schemas
from spanforge.shipping import ship

NAME = "growing_lines"
#: Bytes of a range, and of a look for the last line end.
RANGE_BYTES, LOOK_BYTES = 32 << 20, 1 << 16


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def finished(source, size: int, known: int) -> int:
    """The byte after the last line end before ``size``; ``known`` if none came since."""
    end = size
    while end > known:
        at = max(known, end - LOOK_BYTES)
        source.seek(at)
        found = source.read(end - at).rfind(b"\n")
        if found >= 0:
            return at + found + 1
        end = at
    return known


def lines_of(source, start: int, end: int, first: int) -> Iterator[tuple[int, bytes]]:
    """Lines, with their places, whose first byte is in [start, end); ``first`` is where a line is known to start."""
    source.seek(start if start == first else start - 1)
    at = start if start == first else start - 1 + len(source.readline())
    while at < end:
        line = source.readline()
        if not line:
            return
        yield at, line
        at += len(line)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    first: int


class GrowingReader(DataSourceStreamReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"bytes": {}}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, root = file_system(self.path)
        info = system.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else [] if info.type == fs.FileType.NotFound else system.get_file_info(fs.FileSelector(root))
        found = {}
        for f in sorted(files, key=lambda f: f.path):
            if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")):
                with system.open_input_file(f.path) as source:
                    found[f.path] = finished(source, f.size, min(self.known.get(f.path, 0), f.size))
        self.known = found
        return {"bytes": {p: n for p, n in found.items() if n}}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, last in end["bytes"].items():
            first = start["bytes"].get(path, 0)
            if last < first:
                raise ValueError(f"{path} has {last} bytes of lines, {first} have been read")
            out += [Range(path, at, min(at + self.range_bytes, last), first) for at in range(first, last, self.range_bytes)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        import io

        system, _ = file_system(self.path)
        with system.open_input_file(partition.path) as raw:
            source = io.BufferedReader(_Readable(raw), 1 << 20)
            for at, line in lines_of(source, partition.start, partition.end, partition.first):
                yield partition.path, at, line.rstrip(b"\r\n").decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        pass


class _Readable:
    """A pyarrow file as a raw stream of io."""

    def __init__(self, source):
        self.source, self.closed = source, False

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def writable(self) -> bool:
        return False

    def seek(self, at: int, whence: int = 0) -> int:
        return self.source.seek(at, whence)

    def tell(self) -> int:
        return self.source.tell()

    def readinto(self, into) -> int:
        data = self.source.read(len(into))
        into[: len(data)] = data
        return len(data)

    def close(self) -> None:
        self.closed = True

    def flush(self) -> None:
        pass


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, start long, value string"

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))


def read_lines(spark: SparkSession, path: str, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, start (the line's first byte) and value of each line, as lines are finished."""
    ship(spark)
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format(NAME).option("rangeBytes", range_bytes).load(path)


def read_growing_ticks(spark: SparkSession, path: str, **kw) -> DataFrame:
    """Ticks from JSON lines of growing files. Lines that are no ticks give null sessions, which the live operators leave out."""
    return read_lines(spark, path, **kw).select(F.from_json("value", schemas.LIVE_TICKS).alias("t")).select("t.*")
