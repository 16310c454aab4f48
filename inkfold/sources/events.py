"""Files of server-sent events as a source of streams, and of finished tables.

An event is a run of lines that a blank line ends; its data is what its `data:` lines hold, joined by line ends. A stream's
offsets are byte positions: for each file, where its last complete event ends. So an event whose end isn't written yet waits
for a later micro-batch, and a restart goes on at a byte, losing and doubling nothing. Files are read in pieces of `splitBytes`;
an event belongs to the piece in which it begins, and is read beyond the piece's end.

    spark.dataSource.register(events.EventFiles)
    spark.readStream.format("event_files").option("path", folder).load()

Rows have file, position (where the event begins), data, and event (the `event:` field; null without one). Comments, events
without data and the end mark are left out. Files must only grow. `finished` set to true counts what stands after the last blank
line as complete, as is always so for tables. Paths are those of pyarrow's file systems (local, hdfs, s3, ...).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, position long, data string, event string"
#: The end of an event: a line's end and a blank line.
END = re.compile(rb"\n\r?\n")
#: The longest end, less one: so much of it may stand before a cut.
OVERLAP = 2
CHUNK = 1 << 16


def _at(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+]*:", path) else (fs.LocalFileSystem(), path)


def _sizes(path: str) -> dict[str, int]:
    """The files under a path that are open to readers, and their sizes."""
    from pyarrow import fs

    system, place = _at(path)
    found = system.get_file_info(fs.FileSelector(place, recursive=True)) if system.get_file_info(place).type == fs.FileType.Directory else [system.get_file_info(place)]
    return {f.path: f.size for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))}


def _complete(source, start: int, size: int) -> int:
    """Where the last complete event between start and size ends; start without one. The file is read from its end."""
    high = size
    while high > start:
        low = max(start, high - CHUNK)
        piece = source.read_at(min(size, high + OVERLAP) - low, low)
        ends = [m.end() for m in END.finditer(piece)]
        if ends:
            return low + ends[-1]
        high = low
    return start


@dataclass
class Piece(InputPartition):
    """The events of a file that begin from low to before high; none of them ends after end."""

    file: str
    low: int
    high: int
    start: int
    end: int


def _pieces(sizes: dict[str, tuple[int, int]], split: int) -> list[Piece]:
    return [Piece(f, low, min(low + split, end), start, end) for f, (start, end) in sorted(sizes.items()) for low in range(start, end, split)]


def _field(line: bytes, name: bytes) -> str | None:
    if line != name and not line.startswith(name + b":"):
        return None
    value = line[len(name) + 1 :]
    return value.removeprefix(b" ").decode("utf-8", "replace")


def _row(file: str, position: int, body: bytes) -> tuple | None:
    lines = [x.removesuffix(b"\r") for x in body.split(b"\n")]
    data = [d for x in lines if (d := _field(x, b"data")) is not None]
    kinds = [k for x in lines if (k := _field(x, b"event")) is not None]
    told = "\n".join(data)
    return (file, position, told, kinds[-1] if kinds else None) if data and told.strip() not in ("", "[DONE]") else None


def _read(path: str, piece: Piece) -> Iterator[tuple]:
    system, _ = _at(path)
    with system.open_input_file(piece.file) as source:
        at = piece.low
        buffer, begin = b"", at
        if at > piece.start:  # the first event that begins here follows an end, which may stand before the cut
            begin = max(piece.start, at - OVERLAP - 1)
            at = begin
            while True:
                more = source.read_at(min(CHUNK, piece.end - at), at)
                at, buffer = at + len(more), buffer + more
                # An end that is over before the cut belongs to an event before it.
                m = next((m for m in END.finditer(buffer) if begin + m.end() >= piece.low), None)
                if m:
                    begin, buffer = begin + m.end(), buffer[m.end() :]
                    break
                if not more or begin + len(buffer) >= piece.high + OVERLAP:
                    return
        while begin < piece.high:
            m = END.search(buffer)
            if m is None:
                more = source.read_at(min(CHUNK, piece.end - at), at) if at < piece.end else b""
                if more:
                    at, buffer = at + len(more), buffer + more
                    continue
                if row := _row(piece.file, begin, buffer):
                    yield row
                return
            if row := _row(piece.file, begin, buffer[: m.start()]):
                yield row
            begin, buffer = begin + m.end(), buffer[m.end() :]


class EventFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Table(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802 - the interface's name
        return _Stream(self.options)


class _Table(DataSourceReader):
    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("splitBytes", 1 << 26))

    def partitions(self) -> list[Piece]:
        return _pieces({f: (0, n) for f, n in _sizes(self.path).items()}, self.split)

    def read(self, partition: Piece) -> Iterator[tuple]:
        return _read(self.path, partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("splitBytes", 1 << 26))
        self.finished = str(options.get("finished", "false")).lower() == "true"
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": "{}"}

    def latestOffset(self) -> dict:  # noqa: N802
        system, _ = _at(self.path)
        for file, size in _sizes(self.path).items():
            start = self.known.get(file, 0)
            if size > start:
                with system.open_input_file(file) as source:
                    self.known[file] = size if self.finished else _complete(source, start, size)
        return {"files": json.dumps({f: n for f, n in sorted(self.known.items()) if n})}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        return _pieces({f: (before.get(f, 0), n) for f, n in after.items() if n > before.get(f, 0)}, self.split)

    def read(self, partition: Piece) -> Iterator[tuple]:
        return _read(self.path, partition)

    def commit(self, end: dict) -> None:
        pass
