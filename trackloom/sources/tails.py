"""Streaming sources that follow growing logs: whole lines of files by byte offset, and entries of a
log of segments by entry id.

Both are Python data sources: an offset says how far each file (or the log) is read, a micro-batch
is cut into partitions by file, and what has been handed out is kept in the query's checkpoint.
The folder has to be one that driver and executors share.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that a search for the last whole line goes back at a time.
BACK = 1 << 16
#: Bytes at the start of a file by which it is known again.
HEAD = 64


def local_path(path: str) -> str:
    """A path as the file system knows it."""
    return path.removeprefix("file://").replace("//", "/") if path.startswith("file:") else path


def whole_lines(path: str, size: int) -> int:
    """The end of the last whole line within the first ``size`` bytes."""
    with open(path, "rb") as f:
        while size > 0:
            begin = max(0, size - BACK)
            f.seek(begin)
            at = f.read(size - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            size = begin
    return 0


@dataclass
class Slice(InputPartition):
    """Bytes of one file."""

    file: str
    begin: int
    end: int


class LineReader(DataSourceStreamReader):
    """Offsets are {file: [inode, end, checksum of its first bytes]}. A file that is shorter than its
    offset, has another inode, or begins otherwise, was cut or replaced and is read from its start."""

    def __init__(self, options: dict) -> None:
        self.folder = local_path(options["path"])
        self.pattern = options.get("pattern", "*.jsonl")
        self.start = options.get("start", "end")
        if self.start not in ("begin", "end"):
            raise ValueError("start must be begin or end")
        self.most = int(options.get("maxbytesperpartition", options.get("maxBytesPerPartition", 64 << 20)))

    def _head(self, name: str, end: int) -> int:
        with open(os.path.join(self.folder, name), "rb") as f:
            return zlib.crc32(f.read(min(end, HEAD)))

    def _present(self) -> dict[str, list[int]]:
        found = {}
        for name in sorted(os.listdir(self.folder)):
            if fnmatch(name, self.pattern):
                try:
                    s = os.stat(os.path.join(self.folder, name))
                    end = whole_lines(os.path.join(self.folder, name), s.st_size)
                    found[name] = [s.st_ino, end, self._head(name, end)]
                except FileNotFoundError:  # gone since it was listed
                    continue
        return found

    def initialOffset(self) -> dict:
        present = self._present()
        return present if self.start == "end" else {name: [inode, 0, 0] for name, (inode, _, _) in present.items()}

    def latestOffset(self) -> dict:
        return self._present()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts: list[InputPartition] = []
        for name, (inode, to, _) in end.items():
            known, at, head = start.get(name, [inode, 0, 0])
            at = at if known == inode and at <= to and self._head(name, at) == head else 0
            parts += [Slice(name, a, min(a + self.most, to)) for a in range(at, to, self.most)]
        return parts

    def read(self, partition: Slice) -> Iterator[tuple]:
        """Lines that begin within the slice, those that end beyond it too."""
        path = os.path.join(self.folder, partition.file)
        with open(path, "rb") as f:
            at = partition.begin
            if at:
                f.seek(at - 1)
                at += len(f.readline()) - 1  # a line that began before belongs to the slice before
            while at < partition.end:
                line = f.readline()
                if not line:
                    return
                text = line.rstrip(b"\r\n").decode("utf-8", "replace")
                if text.strip():
                    yield partition.file, at, text
                at += len(line)


class LineTail(DataSource):
    """Options: ``path``, ``pattern`` (``*.jsonl``), ``start`` (``end``: only what is appended from
    now on, the default, or ``begin``), ``maxBytesPerPartition``. Files that appear later are read
    from their start. Blank lines are left out."""

    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return "file string, at bigint, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LineReader(dict(self.options))


def entry_key(entry_id: str) -> tuple[int, int]:
    """Entry ids are ``milliseconds-number`` and are ordered by both."""
    ms, _, n = entry_id.partition("-")
    return int(ms), int(n or 0)


def _segment(entry_id: str) -> str:
    ms, n = entry_key(entry_id)
    return f"{ms:020d}-{n:020d}.jsonl"


def append_entries(folder: str, entries: Iterable[tuple[str, str]]) -> None:
    """Append (id, payload) entries, of ids greater than any before, as one segment named by its
    first id; readers see all of it or nothing."""
    rows = list(entries)
    if not rows:
        return
    folder = local_path(folder)
    os.makedirs(folder, exist_ok=True)
    hidden = os.path.join(folder, f".{uuid.uuid4().hex}")
    with open(hidden, "w", encoding="utf-8") as f:
        f.writelines(json.dumps({"id": i, "payload": p}) + "\n" for i, p in rows)
    os.replace(hidden, os.path.join(folder, _segment(rows[0][0])))


@dataclass
class Segment(InputPartition):
    """The entries of one segment after ``after``, up to and with ``to``."""

    file: str
    after: str
    to: str


class EntryReader(DataSourceStreamReader):
    """Offsets are the last id that was read. A segment's name is its first id, so the segments of a
    range of ids are known without reading them."""

    def __init__(self, options: dict) -> None:
        self.folder = local_path(options["path"])
        self.start = options.get("start", "$")
        if self.start != "$":
            entry_key(self.start)

    def _segments(self) -> list[str]:
        return sorted(n for n in os.listdir(self.folder) if n.endswith(".jsonl") and not n.startswith("."))

    def _last(self) -> str:
        names = self._segments()
        if not names:
            return "0-0"
        path = os.path.join(self.folder, names[-1])
        size = os.path.getsize(path)
        last = whole_lines(path, size - 1)
        with open(path, "rb") as f:
            f.seek(last)
            return json.loads(f.readline())["id"]

    def initialOffset(self) -> dict:
        return {"id": self._last() if self.start == "$" else self.start}

    def latestOffset(self) -> dict:
        return {"id": self._last()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, to = entry_key(start["id"]), entry_key(end["id"])
        if after >= to:
            return []
        names = self._segments()
        first = [entry_key("-".join(str(int(x)) for x in n[: -len(".jsonl")].split("-"))) for n in names]
        within = [n for n, a, b in zip(names, first, [*first[1:], None]) if a <= to and (b is None or b > after)]
        return [Segment(n, start["id"], end["id"]) for n in within]

    def read(self, partition: Segment) -> Iterator[tuple]:
        after, to = entry_key(partition.after), entry_key(partition.to)
        with open(os.path.join(self.folder, partition.file), encoding="utf-8") as f:
            for line in f:
                entry = json.loads(line)
                if after < entry_key(entry["id"]) <= to:
                    yield entry["id"], entry.get("payload") or "{}"


class EntryLog(DataSource):
    """A consumer of a log of entries. Options: ``path``, ``start`` (``$``: only entries from now on,
    the default; ``0``: all that are kept; or an id after which to begin)."""

    @classmethod
    def name(cls) -> str:
        return "entry_log"

    def schema(self) -> str:
        return "id string, payload string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return EntryReader(dict(self.options))


def follow(spark: SparkSession, kind: type[DataSource], folder: str, **options: str) -> DataFrame:
    """A stream of one of the sources above."""
    spark.dataSource.register(kind)
    return spark.readStream.format(kind.name()).options(path=folder, **options).load()
