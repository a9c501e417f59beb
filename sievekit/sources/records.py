"""``//``-ended attribute-value records as a data source, for batch and streams alike.

    spark.dataSource.register(RecordSource)
    spark.read.format("sievekit_records").load(folder)
    spark.readStream.format("sievekit_records").load(folder)

A row is (file, start, attrs): the byte at which the record starts, which with the file is its stable
id, and a map from key to the list of its values.  A line that is ``//`` alone ends a record, a line
that starts with one ``/`` goes on with the value before it, blank lines and ``#`` comments are skipped,
other lines split at their first `` - ``.  Bytes are decoded as ``encoding`` (ISO-8859-1).

Batches cut every file into ranges of ``splitbytes``; a record belongs to the range in which it starts,
so one long file is read by many tasks, and a task holds one record and one ``CHUNK`` at a time.  A
stream's offset is the end of the last complete record of every file: files may be added and may
grow, a record that is still being written waits, and a restart goes on where the checkpoint ends.

Files are opened with pyarrow's file systems (local paths, HDFS and object stores).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

CHUNK = 1 << 20
SPLIT = 32 << 20
END = b"\n//\n"
SCHEMA = "file string, start bigint, attrs map<string, array<string>>"


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


def _open(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the data files at or below a path, hidden ones left out, in order."""
    from pyarrow import fs
    system, root = _open(path)
    info = system.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size) for f in found
                  if f.type == fs.FileType.File and not f.path.rsplit("/", 1)[-1].startswith(("_", ".")))


def parse(record: str) -> dict[str, list[str]]:
    attrs: dict[str, list[str]] = {}
    last = None
    for line in record.split("\n"):
        line = line.rstrip("\r")
        if line.startswith("/") and not line.startswith("//"):
            if last is not None:
                attrs[last][-1] += " " + line[1:].strip()
        elif line.strip() and not line.startswith("#") and " - " in line:
            last, value = line.split(" - ", 1)
            attrs.setdefault(last, []).append(value)
    return attrs


def records(path: str, start: int, end: int, root: str) -> Iterator[tuple[int, bytes]]:
    """(first byte, bytes) of the records that start in [start, end)."""
    system, _ = _open(root)
    with system.open_input_file(path) as f:
        size = f.size()
        # a terminator may lie across the range's edge; the line end before the file's first byte is taken for granted
        at = max(0, start - len(END))
        f.seek(at)
        held, first = (b"" if at else b"\n"), (at if at else -1)
        inside = start == 0
        begin = 0
        while True:
            cut = held.find(END)
            while cut < 0:
                more = f.read(CHUNK)
                if not more:
                    break
                seen = max(0, len(held) - len(END) + 1)
                held += more
                cut = held.find(END, seen)
            if cut < 0:
                tail = held[:-3] if held.endswith(b"\n//") else held
                if inside and begin < end and tail.strip():
                    yield begin, tail
                return
            if inside and begin < end:
                yield begin, held[:cut]
            elif inside:
                return
            # the line end of the terminator may begin the next one
            step = cut + len(END) - 1
            held, first = held[step:], first + step
            begin, inside = first + 1, True
            if begin < start:
                inside = False
            if begin >= min(end, size):
                return


def complete(path: str, size: int, root: str) -> int:
    """End of the last complete record among the first ``size`` bytes."""
    system, _ = _open(root)
    with system.open_input_file(path) as f:
        stop, tail = size, b""
        while stop > 0:
            start = max(0, stop - CHUNK)
            f.seek(start)
            tail = f.read(stop - start) + tail[:len(END) - 1]
            at = tail.rfind(END)
            if at >= 0:
                return start + at + len(END)
            if start == 0 and tail.startswith(END[1:]):
                return len(END) - 1
            stop = start
    return 0


def _rows(part: Range, root: str, encoding: str):
    for start, raw in records(part.path, part.start, part.end, root):
        attrs = parse(raw.decode(encoding))
        if attrs:
            yield part.path, start, attrs


class _Options:
    def __init__(self, options: dict):
        self.root = options.get("path") or ""
        self.encoding = options.get("encoding", "ISO-8859-1")
        self.split = int(options.get("splitbytes", SPLIT))
        if not self.root:
            raise ValueError("load(path) names no path")

    def ranges(self, path: str, start: int, end: int) -> list[Range]:
        return [Range(path, a, min(a + self.split, end)) for a in range(start, end, self.split)]


class _Reader(_Options, DataSourceReader):
    def partitions(self):
        return [r for path, size in list_files(self.root) for r in self.ranges(path, 0, size)] or [Range("", 0, 0)]

    def read(self, partition):
        return _rows(partition, self.root, self.encoding) if partition.path else iter(())


class _StreamReader(_Options, DataSourceStreamReader):
    def initialOffset(self):
        return {"files": "{}"}

    def latestOffset(self):
        return {"files": json.dumps({p: e for p, n in list_files(self.root) if (e := complete(p, n, self.root))}, sort_keys=True)}

    def partitions(self, start, end):
        before, now = json.loads(start["files"]), json.loads(end["files"])
        return [r for p, e in sorted(now.items()) for r in self.ranges(p, before.get(p, 0), e)]

    def read(self, partition):
        return _rows(partition, self.root, self.encoding)

    def commit(self, end):
        pass


class RecordSource(DataSource):
    @classmethod
    def name(cls):
        return "sievekit_records"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)
