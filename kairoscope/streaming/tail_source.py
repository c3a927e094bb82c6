"""A streaming source of the lines of files that grow.

The offset of a file is the byte behind its last whole line, with a digest of its first line. A batch
has the lines between two offsets, in splits that begin at any byte: a split has the lines that begin
in it. What follows the last line end waits for its rest. A file that is shorter than its offset, or
begins with another first line, was truncated or replaced and is read from its begin. Progress is in
the checkpoint of the stream alone, so a batch whose sink failed is read again, with the same lines.

Lines that are empty or not UTF-8 are left out. Files are reached by pyarrow's file systems.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a split, of a read, and of a first line that its digest covers.
SPLIT, BLOCK, HEAD = 64 << 20, 1 << 20, 1024
SCHEMA = "file string, begin long, line string"


class Split(InputPartition):
    def __init__(self, file: str, first: int, begin: int, end: int, stop: int):
        """Lines that begin from ``begin`` to before ``end``, in a batch that has the bytes from ``first`` to before ``stop``."""
        self.file, self.first, self.begin, self.end, self.stop = file, first, begin, end, stop


def _last_line_end(file, size: int) -> int:
    """The byte behind the last line end."""
    at = size
    while at > 0:
        begin = max(0, at - BLOCK)
        file.seek(begin)
        found = file.read(at - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    return 0


def _first_line(file) -> str:
    """A digest that stays while a file only grows, once it has a whole line."""
    file.seek(0)
    return hashlib.sha256(file.read(HEAD).split(b"\n")[0]).hexdigest()[:16]


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def _files(self) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
        system, base = fs.FileSystem.from_uri(self.path)
        selector = fs.FileSelector(base, recursive=True, allow_not_found=True)
        found = [system.get_file_info(base)] if system.get_file_info(base).is_file else system.get_file_info(selector)
        return system, [f for f in found if f.is_file and not f.base_name.startswith((".", "_"))]

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, found = self._files()
        out = {}
        for info in sorted(found, key=lambda f: f.path):
            with system.open_input_file(info.path) as file:
                end = _last_line_end(file, info.size)
                if end:
                    out[info.path] = {"end": end, "head": _first_line(file)}
        return out

    def partitions(self, start: dict, end: dict) -> list[Split]:
        out = []
        for path, now in sorted(end.items()):
            before = start.get(path, {"end": 0, "head": now["head"]})
            first = before["end"] if before["head"] == now["head"] and before["end"] <= now["end"] else 0
            out += [Split(path, first, a, min(a + self.split, now["end"]), now["end"]) for a in range(first, now["end"], self.split)]
        return out

    def read(self, partition: Split) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(partition.file) as file:
            at = partition.begin if partition.begin == partition.first else partition.begin - 1
            skip = at < partition.begin  # the line that the byte before belongs to is another split's
            file.seek(at)
            rest, begin = b"", at
            while begin < partition.end or skip:
                block = file.read(min(BLOCK, partition.stop - at))
                if not block:
                    break
                at += len(block)
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    if begin >= partition.end and not skip:
                        return
                    if not skip and line:
                        try:
                            yield partition.file, begin, line.decode("utf-8")
                        except UnicodeDecodeError:
                            pass
                    begin += len(line) + 1
                    skip = False


class GrowingLines(DataSource):
    """Format ``growing_lines``; options: path (a file or folder as a URI), split (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("split", SPLIT)))


def stream_lines(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """file, begin (byte), line of what is added to the files below ``path`` (a URI, or an absolute local path)."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("path", path).option("split", split).load()
