"""Log files read as they grow: a streaming source whose offsets are bytes by file, so that only what was appended is read.

    spark.dataSource.register(LogTail)
    spark.readStream.format("log_tail").option("paths", "/logs/*.log").load()

Rows are source (the path), position (the byte at which the line starts) and line. What a file holds at the start counts as
appended. A last line without its break waits until the break is there. A file that has become shorter, or that is another
file of the name, is read from its start. Long growth is cut into parts, read by different tasks. Files are opened by their
path, so tasks have to reach it: a folder that all machines mount.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

CHUNK = 1 << 16


@dataclass
class Part(InputPartition):
    """Lines of a file that start in lo..hi; first: the byte at which the appended text starts."""

    path: str
    first: int
    lo: int
    hi: int
    end: int


def last_break(path: str, size: int) -> int:
    """The number of bytes up to the file's last line break, looked for from behind."""
    with open(path, "rb") as f:
        while size > 0:
            start = max(0, size - CHUNK)
            f.seek(start)
            found = f.read(size - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            size = start
    return 0


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options["paths"].split("\n") if p]
        self.split = int(options.get("splitbytes", options.get("splitBytes", 1 << 26)))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for path in sorted({p for pattern in self.paths for p in glob.glob(pattern)}):
            try:
                found = os.stat(path)
                out[path] = [found.st_ino, last_break(path, found.st_size)]
            except OSError:  # gone meanwhile
                continue
        return out

    def partitions(self, start: dict, end: dict) -> list[Part]:
        out = []
        for path, (file, size) in end.items():
            was, first = start.get(path, [file, 0])
            first = 0 if was != file or size < first else first
            out += [Part(path, first, lo, min(size, lo + self.split), size) for lo in range(first, size, self.split)]
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            at = partition.lo
            if at > partition.first:  # the line that is under way belongs to the part before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            while at < partition.hi:
                line = f.readline(partition.end - at)
                if not line:  # cut off since
                    return
                yield partition.path, at, line.rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "source string, position bigint, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))
