"""Streaming source for files that grow, are renamed, cut short or re-created.

Spark's own file source sees new files, not bytes appended to known ones. This source keeps an offset
per file, and knows a file by what it is and not by its name: by a checksum of its first bytes, and its
inode where the file system has one. At every poll

- a file that still begins as before and is no shorter than what was read goes on from there;
- one that was renamed (``run.log`` to ``run.log.1``) is found in its folder, even under a name
  that the pattern does not match, and read to its end;
- a file that was cut short, or whose name now belongs to another file, starts again at 0.

So every line is given once, if it is there at the poll after it was written. The driver lists files and
looks for last newlines; the bytes are read by the executors, in ranges. Files are reached through
``pyarrow.fs``, by plain paths or by addresses such as ``hdfs://``; wildcards may stand in any part.

With ``maxBytesPerBatch`` a micro-batch takes about so many bytes; a line is never cut. As Spark does not
tell a restarted reader where it stopped, the reader then also notes its offsets in the folder ``state``.
"""

from __future__ import annotations

import io
import json
import os
import zlib
from collections.abc import Iterator
from fnmatch import fnmatchcase

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "tail_lines"
SCHEMA = "file string, offset bigint, value string"
#: First bytes of a file that tell it from others.
HEAD = 512


class ByteRange(InputPartition):
    """Lines that start in [start, end) of a file; the range before begins at ``base``."""

    def __init__(self, entry: dict, base: int, start: int, end: int) -> None:
        self.entry, self.base, self.start, self.end = entry, base, start, end


class Folder:
    """The files behind a pattern, on any file system."""

    def __init__(self, pattern: str) -> None:
        if pattern.startswith("file:") and not pattern.startswith("file://"):
            pattern = "file://" + pattern.removeprefix("file:")
        self.pattern = pattern
        plain = "://" not in pattern
        fixed = []
        for name in pattern.split("/")[:-1]:
            if any(c in name for c in "*?["):
                break
            fixed.append(name)
        root = "/".join(fixed) or "/"
        self.store, self.root = (fs.LocalFileSystem(), root) if plain else fs.FileSystem.from_uri(root)
        self.wanted = pattern[len(root) :].strip("/").split("/")

    def files(self) -> dict[str, fs.FileInfo]:
        """All files below the fixed part of the pattern, as deep as it goes."""
        selector = fs.FileSelector(self.root, allow_not_found=True, recursive=len(self.wanted) > 1)
        return {f.path: f for f in self.store.get_file_info(selector) if f.type == fs.FileType.File}

    def matches(self, path: str) -> bool:
        parts = path[len(self.root) :].strip("/").split("/")
        return len(parts) == len(self.wanted) and all(map(fnmatchcase, parts, self.wanted))

    def inode(self, path: str) -> int:
        """0 where the file system has none."""
        if not isinstance(self.store, fs.LocalFileSystem):
            return 0
        try:
            return os.stat(path).st_ino
        except FileNotFoundError:
            return 0

    def checksum(self, path: str, n: int) -> int:
        with self.store.open_input_file(path) as file:
            return zlib.crc32(file.read(n))

    def same(self, entry: dict, path: str, size: int) -> bool:
        """Whether ``path`` now holds the file of an offset entry."""
        inode = self.inode(path)
        if size < entry["at"] or (inode and entry["inode"] and inode != entry["inode"]):
            return False
        if not entry["head"]:
            return bool(inode) or path == entry["path"]
        return self.checksum(path, entry["head"]) == entry["crc"]

    def find(self, entry: dict, files: dict[str, fs.FileInfo]) -> str | None:
        """Where the file of an entry is now: under its name, or another one in its folder."""
        own = entry["path"]
        if own in files and self.same(entry, own, files[own].size):
            return own
        home = own.rsplit("/", 1)[0]
        for path, info in files.items():
            if path != own and path.rsplit("/", 1)[0] == home and entry["head"] and self.same(entry, path, info.size):
                return path
        return None

    def last_line_end(self, path: str, known: int, size: int, most: int | None, step: int = 65_536) -> int:
        """Offset behind the last newline, not before ``known``; behind the first one after ``most`` bytes if that is earlier."""
        with self.store.open_input_file(path) as file:
            end = size if most is None else min(size, known + most)
            at = end
            while at > known:
                begin = max(known, at - step)
                file.seek(begin)
                found = file.read(at - begin).rfind(b"\n")
                if found >= 0:
                    return begin + found + 1
                at = begin
            while end < size:  # a line longer than the limit
                file.seek(end)
                piece = file.read(min(step, size - end))
                found = piece.find(b"\n")
                if found >= 0:
                    return end + found + 1
                end += len(piece)
        return known


class TailReader(DataSourceStreamReader):
    """Offsets: key -> {path, at, inode, head (bytes in the checksum), crc}; a name that passes to another file gets a new key."""

    def __init__(self, options: dict[str, str]) -> None:
        self.pattern = options["path"]
        self.range_bytes = int(options.get("rangeBytes", 64 << 20))
        self.most = int(options["maxBytesPerBatch"]) if options.get("maxBytesPerBatch") else None
        self.state = options.get("state")
        self.lossy = options.get("failOnDataLoss", "true").lower() == "false"
        if self.most and not self.state:
            raise ValueError("maxBytesPerBatch needs a folder for its offsets: option state")
        self.known: dict[str, dict] = {}
        self.fresh = True

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        if self.fresh and self.state:
            self.known = _noted(self.state) or self.known
        self.fresh = False
        before = json.dumps(self.known)
        self.poll()
        if self.state and json.dumps(self.known) != before:
            _note(self.state, self.known)
        return dict(self.known)

    def poll(self) -> None:
        """Find every file again, add new ones, and move the offsets to the ends of lines."""
        folder = Folder(self.pattern)
        files = folder.files()
        found = {key: folder.find(entry, files) for key, entry in self.known.items()}
        entries = {key: {**entry, "path": found[key] or entry["path"]} for key, entry in self.known.items()}
        taken = {path for path in found.values() if path}
        for path in sorted(files):
            if path not in taken and folder.matches(path):
                number = sum(key.rpartition("#")[0] == path for key in entries)
                entries[f"{path}#{number}"] = {"path": path, "at": 0, "inode": folder.inode(path), "head": 0, "crc": 0}
                found[f"{path}#{number}"] = path
        grown = [key for key, path in found.items() if path and files[path].size > entries[key]["at"]]
        share = None if self.most is None else max(1, self.most // max(1, len(grown)))
        for key in grown:
            entry = entries[key]
            entry["at"] = folder.last_line_end(entry["path"], entry["at"], files[entry["path"]].size, share)
            if entry["head"] < min(HEAD, entry["at"]):
                entry["head"] = min(HEAD, entry["at"])
                entry["crc"] = folder.checksum(entry["path"], entry["head"])
        self.known = entries

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        self.known = self.known or end
        parts = []
        for key, entry in end.items():
            base = start.get(key, {}).get("at", 0)
            for begin in range(base, entry["at"], self.range_bytes):
                parts.append(ByteRange(entry, base, begin, min(begin + self.range_bytes, entry["at"])))
        return parts

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        folder = Folder(self.pattern)
        path = partition.entry["path"]
        info = folder.store.get_file_info(path)
        if info.type != fs.FileType.File or not folder.same(partition.entry, path, info.size):
            path = folder.find(partition.entry, folder.files())  # renamed since the offsets were made
        if path is None:
            if self.lossy:
                return
            raise FileNotFoundError(f"the lines of {partition.entry['path']} are gone; failOnDataLoss=false skips them")
        with folder.store.open_input_file(path) as raw:
            file = io.BufferedReader(raw, 1 << 20)
            at = partition.start
            if at > partition.base:  # the line in progress belongs to the range before
                file.seek(at - 1)
                at += len(file.readline()) - 1
            else:
                file.seek(at)
            while at < partition.end:
                line = file.readline()
                if not line:
                    return
                yield partition.entry["path"], at, line.decode("utf-8", "replace").strip()
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


def _noted(state: str) -> dict | None:
    """The offsets noted last."""
    folder = Folder(f"{state}/offsets-*.json")
    names = sorted(path for path in folder.files() if folder.matches(path))
    for path in reversed(names):
        with folder.store.open_input_stream(path) as file:
            try:
                return json.loads(file.read())
            except ValueError:  # the reader was lost while it wrote
                continue
    return None


def _note(state: str, offsets: dict) -> None:
    """Note offsets under the next number; the two notes before stay."""
    folder = Folder(f"{state}/offsets-*.json")
    folder.store.create_dir(folder.root, recursive=True)
    names = sorted(path for path in folder.files() if folder.matches(path))
    number = int(names[-1][-17:-5]) + 1 if names else 0
    with folder.store.open_output_stream(f"{folder.root}/offsets-{number:012d}.json") as file:
        file.write(json.dumps(offsets).encode())
    for path in names[:-1]:
        folder.store.delete_file(path)


class TailLines(DataSource):
    """``readStream.format("tail_lines").load(pattern)``; options ``rangeBytes`` (size of a read),
    ``maxBytesPerBatch`` with ``state``, ``failOnDataLoss``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TailLines)
