"""New and modified files of a folder as a stream.

The built-in file stream never returns a path that it has seen. This source keeps an index of (path, time of
change, size) and hands out each file again when its time or size changed, as `modified`. The index is a log in a
folder of its own: every offset is the number of a version, and a version is a file with the changes that it found, so a
batch that is replayed gets the same files. Old versions are put together in one. Folders can be local or in any
store that pyarrow.fs reads.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions import fixed

SCHEMA = "path string, event_type string, modificationTime timestamp, length long, content binary"
ARROW = pa.schema([("path", pa.string()), ("event_type", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("content", pa.binary())])
#: Versions after which the log is put together; bytes of files that one task reads, about.
COMPACT, TASK_BYTES = 50, 64 << 20

Known = dict[str, tuple[int, int]]


def wanted(name: str) -> bool:
    """Whether a file's name is that of a file to take in, as files.wanted() tells for columns."""
    dot = name.rfind(".")
    ext = name[dot:].lower() if dot > 0 else ""
    return not name.startswith((".", "~$")) and ext not in fixed.IGNORED_EXTENSIONS and ext in fixed.EXTENSIONS


class Folder:
    """A folder in a store, with paths as Spark spells them."""

    def __init__(self, uri: str):
        self.store, self.at = fs.FileSystem.from_uri(uri)
        self.at = self.at.rstrip("/")
        self.prefix = uri.rstrip("/")[: -len(self.at)] if "://" in uri else "file:"

    def files(self, recursive: bool) -> Iterator[tuple[str, int, int]]:
        """(path, nanoseconds of the last change, size) of the wanted files."""
        for found in self.store.get_file_info(fs.FileSelector(self.at, recursive=recursive, allow_not_found=True)):
            if found.type == fs.FileType.File and wanted(found.base_name):
                yield self.prefix + found.path, int(found.mtime_ns or 0), found.size

    def read(self, path: str) -> bytes:
        with self.store.open_input_stream(path.removeprefix(self.prefix)) as f:
            return f.read()

    def write(self, name: str, data: bytes) -> None:
        """A file that is there whole or not at all."""
        self.store.create_dir(self.at, recursive=True)
        with self.store.open_output_stream(f"{self.at}/.{name}.part") as f:
            f.write(data)
        self.store.move(f"{self.at}/.{name}.part", f"{self.at}/{name}")


class Index:
    """The log of versions: `<n>.json` has the changes of version n, `<n>.all` all files known at n."""

    def __init__(self, uri: str):
        self.folder, self.version, self.known = Folder(uri), 0, {}
        names = [f.base_name for f in self.folder.store.get_file_info(fs.FileSelector(self.folder.at, allow_not_found=True))]
        whole = max((int(n[:-4]) for n in names if n.endswith(".all")), default=0)
        if whole:
            self.known = {p: tuple(x) for p, x in json.loads(self.folder.read(f"{self.folder.prefix}{self.folder.at}/{whole}.all")).items()}
            self.version = whole
        while f"{self.version + 1}.json" in names:
            self.version += 1
            self.known |= {p: (at, size) for p, _, at, size in self.changes(self.version)}

    def changes(self, version: int) -> list[tuple[str, str, int, int]]:
        return [tuple(x) for x in json.loads(self.folder.read(f"{self.folder.prefix}{self.folder.at}/{version}.json"))]

    def add(self, changes: list[tuple[str, str, int, int]]) -> None:
        self.folder.write(f"{self.version + 1}.json", json.dumps(changes).encode())
        self.version += 1
        self.known |= {p: (at, size) for p, _, at, size in changes}

    def compact(self, upto: int) -> None:
        """Puts the versions up to one that is done together, if there are COMPACT of them."""
        store, at = self.folder.store, self.folder.at
        names = {f.base_name for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True))}
        old = sorted(int(n[:-5]) for n in names if n.endswith(".json") and int(n[:-5]) <= upto)
        if len(old) < COMPACT:
            return
        whole = max((int(n[:-4]) for n in names if n.endswith(".all")), default=0)
        known = json.loads(self.folder.read(f"{self.folder.prefix}{at}/{whole}.all")) if whole else {}
        for version in old:
            known |= {p: (when, size) for p, _, when, size in self.changes(version)}
        self.folder.write(f"{old[-1]}.all", json.dumps(known).encode())
        for name in [f"{v}.json" for v in old] + [f"{whole}.all"] * bool(whole):
            store.delete_file(f"{at}/{name}")


class Files(InputPartition):
    def __init__(self, changes: list[tuple[str, str, int, int]]):
        self.changes = changes


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.log = options["path"], options["index"]
        self.recursive, self.most, self.settle = options.get("recursive", "true").lower() == "true", int(options.get("maxfiles", 0)), float(options.get("settle", 0))
        self.index: Index | None = None

    def _index(self) -> Index:
        if self.index is None:
            self.index = Index(self.log)
        return self.index

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        """A version with what changed since the last one; files that changed less than `settle` seconds ago wait."""
        index, old = self._index(), time.time_ns() - int(self.settle * 1e9)
        found = sorted((at, p, "created" if p not in index.known else "modified", size) for p, at, size in Folder(self.path).files(self.recursive) if index.known.get(p) != (at, size) and (not self.settle or at <= old))
        if found:
            index.add([(p, kind, at, size) for at, p, kind, size in found[: self.most or None]])
        return {"version": index.version}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        last: dict[str, tuple] = {}
        for version in range(start["version"] + 1, end["version"] + 1):
            for change in self._index().changes(version):
                # a file that came and changed since the last batch comes once
                last[change[0]] = change if change[0] not in last else (change[0], last[change[0]][1], *change[2:])
        out, size = [], TASK_BYTES
        for change in last.values():
            if size + change[3] > TASK_BYTES:
                out.append(Files([]))
                size = 0
            out[-1].changes.append(change)
            size += change[3]
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        folder = Folder(self.path)
        for path, kind, at, _ in partition.changes:
            try:
                content = folder.read(path)
            except FileNotFoundError:  # it went since
                continue
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([path], [kind], [datetime.fromtimestamp(at / 1e9, UTC)], [len(content)], [content]), ARROW.types, strict=True)], schema=ARROW)

    def commit(self, end: dict) -> None:
        self._index().compact(end["version"])


class FileChanges(DataSource):
    """`spark.readStream.format("file_changes")` with the options path, index, recursive, maxFiles and settle."""

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:
        for name in ("path", "index"):
            if not self.options.get(name):
                raise ValueError(f"file_changes needs the option {name}")
        return Reader({k.lower(): v for k, v in self.options.items()})


def changes(spark: SparkSession, folder: str, index: str, recursive: bool = True, most: int = 0, settle: float = 0.0) -> DataFrame:
    """(path, event_type, modificationTime, length, content): files of a folder as they come (`created`) and each time they change (`modified`).

    index: a folder for the log of this stream, beside its checkpoint. most: files of a batch, at most; 0 for
    no limit. settle: seconds for which a file must not have changed, for writers that take their time.
    """
    spark.dataSource.register(FileChanges)
    return spark.readStream.format("file_changes").option("path", folder).option("index", index).option("recursive", str(recursive).lower()).option("maxFiles", most).option("settle", settle).load()
