"""A Spark data source of source files: a partitioned listing of a folder below a root, and a writer of one file a row.

    spark.dataSource.register(SourceFiles)
    spark.read.format("source_files").option("root", "/code").option("path", "src").option("texts", "true").load()
    df.write.format("source_files").option("root", "/code").option("path", "out").mode("overwrite").save()

The root may be a path or an address of any file system that Arrow opens (file, hdfs, s3, gs, abfs). What is read or written
must lie below it, links followed. The driver lists the folder's own entries; tasks list what is below them, and read texts
only if asked. A text that isn't UTF-8 is null. A task holds a few entries and texts at once, of a folder of any size; where
the file system isn't a local one, Arrow lists each single folder as a whole.

The writer takes rows of (path, text). Files are written beside the target, each under another name and then renamed, so a
task that runs twice leaves one file. The commit names the whole folder at once when it overwrites, or moves the files into
one that is there when it appends; a job that fails leaves nothing.
"""

from __future__ import annotations

import os
import posixpath
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "path string, name string, type string, size long, text string"
_ARROW = pa.schema([("path", pa.string()), ("name", pa.string()), ("type", pa.string()), ("size", pa.int64()), ("text", pa.string())])
#: So many entries, or bytes of texts and a text, leave a task at once.
ENTRIES, TEXT_BYTES = 1024, 1 << 20


class Place(NamedTuple):
    """A folder of a file system, and what of its path is above the paths that are told."""

    uri: str
    base: str

    def open(self) -> arrow_fs.FileSystem:
        return arrow_fs.FileSystem.from_uri(self.uri)[0]


def place(options: dict) -> Place:
    root = options.get("root")
    if not root:
        raise ValueError("source_files needs a root")
    uri = root if "://" in root or root.startswith("file:") else f"file://{os.path.abspath(root)}"
    uri = "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri
    fs, base = arrow_fs.FileSystem.from_uri(uri)
    return Place(uri, below(fs, base.rstrip("/"), options.get("path", "")))


def below(fs: arrow_fs.FileSystem, base: str, path: str) -> str:
    """The path below the base, if it stays there; else a PermissionError."""
    full = posixpath.normpath(posixpath.join(base, path or "."))
    if isinstance(fs, arrow_fs.LocalFileSystem):
        base, full = os.path.realpath(base), os.path.realpath(full)
    if full != base and not full.startswith(base.rstrip("/") + "/"):
        raise PermissionError(f"{path} is outside {base}")
    return full


@dataclass
class _Entries(InputPartition):
    folders: list[str]
    files: list[str]


def _entries(fs: arrow_fs.FileSystem, folder: str) -> Iterator[arrow_fs.FileInfo]:
    """A folder's own entries; of a local one only a few are held."""
    if not isinstance(fs, arrow_fs.LocalFileSystem):
        yield from fs.get_file_info(arrow_fs.FileSelector(folder, recursive=False))
        return
    with os.scandir(folder) as found:
        while paths := [x.path for x in islice(found, ENTRIES)]:
            yield from fs.get_file_info(paths)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.at = place(options)
        self.texts = options.get("texts", "false").lower() == "true"
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.parts = int(options.get("parts", "32"))

    def partitions(self) -> list[InputPartition]:
        fs = self.at.open()
        info = fs.get_file_info(arrow_fs.FileSelector(self.at.base, recursive=False))
        folders, files = (sorted(x.path for x in info if x.type == kind) for kind in (arrow_fs.FileType.Directory, arrow_fs.FileType.File))
        n = max(1, min(self.parts, len(folders) + len(files)))
        return [_Entries(folders[k::n], files[k::n]) for k in range(n)]

    def read(self, partition: _Entries) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in self.rows(partition):
            rows.append(row)
            held += row[3] or 0 if self.texts else 0
            if len(rows) == ENTRIES or held >= TEXT_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def rows(self, partition: _Entries) -> Iterator[tuple]:
        fs = self.at.open()
        for folder in partition.folders:
            yield from self.told(fs, fs.get_file_info(folder))
            waiting = [folder] if self.recursive else []
            while waiting:
                for info in _entries(fs, waiting.pop()):
                    if info.type == arrow_fs.FileType.Directory:
                        waiting.append(info.path)
                    yield from self.told(fs, info)
        for k in range(0, len(partition.files), ENTRIES):
            for info in fs.get_file_info(partition.files[k : k + ENTRIES]):
                yield from self.told(fs, info)

    def told(self, fs: arrow_fs.FileSystem, info: arrow_fs.FileInfo) -> Iterator[tuple]:
        if info.type == arrow_fs.FileType.NotFound:
            return
        directory, text = info.type == arrow_fs.FileType.Directory, None
        if self.texts and not directory:
            below(fs, self.at.base, info.path)
            with fs.open_input_stream(info.path) as f:
                try:
                    text = f.read().decode("utf-8")
                except UnicodeDecodeError:
                    text = None
        yield (info.path[len(self.at.base) :].lstrip("/"), info.base_name, "directory" if directory else "file", None if directory else info.size, text)


@dataclass
class _Wrote(WriterCommitMessage):
    files: int
    size: int


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.at, self.overwrite = place(options), overwrite
        parent, name = posixpath.split(self.at.base)
        self.staging = f"{parent}/.{name}-{uuid.uuid4().hex}"
        self.at.open().create_dir(self.staging, recursive=True)

    def write(self, iterator) -> _Wrote:
        fs, files, size = self.at.open(), 0, 0
        for row in iterator:
            if fs.get_file_info(self.staging).type == arrow_fs.FileType.NotFound:
                raise OSError("the job has been given up")
            target = below(fs, self.staging, row["path"])
            if target == self.staging:
                raise PermissionError("a row without a path")
            data = (row["text"] or "").encode()
            fs.create_dir(posixpath.dirname(target), recursive=True)
            other = f"{target}.{uuid.uuid4().hex}"
            with fs.open_output_stream(other) as f:
                f.write(data)
            fs.move(other, target)
            files, size = files + 1, size + len(data)
        return _Wrote(files, size)

    def commit(self, messages: list) -> None:
        fs = self.at.open()
        there = fs.get_file_info(self.at.base).type != arrow_fs.FileType.NotFound
        if there and not self.overwrite:
            for info in fs.get_file_info(arrow_fs.FileSelector(self.staging, recursive=True)):
                if info.type == arrow_fs.FileType.File:
                    target = self.at.base + info.path[len(self.staging) :]
                    fs.create_dir(posixpath.dirname(target), recursive=True)
                    fs.move(info.path, target)
            fs.delete_dir(self.staging)
            return
        if there:
            fs.delete_dir(self.at.base)
        fs.create_dir(posixpath.dirname(self.at.base), recursive=True)
        fs.move(self.staging, self.at.base)

    def abort(self, messages: list) -> None:
        # Tasks that are being stopped may still write a file.
        fs, gone = self.at.open(), 0
        while gone < 3:
            gone += 1
            if fs.get_file_info(self.staging).type != arrow_fs.FileType.NotFound:
                fs.delete_dir(self.staging)
                gone = 0
            time.sleep(0.2)


class SourceFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)
