"""Repositories as a Python data source: folders are listed by tasks, ignored ones are never opened."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracelake.packaging import ship

from .tables import IGNORED, KEPT

#: What the files of an extension are.
TYPES = {"ts": "typescript", "tsx": "typescript-react", "js": "javascript", "jsx": "javascript-react", "json": "json"}


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


def _entries(folder: str) -> list[os.DirEntry]:
    with os.scandir(folder) as found:
        return sorted(found, key=lambda e: e.name)


class RepositoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].removeprefix("file://").rstrip("/") or "/"
        self.names = [n for n in options.get("names", "").split(",") if n]
        self.kept = [k for k in options.get("extensions", ",".join(KEPT)).split(",") if k]
        self.ignored = set(options.get("ignored", ",".join(IGNORED)).split(","))
        self.folders = int(options.get("folders", "64"))

    def partitions(self) -> list[Folder]:
        """One task for each folder, of the uppermost levels until there are enough; those opened here are listed flat."""
        if not os.path.exists(self.root):
            raise ValueError(f"Repository path does not exist: {self.root}")
        if not os.path.isdir(self.root):
            raise ValueError(f"Repository path is not a directory: {self.root}")
        flat, level = [], [self.root]
        while level and len(flat) + len(level) < self.folders:
            below = []
            for folder in level:
                flat.append(folder)
                try:
                    below += [e.path for e in _entries(folder) if e.is_dir(follow_symlinks=False) and e.name not in self.ignored]
                except OSError:
                    pass  # its own task reports it
            level = below
        return [*(Folder(p, False) for p in flat), *(Folder(p, True) for p in level)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        todo = [partition.path]
        while todo:
            folder = todo.pop()
            try:
                entries = _entries(folder)
            except OSError as error:
                yield self.root, os.path.relpath(folder, self.root), None, None, None, f"Cannot read repository directory: {error.strerror}"
                continue
            for e in entries:
                if e.is_dir(follow_symlinks=False):
                    if partition.deep and e.name not in self.ignored:
                        todo.append(e.path)
                elif e.is_file(follow_symlinks=False):
                    extension = os.path.splitext(e.name)[1].lower().lstrip(".")
                    if e.name in self.names if self.names else extension in self.kept:
                        yield self.root, os.path.relpath(e.path, self.root).replace(os.sep, "/"), extension, TYPES.get(extension), e.stat().st_size, None


class RepositorySource(DataSource):
    """spark.read.format("repository").load(path). Options: names (exact file names instead of extensions), extensions, ignored,
    folders (how many tasks at least, if there are so many folders)."""

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return "root string, path string, extension string, type string, size_bytes bigint, error string"

    def reader(self, schema) -> RepositoryReader:
        return RepositoryReader(dict(self.options))


def scan_repository(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """(root, path, extension, type, size_bytes, error) of the source files below a folder that all executors see. A folder that
    cannot be read is a row with an error; a root that is not there, or is no folder, fails."""
    ship(spark).dataSource.register(RepositorySource)
    return spark.read.format("repository").options(**options).load(root)


def named_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The files of one name below a folder."""
    return scan_repository(spark, root, names=name).filter("error is null")
