"""A repository's folders as a Spark data source (SRC-01): ignored folders are never opened.

The driver opens folders level by level, reading names alone, until there are enough of them to share out; each task
then walks its own. Names with a dot in front are files like others, links are not followed.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphloom.shipping import on_path

#: Folders to share out among tasks, as far as a repository has them.
PARTS = 64
#: Bytes of contents that a batch of rows holds, unless one file has more.
BATCH = 8 << 20


@dataclass
class Folder(InputPartition):
    """A folder below the root: with all below it, or its own files alone."""

    path: str
    whole: bool


def keeper(patterns: list[tuple[str, bool]]):
    """Whether a relative path stays: the last pattern that fits decides. Paths of folders end with a slash."""
    compiled = [(re.compile(body), keeps) for body, keeps in patterns]

    def keep(path: str) -> bool:
        return next((keeps for body, keeps in reversed(compiled) if body.search(path)), True)

    return keep


class Reader(DataSourceReader):
    def __init__(self, root: str, patterns: list[tuple[str, bool]]):
        self.root, self.patterns = root, patterns

    def entries(self, folder: str) -> Iterator[tuple[str, bool]]:
        """(relative path, whether it is a folder) of what a folder keeps."""
        keep = keeper(self.patterns)
        with os.scandir(os.path.join(self.root, folder)) as found:
            for entry in sorted(found, key=lambda e: e.name):
                path = f"{folder}/{entry.name}" if folder else entry.name
                if entry.is_dir(follow_symlinks=False):
                    if keep(path + "/"):
                        yield path, True
                elif entry.is_file(follow_symlinks=False) and keep(path):
                    yield path, False

    def partitions(self) -> list[InputPartition]:
        opened: list[str] = []
        level = [""]
        while level and len(level) < PARTS:
            opened += level
            level = [path for folder in level for path, deeper in self.entries(folder) if deeper]
        return [Folder(f, False) for f in opened] + [Folder(f, True) for f in level]

    def files(self, part: Folder) -> Iterator[str]:
        todo = [part.path]
        while todo:
            for path, deeper in self.entries(todo.pop()):
                if not deeper:
                    yield path
                elif part.whole:
                    todo.append(path)

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        paths: list[str] = []
        contents: list[bytes] = []
        for path in self.files(partition):
            try:
                with open(os.path.join(self.root, path), "rb") as file:
                    contents.append(file.read())
            except OSError:  # a file that cannot be read is listed, and empty
                contents.append(b"")
            paths.append(path)
            if sum(map(len, contents)) >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])
                paths, contents = [], []
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])


class Repository(DataSource):
    """spark.read.format("repository").option("root", folder).option("patterns", JSON of (pattern, keeps))."""

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema) -> Reader:
        return Reader(self.options["root"], [tuple(p) for p in json.loads(self.options.get("patterns", "[]"))])


def read(spark: SparkSession, root: str, patterns: list[tuple[str, bool]]) -> DataFrame:
    """(path, content) of the files below a folder that driver and executors see under one path."""
    on_path(spark)
    spark.dataSource.register(Repository)
    return spark.read.format("repository").option("root", root).option("patterns", json.dumps(patterns)).load()
