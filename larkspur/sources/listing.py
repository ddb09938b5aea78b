"""A directory tree as a Spark data source: each first-level folder is a partition, links are never followed."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, parent string, name string, kind string, size long, allocated long, modified long, changed long, native_id long, device long, link_count long, error string"


def entry(path: str) -> tuple:
    parent, name = os.path.split(path)
    try:
        s = os.lstat(path)
    except OSError as e:
        return (path, parent, name, "file", *[None] * 7, e.strerror)
    kind = "reparse" if stat.S_ISLNK(s.st_mode) else "directory" if stat.S_ISDIR(s.st_mode) else "file"
    return (path, parent, name, kind, s.st_size, getattr(s, "st_blocks", 0) * 512, s.st_mtime_ns, s.st_ctime_ns, s.st_ino, s.st_dev, s.st_nlink, None)


def walk(root: str, deep: bool = True) -> Iterator[tuple]:
    """The folder, then what is below; a parent comes before its children."""
    yield entry(root)
    todo = [root]
    while todo:
        folder = todo.pop()
        try:
            names = sorted(os.listdir(folder))
        except OSError as e:
            yield (folder, os.path.dirname(folder), os.path.basename(folder), "directory", *[None] * 7, e.strerror)
            continue
        for name in names:
            row = entry(os.path.join(folder, name))
            if row[3] == "directory" and not deep:
                continue
            yield row
            if row[3] == "directory":
                todo.append(row[0])


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        folders = sorted(e.path for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False))
        return [InputPartition(("top", self.root)), *(InputPartition(("tree", f)) for f in folders)]

    def read(self, partition):
        kind, path = partition.value
        yield from walk(path, deep=kind == "tree")


class TreeSource(DataSource):
    @classmethod
    def name(cls):
        return "larkspur_tree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])


def tree(spark: SparkSession, root: str) -> DataFrame:
    """Entries below a folder that all executors can see."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("larkspur_tree").option("path", root).load()
