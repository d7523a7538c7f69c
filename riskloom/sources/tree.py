"""Source trees as a Spark data source.

Spark's own file sources hide names that begin with ``_`` or ``.``; this one
walks by the engine's rule: directories named ``target`` or ``.git`` below the
root are passed over, at any depth, and files whose extension is ``rs`` kept.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import BAD_FILE

PASSED = {"target", ".git"}
#: Files that one task reads.
FILES = 64


def walk(root: str, extension: str = ".rs") -> list[str]:
    """Canonical paths of the files below *root*, each once, sorted.  Links are
    followed; a directory met again is not entered again."""
    found, seen, todo = set(), set(), [root]
    while todo:
        d = os.path.realpath(todo.pop())
        if d in seen:
            continue
        seen.add(d)
        for entry in os.scandir(d):
            if entry.is_dir():
                if entry.name not in PASSED:
                    todo.append(entry.path)
            elif os.path.splitext(entry.name)[1] == extension:
                found.add(os.path.realpath(entry.path))
    return sorted(found)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.roots = [r for r in options.get("roots", options.get("path", "")).split(os.pathsep) if r]
        self.extension = options.get("extension", ".rs")

    def partitions(self):
        paths = sorted({p for r in self.roots for p in walk(r, self.extension)})
        return [_Files(paths[i : i + FILES]) for i in range(0, len(paths), FILES)] or [_Files([])]

    def read(self, partition):
        for path in partition.paths:
            try:
                with open(path, encoding="utf-8", newline="") as f:
                    content = f.read()
            except (OSError, UnicodeDecodeError) as e:
                raise RuntimeError(f"{BAD_FILE} {path}: {e}") from None
            yield path, content


class SourceTree(DataSource):
    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return "file string, content string"

    def reader(self, schema):
        return _Reader(self.options)


def read_sources(spark: SparkSession, roots: list[str], extension: str = ".rs") -> DataFrame:
    """file, content of the source files below *roots*; overlapping roots give a file once."""
    from ..session import ship

    ship(spark)
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("roots", os.pathsep.join(roots)).option("extension", extension).load()
