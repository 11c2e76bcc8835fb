"""Folder metadata through the Hadoop file-system API (names and times only)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import SparkSession


class Entry(NamedTuple):
    name: str
    path: str
    modified: int
    is_dir: bool


def _handle(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _handle(spark, path)
    return fs.exists(target)


def children(spark: SparkSession, path: str) -> list[Entry]:
    """Visible children of a folder, sorted by name; none if it is missing."""
    target, fs = _handle(spark, path)
    if not fs.exists(target):
        return []
    found = [
        Entry(s.getPath().getName(), s.getPath().toString(), s.getModificationTime(), s.isDirectory())
        for s in fs.listStatus(target)
    ]
    return sorted(e for e in found if not e.name.startswith(("_", ".")))


def remove(spark: SparkSession, path: str) -> bool:
    target, fs = _handle(spark, path)
    return fs.delete(target, True)
