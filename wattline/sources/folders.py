"""Folder operations through Hadoop's file system API, so any store Spark can reach works."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, text: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(text)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, text: str) -> bool:
    file_system, path = _path(spark, text)
    return file_system.exists(path)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, in name order."""
    file_system, path = _path(spark, pattern)
    return sorted(status.getPath().toString() for status in file_system.globStatus(path) or [])


def size_bytes(spark: SparkSession, text: str) -> int:
    file_system, path = _path(spark, text)
    return file_system.getContentSummary(path).getLength()


def sizes_below(spark: SparkSession, pattern: str) -> dict[str, int]:
    """Bytes of the files that match a glob, summed by their folder: one listing, however many folders there are."""
    file_system, path = _path(spark, pattern)
    found: dict[str, int] = {}
    for status in file_system.globStatus(path) or []:
        folder = status.getPath().getParent().toString()
        found[folder] = found.get(folder, 0) + status.getLen()
    return found


def remove(spark: SparkSession, text: str) -> None:
    file_system, path = _path(spark, text)
    file_system.delete(path, True)


def create(spark: SparkSession, text: str) -> None:
    file_system, path = _path(spark, text)
    file_system.mkdirs(path)
