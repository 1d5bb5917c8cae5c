"""Folders of any store that Spark reaches, through its own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm = spark._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    system, found = _path(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(found)) if system.exists(found) else []


def exists(spark: SparkSession, path: str) -> bool:
    system, found = _path(spark, path)
    return system.exists(found)


def make(spark: SparkSession, path: str) -> None:
    system, found = _path(spark, path)
    system.mkdirs(found)


def remove(spark: SparkSession, path: str) -> None:
    """The folder and all in it."""
    system, found = _path(spark, path)
    system.delete(found, True)
