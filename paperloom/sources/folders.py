"""Folders that the driver and all executors share, through Spark's file systems."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset, a local master gets a folder of its own, and a cluster gets an error, as its
    machines don't see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='paperloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh(spark: SparkSession, label: str) -> str:
    """The path of a new shared folder; it isn't made yet."""
    return f"{shared(spark)}/paperloom/{label}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no folder."""
    fs, at = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def move(spark: SparkSession, path: str, to: str) -> bool:
    fs, at = _at(spark, path)
    return fs.rename(at, spark._jvm.org.apache.hadoop.fs.Path(to))


def create(spark: SparkSession, path: str) -> bool:
    """Makes an empty file; whether it is new. Of several that try, one makes it."""
    fs, at = _at(spark, path)
    fs.mkdirs(at.getParent())
    return fs.createNewFile(at)
