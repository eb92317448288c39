"""What the corpus operators share: table paths, written intermediates and text primitives as Spark expressions."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The white space that separates words; as a character class for Java, Python and DuckDB.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's ``spark.checkpoint.dir``. Where it is unset, a local master gets a folder
    of its own, and a cluster gets an error, as its machines don't see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='paperloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths of intermediate tables by open scope, the innermost last.
_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the intermediate tables written inside once it ends, but for lasting ones, which belong to the scope around."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _deleted(spark, path)


def _deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def removed(df: DataFrame) -> None:
    """Deletes a table that ``written`` wrote."""
    path = re.match(r".*/paperloom/[^/]+", df.inputFiles()[0]) if df.inputFiles() else None
    if path:
        _deleted(df.sparkSession, path[0])


def swept(spark: SparkSession) -> None:
    """Lets go of the shuffle files of finished jobs, which else stay until the driver happens to collect its garbage. Plans are let go
    of by Python first and then by the JVM, whose cleaner runs beside; so it takes two rounds."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def written(df: DataFrame, label: str, lasting: bool = False) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet into the shared folder and reads it again with the same schema. ``lasting``: it outlives
    the innermost ``scratch``."""
    path = f"{shared_dir(df.sparkSession)}/paperloom/{label}-{uuid.uuid4().hex}"
    if len(_scopes) > lasting:
        _scopes[-1 - lasting].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column | str) -> Column:
    """Lower-cases A-Z only. Pure ASCII text takes the fast built-in, other text a character map."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column | str) -> Column:
    """The array of words ``[^\\x20\\x09-\\x0D]+``; empty for null or blank text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row: a lambda variable, which Catalyst never inlines."""
    return F.element_at(F.transform(F.array(value), body), 1)
