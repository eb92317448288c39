"""Answers of a model kept in a table that outlives the run, so that a prompt is asked once.

The table is a folder: ``base-<n>`` holds the entries of version n, each run adds what it had to ask as ``add-<n>-...``, and an empty file
``current-<n>`` says which version holds; the greatest counts. ``compacted`` writes the latest good entry of each key as the next base, then
makes its ``current`` file, and only then deletes what it read. Whoever reads sees the version before or after, never half of one, and what is
added meanwhile moves over to the next version.

An entry has a checksum of its answer. One whose checksum doesn't hold, a file that can't be read, and an entry older than ``ttl`` seconds are
misses: the prompt is asked anew and the new entry, being later, replaces the old one.

Cases: a null prompt is the empty one; repeated prompts are asked once; a model that fails fails the run, and nothing of it is added; an
answer of null is no entry and is asked again next time; a missing folder is an empty cache.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.sources import folders

ENTRY = "key string, answer string, checksum string, at timestamp"


def key_of(model: str, prompt: Column | str, settings: Column | None = None) -> Column:
    """md5 of model, prompt and settings (a map) in a canonical form: JSON with names in order, so that the order in which settings were given doesn't matter."""
    prompt = F.col(prompt) if isinstance(prompt, str) else prompt
    settings = F.lit(None).cast("map<string,string>") if settings is None else settings
    ordered = F.map_from_entries(F.array_sort(F.map_entries(settings)))
    return F.md5(F.to_json(F.struct(F.lit(model).alias("model"), F.coalesce(prompt, F.lit("")).alias("prompt"), ordered.alias("settings"))))


def version(spark: SparkSession, path: str) -> int:
    return max((int(n.removeprefix("current-")) for n in folders.children(spark, path) if n.startswith("current-")), default=0)


def _parts(spark: SparkSession, path: str, n: int) -> list[str]:
    return [name for name in folders.children(spark, path) if name == f"base-{n}" or name.startswith(f"add-{n}-")]


def _read(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).option("ignoreCorruptFiles", True).parquet(*[f"{path}/{p}" for p in parts])


def _good(entries: DataFrame, now: Column, ttl: float | None) -> DataFrame:
    """The latest entry of each key whose checksum holds and that isn't too old."""
    good = entries.where(F.col("answer").isNotNull() & (F.col("checksum") == F.md5("answer")))
    if ttl is not None:
        good = good.where(F.unix_micros("at") + int(ttl * 1e6) > F.unix_micros(now))
    return good.groupBy("key").agg(F.max_by(F.struct("answer", "checksum", "at"), F.struct("at", "answer")).alias("e")).select("key", "e.*")


def entries(spark: SparkSession, path: str, ttl: float | None = None, now: Column | None = None) -> DataFrame:
    """key, answer, checksum, at of all entries that would be hits."""
    return _good(_read(spark, path, _parts(spark, path, version(spark, path))), F.current_timestamp() if now is None else now, ttl)


def answered(
    prompts: DataFrame, path: str, complete: Callable[[DataFrame], DataFrame], model: str, settings: Column | None = None, ttl: float | None = None, now: Column | None = None
) -> DataFrame:
    """prompt, answer, source (``cache`` or ``model``) of each distinct prompt. ``complete`` adds ``answer`` to a table of prompts; it gets
    only those without an entry, and its answers are in the cache before this returns."""
    spark, now = prompts.sparkSession, F.current_timestamp() if now is None else now
    own = F.lit(None).cast("map<string,string>") if settings is None else settings
    wanted = prompts.select(F.coalesce("prompt", F.lit("")).alias("prompt"), key_of(model, "prompt", own).alias("key")).distinct()
    held = entries(spark, path, ttl, now).select("key", "answer")
    add = f"{path}/add-{version(spark, path)}-{uuid.uuid4().hex}"
    asked = complete(wanted.join(held, "key", "left_anti").select("prompt", "key"))
    asked.select("key", "answer", F.md5("answer").alias("checksum"), now.alias("at")).write.parquet(add)
    new = spark.read.schema(ENTRY).parquet(add).select("key", "answer", F.lit("model").alias("source"))
    return wanted.join(held.join(new, "key", "left_anti").withColumn("source", F.lit("cache")).unionByName(new), "key").select("prompt", "answer", "source")


def compacted(spark: SparkSession, path: str, ttl: float | None = None, now: Column | None = None) -> int:
    """Writes the next version; its number."""
    n = version(spark, path)
    parts = _parts(spark, path, n)
    folders.delete(spark, f"{path}/base-{n + 1}")  # of a compaction that didn't end
    _good(_read(spark, path, parts), F.current_timestamp() if now is None else now, ttl).select("key", "answer", "checksum", "at").write.parquet(f"{path}/base-{n + 1}")
    if not folders.create(spark, f"{path}/current-{n + 1}"):
        raise RuntimeError(f"another compaction has made version {n + 1}")
    for late in set(_parts(spark, path, n)) - set(parts):
        folders.move(spark, f"{path}/{late}", f"{path}/{late.replace(f'add-{n}-', f'add-{n + 1}-', 1)}")
    for old in [*parts, f"current-{n}"]:
        folders.delete(spark, f"{path}/{old}")
    return n + 1
