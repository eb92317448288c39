"""A response cache as a table: latest value, expiry, least-recent eviction, prefix invalidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_of(*parts: str | Column) -> Column:
    """md5 of the parts joined by colons."""
    return F.md5(F.concat_ws(":", *parts))


def latest(entries: DataFrame, key: str, at: str, tie: str, value: str) -> DataFrame:
    """The last value of each key; one partial aggregate, no sort."""
    return entries.groupBy(key).agg(F.max_by(value, F.struct(at, tie)).alias(value), F.max(at).alias(at))


def unexpired(entries: DataFrame, at: str, seconds: int, now: Column) -> DataFrame:
    return entries.where(F.col(at) + F.expr(f"INTERVAL {int(seconds)} SECONDS") > now)


def most_recent_keys(entries: DataFrame, key: str, at: str, size: int) -> DataFrame:
    """The ``size`` keys used last; ties go to the lower key. Keys are aggregated before the top is taken."""
    used = entries.groupBy(key).agg(F.max(at).alias(at))
    return used.orderBy(F.desc(at), key).limit(size)


def without_prefix(entries: DataFrame, key: str, prefix: str) -> DataFrame:
    return entries.where(~F.startswith(F.col(key), F.lit(prefix)))


def gaps(entries: DataFrame, by: str, at: str, tie: str, least: float) -> DataFrame:
    """Entries with the seconds since the one before, and whether that is less than allowed."""
    before = F.lag(at).over(Window.partitionBy(by).orderBy(at, tie))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = (micros(F.col(at)) - micros(before)) / 1e6
    return entries.withColumn("gap", F.round(gap, 3)).withColumn("too_soon", F.coalesce(gap < least, F.lit(False)))
