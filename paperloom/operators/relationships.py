"""Operators over relationships: filters, thresholds and the merge of two sources."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_entity(nested: DataFrame, column: str, value: str) -> DataFrame:
    """Relationships in whose entity array some entity has the value as its text or its id; each stays once."""
    return nested.where(F.exists(column, lambda e: (e["label"] == value) | (e["identifier"] == value)))


def passes(scores: Column, threshold: float | None) -> Column:
    """True without a threshold or scores, else if some score reaches the threshold."""
    if threshold is None:
        return F.lit(True)
    return scores.isNull() | F.exists(scores, lambda s: s >= threshold)


def merged(found: DataFrame, scored: DataFrame, key: list[str], entity: str) -> DataFrame:
    """Entities of both sources for each key; the second source's score wins, and an entity without one has 0.

    A union with one aggregate, in place of a full outer join: both sides are shuffled once, partly aggregated.
    """
    rows = found.select(*key, entity, F.lit(None).cast("int").alias("score")).unionByName(scored.select(*key, entity, F.col("score").cast("int").alias("score")))
    return rows.groupBy(*key, entity).agg(F.coalesce(F.max("score"), F.lit(0)).alias("score"))


def variant_key(identifier: str, label: str) -> Column:
    return F.coalesce(F.nullif(F.col(identifier), F.lit("")), F.nullif(F.col(label), F.lit("")))


def usable(rels: DataFrame, variant: str = "variant", others: tuple[str, ...] = ("gene", "disease")) -> DataFrame:
    """Relationships that name a variant and at least one of ``others``; an empty string names nothing."""
    named = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return rels.where(named(variant) & reduce(or_, [named(c) for c in others]))


def reaching(rels: DataFrame, threshold: float | None, scores: tuple[str, ...]) -> DataFrame:
    """Relationships each of whose score lists is null or has a score that reaches the threshold; a list of no scores reaches none."""
    out = rels
    for c in scores:
        out = out.where(passes(F.col(c), threshold))
    return out
