"""Precision, recall and coverage of predicted pairs against a truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b rounded, null where b is 0."""
    return F.round(a / F.nullif(b, F.lit(0)), digits)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, F.round(2 * p * r / (p + r), 6))


def pair_metrics(predicted: DataFrame, truth: DataFrame, key: list[str], group: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of distinct pairs, in all or by ``group`` (columns of both that the key has).

    Presence on both sides comes from one aggregate over the union.
    """
    group = group or []
    both = predicted.select(*key, F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(truth.select(*key, F.lit(0).alias("p"), F.lit(1).alias("t")))
    met = both.groupBy(*key).agg(F.max("p").alias("p"), F.max("t").alias("t"))
    counts = met.groupBy(*group).agg(F.sum(F.col("p") * F.col("t")).alias("tp"), F.sum(F.col("p") * (1 - F.col("t"))).alias("fp"), F.sum((1 - F.col("p")) * F.col("t")).alias("fn"))
    tp, fp, fn = (F.coalesce(c, F.lit(0)).cast("long") for c in ("tp", "fp", "fn"))
    counts = counts.select(*group, tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    counts = counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return counts.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def sweep(predicted: DataFrame, truth: DataFrame, thresholds: list[int | None]) -> DataFrame:
    """``pair_metrics`` at each score threshold (null: none). Truth counts in documents that keep a prediction at the threshold.

    Each prediction is exploded to the few thresholds that it passes; all thresholds go through one aggregate.
    """
    levels = F.filter(F.array(*[F.lit(-1 if t is None else t) for t in thresholds]), lambda t: F.col("score") >= t)
    p = predicted.select("pmid", "variant", "gene", F.explode(levels).alias("threshold")).distinct()
    t = truth.select("pmid", "variant", "gene").distinct().join(p.select("pmid", "threshold").distinct(), "pmid")
    got = pair_metrics(p, t, ["threshold", "pmid", "variant", "gene"], ["threshold"])
    return got.withColumn("threshold", F.when(F.col("threshold") >= 0, F.col("threshold")))


def coverage(predicted: DataFrame, truth: DataFrame, column: str) -> DataFrame:
    """How many distinct values of the truth are predicted, and the share in percent."""
    p, t = (x.select(column).where(F.col(column).isNotNull()).distinct() for x in (predicted, truth))
    both = t.join(p.withColumn("hit", F.lit(1)), column, "left").agg(F.count("hit").alias("covered"), F.count("*").alias("total"))
    return both.select(F.lit(column).alias("what"), "covered", "total", ratio(100 * F.col("covered"), F.col("total"), 4).alias("percent"))


def accuracy_by_overlap(predicted: DataFrame, truth: DataFrame, key: str, value: str) -> DataFrame:
    """Of the keys that both have, the share with a value in common, in percent."""
    p = predicted.groupBy(key).agg(F.collect_set(value).alias("p"))
    t = truth.groupBy(key).agg(F.collect_set(value).alias("t"))
    met = p.join(t, key).agg(F.count("*").alias("common"), F.count_if(F.arrays_overlap("p", "t")).alias("right"))
    return met.withColumn("percent", ratio(100 * F.col("right"), F.col("common"), 4))


def rolled_up(rows: DataFrame, key: str, sets: dict[str, Column], firsts: dict[str, Column], order: Column) -> DataFrame:
    """One row for each key that isn't null: of each of ``sets`` the distinct values, sorted and joined by "; " (empty if there are none), and of each
    of ``firsts`` the first value by ``order`` that isn't null. Distinct values are taken before rows meet; a key's joined values are one string."""
    each = rows.where(F.col(key).isNotNull())
    joined = [F.array_join(F.array_sort(F.collect_set(c.cast("string"))), "; ").alias(name) for name, c in sets.items()]
    first = [F.min_by(c, F.when(c.isNotNull(), order)).alias(name) for name, c in firsts.items()]
    return each.groupBy(key).agg(*joined, *first)


def coverages(predicted: DataFrame, truth: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``coverage`` of each column under its name, over one aggregate of both sides."""
    kinds = lambda df, side: df.select(F.explode(F.array(*[F.struct(F.lit(name).alias("what"), F.col(c).cast("string").alias("value")) for name, c in columns.items()])).alias("x")).select("x.*", F.lit(side).alias("side"))
    rows = kinds(predicted, 1).unionByName(kinds(truth, 2)).where("value IS NOT NULL")
    met = rows.groupBy("what", "value").agg(F.bool_or(F.col("side") == 1).alias("p"), F.bool_or(F.col("side") == 2).alias("t"))
    counts = met.groupBy("what").agg(F.count_if(F.col("p") & F.col("t")).alias("covered"), F.count_if("t").alias("total"))
    return counts.select("what", "covered", "total", ratio(100 * F.col("covered"), F.col("total"), 4).alias("percent"))


def averaged(metrics: DataFrame) -> DataFrame:
    """Documents, and the means of their precision, recall and F1, where a measure that isn't defined counts as 0."""
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6).alias(f"mean_{c}")
    return metrics.agg(F.count("*").alias("documents"), *[mean(c) for c in ("precision", "recall", "f1")])


def edge_counts(edges: DataFrame) -> DataFrame:
    """``edges``: kind_a, a, kind_b, b. Distinct undirected edges by the kinds of their ends, and their distinct ends."""
    left, right = (F.concat_ws(":", f"kind_{x}", x) for x in "ab")
    kinds = F.array_join(F.array_sort(F.array("kind_a", "kind_b")), "-")
    flat = edges.select(kinds.alias("kinds"), F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).distinct()
    nodes = flat.select("kinds", F.explode(F.array("a", "b")).alias("node")).groupBy("kinds").agg(F.count_distinct("node").alias("nodes"))
    return flat.groupBy("kinds").agg(F.count("*").alias("edges")).join(nodes, "kinds")
