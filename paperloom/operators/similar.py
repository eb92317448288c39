"""Pairs of similar names of two tables, without comparing all with all.

The ratio of matching blocks is at most twice the characters that two names share, each as often as in the rarer one, by their
lengths together. So names with a ratio of ``least`` or more share a known part of their characters, and with characters numbered by
occurrence (the second e is another one than the first) and put in order from the rarest, they share one among the first few of both. That is an equi-join;
lengths and the bound itself, both plain expressions, drop most of what it finds, and matching blocks are looked for in the rest only.

The other rules that make names similar are joins as well: a name inside another has its rarest three characters in it; names with two
words in common that make up half of the longer one share one of their rarest words; the same words in any order share all.

Names are compared in lower case. Null and empty names are similar to nothing; each pair of different spellings comes once, however often its
names are repeated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.similarity import LEAST, RULES, text_ratio

_GRAM = 3


def _names(df: DataFrame, column: str, trimmed: bool = False) -> DataFrame:
    """name, low of the distinct names; low is what is compared."""
    low = F.lower(F.trim("name") if trimmed else F.col("name"))
    return df.select(F.col(column).alias("name")).distinct().withColumn("low", low).where("low <> ''")


def _numbered(items: Column) -> Column:
    """Each item with the number of its occurrence."""
    return F.transform(items, lambda x, i: F.concat(x, F.lit(":"), F.size(F.filter(F.slice(items, F.lit(1), i + 1), lambda y: y == x)).cast("string")))


def _ordered(sides: list[DataFrame], items: str) -> list[DataFrame]:
    """Puts the array ``items`` of each side in one order, from what the fewest names have."""
    each = [s.select("name", "low", *[c for c in s.columns if c not in ("name", "low", items)], F.explode(items).alias("_item")) for s in sides]
    rarity = reduce(DataFrame.unionAll, [e.select("_item") for e in each]).groupBy("_item").agg(F.count("*").alias("_n"))
    keys = lambda s: [c for c in s.columns if c != "_item"]
    return [e.join(rarity, "_item").groupBy(*keys(e)).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_item"))), lambda x: x["_item"]).alias(items)) for e in each]


def _met(a: DataFrame, b: DataFrame, items: str, first: str) -> DataFrame:
    """Pairs that have one of their ``first`` items in common, each once, at the rarest: a.*, b.* by the names x and y."""
    x, y = (s.withColumn("_first", F.expr(f"slice({items}, 1, {first})")).withColumn("_key", F.explode("_first")).alias(n) for s, n in ((a, "x"), (b, "y")))
    return x.join(y, (F.col("x._key") == F.col("y._key")) & (F.get(F.array_intersect("x._first", "y._first"), F.lit(0)) == F.col("x._key")))


def candidates(left: DataFrame, right: DataFrame, least: float = LEAST) -> DataFrame:
    """a, b: pairs whose ratio may be ``least`` or more, by length and shared characters. ``left`` has a, ``right`` b."""
    return _candidates([_names(left, "a"), _names(right, "b")], least).select("a", "b")


def _candidates(sides: list[DataFrame], least: float) -> DataFrame:
    sides = [s.withColumn("items", _numbered(F.regexp_extract_all("low", F.lit(r"[\s\S]"), F.lit(0)))).withColumn("size", F.size("items")) for s in sides]
    a, b = _ordered(sides, "items")
    share = least / (2 - least)  # of its own characters that a name must find in the other one
    met = _met(a, b, "items", f"size - CAST(ceil(size * {share} - 1e-9) AS int) + 1")
    both = F.col("x.size") + F.col("y.size")
    fits = (2 * F.least("x.size", "y.size") >= least * both - 1e-9) & (2 * F.size(F.array_intersect("x.items", "y.items")) >= least * both - 1e-9)
    return met.where(fits).select(F.col("x.name").alias("a"), F.col("y.name").alias("b"), F.col("x.low").alias("_a"), F.col("y.low").alias("_b"))


def similar(left: DataFrame, right: DataFrame, least: float = LEAST) -> DataFrame:
    """a, b, ratio: all pairs with a ratio of ``least`` or more."""
    return _similar([_names(left, "a"), _names(right, "b")], least)


def _similar(sides: list[DataFrame], least: float) -> DataFrame:
    return _candidates(sides, least).withColumn("ratio", text_ratio("_a", "_b")).where(F.col("ratio") >= least).select("a", "b", "ratio")


def _inside(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of which ``a`` stands in ``b``: b has all its runs of up to three characters as keys, a its rarest one of three, or itself if it is shorter."""
    grams = lambda n: F.expr(f"transform(sequence(1, greatest(length(low) - {n} + 1, 1)), i -> substr(low, i, {n}))")
    own = a.withColumn("grams", F.array_distinct(F.when(F.length("low") >= _GRAM, grams(_GRAM)).otherwise(F.array("low"))))
    every = b.withColumn("_gram", F.explode(F.array_distinct(F.flatten(F.array(*[grams(n) for n in range(1, _GRAM + 1)])))))
    n = every.groupBy("_gram").agg(F.count("*").alias("_n"))
    least = own.select("name", "low", F.explode("grams").alias("_gram")).join(n, "_gram")  # a gram that no name has leaves nothing to find
    complete = own.select("name", F.size("grams").alias("_all"))
    least = least.groupBy("name", "low").agg(F.count("*").alias("_found"), F.min(F.struct("_n", "_gram")).alias("_g")).join(complete, "name").where("_found = _all")
    met = least.select(F.col("name").alias("a"), F.col("low").alias("_a"), F.col("_g._gram").alias("_gram")).join(every.select(F.col("name").alias("b"), F.col("low").alias("_b"), "_gram"), "_gram")
    return met.where(F.contains("_b", "_a")).select("a", "b")


def similar_by_rules(left: DataFrame, right: DataFrame, least: float = LEAST) -> DataFrame:
    """a, b: all pairs that ``text_similar_rules`` holds similar."""
    x, y = _names(left, "a", True), _names(right, "b", True)
    words = F.filter(F.split("low", r"\s+"), lambda w: w != "")
    sides = [s.withColumn("n_words", F.size(words)).withColumn("items", F.array_distinct(words)).where("size(items) > 0") for s in (x, y)]
    a, b = _ordered(sides, "items")
    met = _met(a, b, "items", "greatest(size(items) - greatest(2, CAST(ceil(n_words / 2) AS int)) + 1, 1)")
    common = F.size(F.array_intersect("x.items", "y.items"))
    same = (common == F.size("x.items")) & (common == F.size("y.items"))
    shared = met.where(same | ((common >= 2) & (common >= 0.5 * F.greatest("x.n_words", "y.n_words")))).select(F.col("x.name").alias("a"), F.col("y.name").alias("b"))
    swapped = _inside(y, x).select(F.col("b").alias("a"), F.col("a").alias("b"))
    rules = []
    for needed in RULES:
        has = [s.where(reduce(lambda p, q: p & q, [F.contains("low", F.lit(w)) for w in needed])) for s in (x, y)]
        rules.append(has[0].select(F.col("name").alias("a"), F.lit(1).alias("_k")).join(has[1].select(F.col("name").alias("b"), F.lit(1).alias("_k")), "_k").select("a", "b"))  # all of these are similar
    parts = [_similar([x, y], least).select("a", "b"), shared, _inside(x, y), swapped, *rules]
    return reduce(DataFrame.unionByName, parts).distinct()
