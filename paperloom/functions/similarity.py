"""Text similarity by matching blocks. SQL has no form of it; what no rule and no bound decides goes through an Arrow batch at a time."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

LEAST = 0.7
# Names that have all words of one of these are similar.
RULES = (("cancer", "syndrome"),)


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _lower(c: str | Column) -> Column:
    return F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def _ratio_where(a: Column, b: Column, open_: Column) -> Column:
    """The ratio where it is open; other rows reach Python as nulls and cost nothing there."""
    return _ratio(F.when(open_, a), F.when(open_, b))


def text_ratio(a: str | Column, b: str | Column) -> Column:
    """Similarity from 0 to 1 in lower case; 0 if either is null or empty."""
    a, b = _lower(a), _lower(b)
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(_ratio_where(a, b, (a != "") & (b != "") & (a != b)))


def ratio_bound(a: str | Column, b: str | Column) -> Column:
    """At least the ratio: twice the characters in common, each as often as in the text with fewer of it, by both lengths."""
    a, b = _lower(a), _lower(b)
    times = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    chars = F.array_distinct(F.regexp_extract_all(a, F.lit(r"[\s\S]"), F.lit(0)))
    common = F.aggregate(chars, F.lit(0), lambda n, c: n + F.least(times(a, c), times(b, c)))
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(2.0 * common / (F.length(a) + F.length(b)))


def _similar(x: Column, y: Column, rule: Column, least: float) -> Column:
    empty = (x == "") | (y == "")
    open_ = ~empty & ~rule & (ratio_bound(x, y) >= least - 1e-9)
    return F.when(empty, F.lit(False)).when(rule, F.lit(True)).otherwise(F.coalesce(_ratio_where(x, y, open_) >= least, F.lit(False)))


def text_similar(a: str, b: str, least: float = LEAST) -> Column:
    """Equal, one inside the other, or of ratio ``LEAST`` or more; false if either is null or empty."""
    x, y = F.trim(_lower(a)), F.trim(_lower(b))
    return _similar(x, y, F.contains(x, y) | F.contains(y, x), least)


def text_similar_rules(a: str, b: str, least: float = LEAST) -> Column:
    """As ``text_similar``, and true for the same words in any order, for two common words that make up half of the longer, and for
    texts that have all words of one of ``RULES``."""
    x, y = F.trim(_lower(a)), F.trim(_lower(b))
    wx, wy = (F.split(c, r"\s+") for c in (x, y))
    common = F.size(F.array_intersect(wx, wy))
    same = (common == F.size(F.array_distinct(wx))) & (common == F.size(F.array_distinct(wy)))
    shared = same | ((common >= 2) & (common >= 0.5 * F.greatest(F.size(wx), F.size(wy))))
    for rule in RULES:
        has = F.lit(True)
        for word in rule:
            has = has & F.contains(x, F.lit(word)) & F.contains(y, F.lit(word))
        shared = shared | has
    return _similar(x, y, F.contains(x, y) | F.contains(y, x) | shared, least)
