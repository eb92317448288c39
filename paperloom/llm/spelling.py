"""Spelling variant grouping: an even-partition pigeonhole join over the corpus' words.

A word of l code points is indexed by two segments, its first l div 2 code points and the rest. One edit touches one of them only, so the
other one stands in every word that is one edit away: in a word of equal length at the same place, in a word one longer at its own
place if the edit comes after it, else one place further on. So each word probes with its own two segments, and with two
substrings of the lengths for words one shorter; a shorter word is always the indexed one.

Segments such as -tion stand in very many words. What the segment leaves open is therefore parted evenly again, by the same rule, until
at most ``OPEN`` code points are left, so that no key has more than a fixed number of indexed words, however large the vocabulary is, and nothing is
capped. Keys are 64-bit hashes of lengths, places and segments; the join itself verifies each pair by the edit distance of whole words and
puts out true pairs only. A pair that several keys find counts once. Roots follow forms by pointer doubling: every form has twice the count, so there are no circles.

Cases: null text has no words; a null doc_id is written as empty; repeated rows count each; runs may be of any length; no words, no
rows; further columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import ascii_lower, scratch, written

RUN = "[A-Za-zÀ-ÿ]"
#: Code points of an indexed word that its finest key leaves open.
OPEN = 2


def slipped(doc_id: Column, run: Column, every: int = 97) -> Column:
    """The run as the document has it, but for slips: where ``every`` divides the CRC-32 of ``<doc_id>:<run>``, the code point at that
    number modulo the length is left out. This gives any corpus variants at a known rate."""
    h = F.crc32(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), run))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def vocabulary(docs: DataFrame, least: int = 5, count: int = 3, slip: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """word, n: runs of letters, A-Z lower-cased, of at least ``least`` code points and ``count`` occurrences over all documents."""
    runs = F.regexp_extract_all("text", F.lit(f"{RUN}{{{least},}}"), F.lit(0))  # greedy, so a run is whole
    found = docs.select("doc_id", F.explode(runs).alias("run")).select("doc_id", ascii_lower("run").alias("run"))
    word = slip(F.col("doc_id"), F.col("run")) if slip else F.col("run")
    return found.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def _parted(entries: DataFrame) -> DataFrame:
    """Splits what is open: each half in turn becomes part of the key. ``open`` has ``size`` code points, or one more for a word that
    is one longer than those it looks for; the further half of such a word starts one place later."""
    half, last = F.expr("size div 2"), F.expr("size - size div 2")
    to = F.length("open") - last  # where the further segment starts
    key = lambda place, segment: F.xxhash64("key", F.lit(place), "size", segment).alias("key")
    first = F.struct(key(1, F.substr("open", F.lit(1), half)), F.substr("open", half + 1).alias("open"), last.alias("size"))
    second = F.struct(key(2, F.substr("open", to + 1)), F.substr("open", F.lit(1), to).alias("open"), half.alias("size"))
    whole = F.struct("key", "open", "size")
    parts = F.when(F.col("size") > OPEN, F.array(first, second)).otherwise(F.array(whole))
    return entries.select("word", "n", F.explode(parts).alias("e")).select("word", "n", "e.*")


def near(words: DataFrame, longest: int) -> DataFrame:
    """word, near, near_n: all pairs of words that are one inserted, deleted or replaced code point apart, each way round, once.
    ``words`` has word and n, each word once; none has more than ``longest`` code points."""
    def keys(shorter: int) -> DataFrame:
        size = F.length("word") - shorter
        entries = words.select("word", "n", F.xxhash64(size).alias("key"), F.col("word").alias("open"), size.alias("size")).where("size > 0")
        for _ in range(max(1, math.ceil(math.log2(max(longest, 2) / OPEN)))):
            entries = _parted(entries)
        return entries.select("word", "n", "key")

    a, b = keys(0).alias("a"), keys(0).unionByName(keys(1)).alias("b")
    apart = (F.length("a.word") < F.length("b.word")) | (F.col("a.word") < F.col("b.word"))  # pairs of equal length meet twice
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & apart & (F.levenshtein("a.word", "b.word", 1) == 1))
    ways = F.array(*[F.struct(F.col(f"{x}.word").alias("word"), F.col(f"{y}.word").alias("near"), F.col(f"{y}.n").alias("near_n")) for x, y in ("ab", "ba")])
    return pairs.select(F.explode(ways).alias("w")).select("w.*").repartition("word").dropDuplicates(["word", "near"])


def forms(words: DataFrame, pairs: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, n, n_near, form_n: a word's form is the most frequent word near it, the least of equals, if that occurs
    ``ratio`` times as often as the word or more."""
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    often = -F.col("best.less") >= ratio * F.col("n")
    return words.join(best, "word", "left").select(
        "word", F.when(often, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, -F.col("best.less")).alias("form_n")
    )


def roots(found: DataFrame) -> DataFrame:
    """word, root for the words of ``forms`` that have a form: the last form on the way."""
    way = written(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:  # each round doubles the steps taken
        on = way.select(F.col("word").alias("_at"), F.col("root").alias("_to"))
        steps = way.join(on, F.col("root") == F.col("_at"), "left")
        if steps.where("_to IS NOT NULL").isEmpty():
            return way
        way = written(steps.select("word", F.coalesce("_to", "root").alias("root")), "roots")


def grouped(docs: DataFrame, least: int = 5, count: int = 3, ratio: int = 2, slip: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n of the corpus' words; a word without a form is its own root."""
    spark = docs.sparkSession
    with scratch(spark):
        words = written(vocabulary(docs, least, count, slip), "vocabulary")
        longest = words.agg(F.max(F.length("word"))).first()[0] or 0
        found = written(forms(words, near(words, longest), ratio), "forms")
        out = found.join(roots(found), "word", "left").withColumn("root", F.coalesce("root", "word"))
        return written(out.select("word", "form", "root", "n", "n_near", "form_n"), "variants", lasting=True)
