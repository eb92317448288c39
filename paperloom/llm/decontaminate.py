"""Benchmark decontamination over a distributed positional inverted index.

Test items become windows of ten words (an item of fewer words is one window). The corpus frequency of every test term
is counted over all documents; each window is anchored at its three rarest terms. One scan of the corpus stores the
postings of anchor terms, with positions, and one posting of the empty term for each document, whose position is the number
of its words. Postings of terms that are the rarest of a window also store the words around.

The windows' anchor lists, shifted by the anchors' offsets, meet in each document: where all of a window's anchors fall on
one start, and the words between the anchors are the window's, it occurs exactly. Where its anchors fall on starts that are at
most ``SLOP`` words apart, in any order, it is a proximity match. Anchors are found by the intersection alone; the words around
are compared at the other places of the window only.

Cases: null text has no words; a null doc_id is a key like any other; an item of no words has no window; equal windows of
several items count for each; repeated documents are matched once each and all returned; a document may match any number
of windows; empty tables give zero hits; further columns stay, those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import ascii_lower, scratch, written

SIZE = 10
#: Terms that anchor a window.
ANCHORS = 3
#: Words between the starts that a proximity match's anchors point to, at most.
SLOP = 5
#: The windows, and with them the terms and anchors, are broadcast up to this number and joined by shuffling beyond it.
MAX_BROADCAST_WINDOWS = 500_000
#: Everything but digits, a-z and what isn't ASCII parts words, in lower-cased text.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ("doc_id", "_t")


def tokens(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """Distinct windows: ``window`` (words joined by a space), ``len`` and the ``items`` that have it, as sorted strings."""
    w = items.select(F.col("item_id").cast("string").alias("item"), tokens("text").alias("w")).where("size(w) > 0")
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))).alias("i")
    w = w.select("item", "w", at).select("item", F.slice("w", F.col("i"), F.lit(size)).alias("w"))
    return w.groupBy(F.array_join("w", " ").alias("window"), F.size("w").alias("len")).agg(F.array_sort(F.collect_set("item")).alias("items"))


def _others(words: Column, offsets: Column) -> Column:
    """The words that aren't at the offsets, joined by a space."""
    return F.array_join(F.filter(words, lambda w, i: ~F.array_contains(offsets, i)), " ")


class Index:
    """The windows of the items, their anchors and the postings of anchor terms in ``docs``."""

    def __init__(self, docs: DataFrame, items: DataFrame, size: int = SIZE):
        self.size = size
        #: wid, window, len, items.
        self.windows = written(windows(items, size).withColumn("wid", F.monotonically_increasing_id()), "windows")
        self.small = self.windows.count() <= MAX_BROADCAST_WINDOWS
        docs = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t"), tokens("text").alias("w"))
        terms = self.windows.select("wid", "window", F.posexplode(F.split("window", " ")).alias("off", "term"))
        terms = terms.groupBy("wid", "window", "term").agg(F.min("off").alias("off"))
        vocabulary = terms.select("term").distinct()
        counts = docs.select(F.explode("w").alias("term")).join(self._hint(vocabulary), "term").groupBy("term").agg(F.count("*").alias("n"))
        counts = written(counts, "test-terms")
        ranked = terms.join(self._hint(counts), "term", "left").selectExpr(
            "wid", "window", "term", "off", "row_number() OVER (PARTITION BY wid ORDER BY coalesce(n, 0), off) AS rank"
        )
        every = "count(*) OVER (PARTITION BY wid) AS n_anchors", "collect_list(off) OVER (PARTITION BY wid) AS offsets"
        chosen = ranked.where(F.col("rank") <= ANCHORS).selectExpr("*", *every)
        first = F.col("rank") == 1
        #: wid, term, off, rank from 1 (the rarest), full (a bit for each anchor); at rank 1 len, offsets of all anchors and the other words.
        self.anchors = written(
            chosen.select(
                "wid", "term", "off", "rank", F.expr("shiftleft(1, n_anchors) - 1").alias("full"), F.size(F.split("window", " ")).alias("len"),
                F.when(first, F.col("offsets")).alias("offsets"), F.when(first, _others(F.split("window", " "), F.col("offsets"))).alias("rest"),
            ),
            "anchors",
        )
        kept = self.anchors.groupBy("term").agg(F.bool_or(first).alias("lead"))
        kept = kept.unionByName(docs.sparkSession.sql("SELECT '' AS term, false AS lead"))
        # The empty term stands for the document itself, behind its last word.
        every = docs.select("doc_id", "_t", "w", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "term"))
        around = F.when(F.col("lead"), F.slice("w", F.greatest(F.lit(1), F.col("pos") - (size - 2)), F.least(F.col("pos"), F.lit(size - 1)) + size))
        self.postings = written(every.join(self._hint(kept), "term").select("doc_id", "_t", "term", "pos", around.alias("around")), "postings")

    def _hint(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df

    def documents(self) -> DataFrame:
        """doc_id, _t and n_words of every document row."""
        return self.postings.where("term = ''").select("doc_id", "_t", F.col("pos").cast("long").alias("n_words"))

    def lists(self) -> DataFrame:
        """Offset-adjusted postings: doc_id, _t, wid, start, bit (the anchor's), full, and at the rarest anchor whether the window's other words are there."""
        found = self.postings.where("term <> ''").join(self._hint(self.anchors), "term")
        # ``around`` begins size - 1 words before the anchor, or at the document's first word.
        first = F.least(F.col("pos"), F.lit(self.size - 1)) - F.col("off") + 1
        words = F.slice("around", F.greatest(F.lit(1), first), F.col("len"))
        rest = (first >= 1) & (F.size(words) == F.col("len")) & (_others(words, F.col("offsets")) == F.col("rest"))
        return found.select(
            *KEY, "wid", (F.col("pos") - F.col("off")).alias("start"), F.expr("shiftleft(1, rank - 1)").alias("bit"), "full", F.when(F.col("rank") == 1, rest).otherwise(F.lit(False)).alias("rest")
        )

    def met(self, slop: int = SLOP) -> DataFrame:
        """doc_id, _t, wid, start, exact: where all of a window's anchors meet within ``slop`` words before start; exact if
        they meet at start and the other words are the window's."""
        part = "PARTITION BY doc_id, _t, wid ORDER BY start RANGE BETWEEN"
        met = self.lists().selectExpr(
            *KEY, "wid", "start", "rest", "full", f"bit_or(bit) OVER ({part} CURRENT ROW AND CURRENT ROW) AS here", f"bit_or(bit) OVER ({part} {int(slop)} PRECEDING AND CURRENT ROW) AS near"
        )
        return met.where("near = full").select(*KEY, "wid", "start", F.expr("rest AND here = full").alias("exact"))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = SIZE, slop: int = SLOP) -> DataFrame:
    """One row for each document row: doc_id, _t, n_words, n_hit, n_items, items (sorted), contaminated, n_near (windows with proximity matches, the exact ones included)."""
    with scratch(docs.sparkSession):
        index = Index(docs, items, size)
        met = written(index.met(slop), "met")
        spans = met.where("exact").join(index._hint(index.windows), "wid").selectExpr(
            *KEY, "items", "start + len AS end", "start",
            "max(start + len) OVER (PARTITION BY doc_id, _t ORDER BY start, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _until",
        )
        hits = spans.groupBy(*KEY).agg(
            F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("_until", F.lit(0))))).cast("long").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
        near = met.groupBy(*KEY).agg(F.count_distinct("wid").alias("n_near"))
        some = written(near.alias("n").join(hits.alias("h"), _same("n", "h"), "left").select("n.doc_id", "n._t", "n_near", "n_hit", "items"), "matches")
        d, h = index.documents().alias("d"), some.alias("h")
        items_or_none = F.coalesce("h.items", F.array().cast("array<string>"))
        n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
        got = d.join(h, _same("d", "h"), "left").select(
            "d.doc_id", "d._t", "n_words", n_hit.alias("n_hit"), F.size(items_or_none).cast("long").alias("n_items"), items_or_none.alias("items"),
            (n_hit > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        )
        return written(got, "decontaminated", lasting=True)


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}._t") == F.col(f"{b}._t"))


def proximity(docs: DataFrame, items: DataFrame, slop: int = SLOP, size: int = SIZE) -> DataFrame:
    """doc_id, window, start: the last starts of places where a window's anchors point to starts at most ``slop`` words apart."""
    with scratch(docs.sparkSession):
        index = Index(docs, items, size)
        found = index.met(slop).join(index._hint(index.windows), "wid").select("doc_id", "window", "start").distinct()
        return written(found, "proximity", lasting=True)


def cleaned(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of ``docs`` that no window of an item occurs in, with all their columns."""
    with scratch(docs.sparkSession):
        bad = decontaminate(docs, items, size).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("_t").alias("_h")).distinct()
        bad = written(bad, "contaminated", lasting=True)
    text_hash = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("_id")) & (text_hash == F.col("_h")), "left_anti")
