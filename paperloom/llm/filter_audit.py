"""Filter interaction audit: what each filter removes in every order in which filters can run.

Texts are scanned as Arrow buffers: a table gives each byte its class (white space, capital, symbol, continuation byte), prefix sums
of the classes give each document's words, capitals, symbols and code points by two differences, and every word gets a 64-bit
polynomial hash out of one prefix sum. Sorted hashes give the distinct words of a document; words with equal hashes are compared byte by
byte, and a document with a real collision is counted anew from its words. Then the filters a document fails become a bit mask, and
masks reduce to a table of counts by part and label, from which every order follows.

The duplicate filter knows a text by its SHA-256. Copies are counted by (text, part, label) before they meet, so a text that a third
of all rows share is a handful of rows. Shuffled are small rows only, never texts.

Cases: null text is empty; an empty text has no words and fails only what its conditions say; a null part is the empty string; a null
doc_id has no labels, is no duplicate and makes none; rows that repeat a doc_id with its text are each counted, and neither is the
other's duplicate; several label rows of a document count if one says so; texts are taken whole, in slices cut at white space; an empty
table gives no rows; further columns are left out of the audit and stay in ``scanned``, where those named like a count are replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Mapping
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE, CAPITAL, SYMBOL, INNER = 1, 2, 4, 8
#: The class of each byte; bytes inside a code point are ``INNER``.
CLASSES = np.zeros(256, np.uint8)
CLASSES[[0x20, *range(0x09, 0x0E)]] = SPACE
CLASSES[ord("A") : ord("Z") + 1] = CAPITAL
CLASSES[list(b"#$%&*|")] = SYMBOL
CLASSES[0x80:0xC0] = INNER
#: Bytes that are scanned at a time; longer texts are cut at white space.
SLICE = 1 << 20
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
PART = 0xC2B2AE3D27D4EB4F
COUNTS = ("n_words", "n_distinct", "n_capitals", "n_symbols", "n_chars")


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as the longest slice so far needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.where(np.arange(n) == 0, np.uint64(1), np.uint64(b)), dtype=np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes from ``a`` and from ``b`` are the same, for each pair."""
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    differ = data[np.repeat(a, size) + at] != data[np.repeat(b, size) + at]
    return np.bincount(np.repeat(np.arange(len(a)), size)[differ], minlength=len(a)) == 0


def scan(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``data`` holds texts that end at ``ends``. Gives the counts but n_distinct, a row for each text; and of each text's distinct
    words one place: the text, the first byte and the end."""
    n, cuts = len(data), np.concatenate([[0], ends])
    kinds = CLASSES[data]
    space = kinds == SPACE
    edge = np.zeros(n + 1, bool)
    edge[cuts] = True  # no word goes over the end of a text
    first = ~space & (np.concatenate([[True], space[:-1]]) | edge[:-1])
    last = ~space & (np.concatenate([space[1:], [True]]) | edge[1:])
    prefix = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    counts = np.stack([np.diff(prefix(m)[cuts]) for m in (first, kinds == CAPITAL, kinds == SYMBOL, kinds != INNER)], axis=1)

    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    of = np.searchsorted(cuts, a, "right") - 1
    up, down = POWERS.upto(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    mixed = (total[b] - total[a]) * down[a] + of.astype(np.uint64) * np.uint64(PART)
    order = np.argsort(mixed)
    a, b, of, mixed = a[order], b[order], of[order], mixed[order]
    same = np.flatnonzero(mixed[1:] == mixed[:-1])
    size = b - a
    true = (of[same] == of[same + 1]) & (size[same] == size[same + 1])
    true[true] = _equal(data, a[same[true]], a[same[true] + 1], size[same[true]])
    keep = np.ones(len(a), bool)
    keep[same + 1] = False
    if not true.all():  # equal hashes of different words: their texts' words are told apart by their bytes
        for t in set(of[same[~true]]) | set(of[same[~true] + 1]):
            seen: set[bytes] = set()
            for i in np.flatnonzero(of == t):
                word = data[a[i] : b[i]].tobytes()
                keep[i] = word not in seen
                seen.add(word)
    return counts, of[keep], a[keep], b[keep]


def _long(data: np.ndarray) -> list[int]:
    """The counts of one text, slice by slice; only its distinct words are held."""
    sums, words, at = np.zeros(4, np.int64), set(), 0
    while at < len(data):
        to = at + SLICE
        while to < len(data) and not (gap := np.flatnonzero(CLASSES[data[to : to + SLICE]] == SPACE)).size:
            to += SLICE  # a word that goes on
        to = len(data) if to >= len(data) else to + int(gap[0])
        part = data[at:to]
        counts, _, a, b = scan(part, np.array([len(part)]))
        sums += counts[0]
        words.update(part[i:j].tobytes() for i, j in zip(a, b, strict=True))
        at = to
    return [int(sums[0]), len(words), *map(int, sums[1:])]


def measured(texts: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """The counts of each text, in the order of ``COUNTS``, and its SHA-256."""
    texts = pc.fill_null(texts, "")
    _, places, held = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    cuts = np.frombuffer(places, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    out, i = np.zeros((len(texts), len(COUNTS)), np.int64), 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + SLICE, "right")) - 1)
        part = data[cuts[i] : cuts[j]]
        if len(part) > SLICE:
            out[i] = _long(part)
        elif len(part):
            counts, of, _, _ = scan(part, cuts[i + 1 : j + 1] - cuts[i])
            out[i:j, 0], out[i:j, 1], out[i:j, 2:] = counts[:, 0], np.bincount(of, minlength=j - i), counts[:, 1:]
        i = j
    return out, [hashlib.sha256(data[a:b]).digest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts and ``text_key`` in place of the text; no shuffle."""
    new = [*COUNTS, "text_key"]
    rest = [f for f in docs.schema if f.name not in (text, *new)]
    schema = T.StructType([*rest, *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("text_key", T.BinaryType())])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            counts, keys = measured(part.column(len(rest)))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(rest))), *(pa.array(c) for c in counts.T), pa.array(keys, pa.binary())], names=schema.names)

    return docs.select(*[f.name for f in rest], text).mapInArrow(batches, schema)


def masks(docs: DataFrame, labels: DataFrame, fails: Mapping[str, Column], part: str = "lang", duplicates: str | None = None) -> DataFrame:
    """part, mask, good, toxic, n: documents by the filters that they fail. Bit i stands for the i-th of ``fails``, conditions over
    ``scanned`` columns; the last bit for ``duplicates``: the same text under a smaller doc_id, whether that is removed or not."""
    mask = sum((F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(fails.values())), F.lit(0))
    rows = scanned(docs.select("doc_id", "text", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part")))
    counted = rows.groupBy("doc_id", "part", "text_key", mask.alias("mask")).agg(F.count("*").alias("n"))
    known = labels.groupBy("doc_id").agg(*[F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
    marked = counted.join(known, "doc_id", "left").fillna(False, ["good", "toxic"])
    if not duplicates:
        return marked.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
    own = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    groups = marked.groupBy("text_key", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min(own).alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    least = F.min("least.doc_id").over(Window.partitionBy("text_key"))  # a text has few groups: parts by labels
    firsts = groups.withColumn("firsts", F.col("nameless") + F.when(F.col("least.doc_id") == least, F.col("least.n")).otherwise(0))
    both = F.explode(F.array(F.struct(F.col("mask"), F.col("firsts").alias("n")), F.struct(F.col("mask").bitwiseOR(1 << len(fails)).alias("mask"), (F.col("n") - F.col("firsts")).alias("n"))))
    return firsts.select("part", "good", "toxic", both.alias("m")).groupBy("part", "m.mask", "good", "toxic").agg(F.sum("m.n").alias("n"))


def audit(counts: DataFrame, names: str) -> DataFrame:
    """One row for each part, order of the filters and step, out of ``masks``; ``names`` has a letter for each bit.

    kept: in the part after this step; removed: by it; redundant: fail its filter but went before; unique_fails: fail its filter only;
    good_lost, toxic_lost: removed by it; shapley: its filter's removed, summed over all orders.
    """
    orders = F.split(F.lit(",".join(map("".join, permutations(names)))), ",")
    bit = lambda at: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(names), F.substr("filter_order", at, F.lit(1))) - 1)
    earlier = F.filter(F.sequence(F.lit(1), F.lit(len(names))), lambda i: i < F.col("step"))
    rows = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(names)))))
    rows = rows.withColumn("own", bit(F.col("step"))).withColumn("before", F.aggregate(earlier, F.lit(0), lambda m, i: m.bitwiseOR(bit(i))))
    fails, gone, alone = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0, F.col("mask") == F.col("own")
    count = lambda rule, n=F.col("n"): F.sum(F.when(rule, n).otherwise(F.lit(0))).cast("long")
    orders_first = F.col("n") * F.expr(f"{math.factorial(len(names))} div greatest(bit_count(mask), 1)")  # in so many it comes before the others that fail
    return rows.groupBy("part", "filter_order", "step").agg(
        count(~fails & ~gone).alias("kept"), count(fails & ~gone).alias("removed"), count(fails & gone).alias("redundant"), count(alone).alias("unique_fails"),
        count(fails & ~gone & F.col("good")).alias("good_lost"), count(fails & ~gone & F.col("toxic")).alias("toxic_lost"), count(fails, orders_first).alias("shapley"),
    )
