"""N-gram Jaccard join by signature trees.

A text's set is its distinct five-word shingles, as 64-bit hashes; texts with equal sets are one class. Links are exact:

1. One scan finds every row's class and the shingles that many texts share. A batch tells of what it meets twice, and what several
   batches tell of is shared: so chance repeats are found from about the root of twice the number of batches on, however large the corpus.
2. A second scan posts each class under its rarest shingles: shared ones last, as many as leave no way to reach the
   similarity without them. Two classes that link have postings in common, and so many that with all that was not posted
   they could reach the overlap asked for; pairs from short posting lists are counted and held against that. In long
   lists, runs whose sizes fit connect as a whole. The components of these connections, families, hold all links inside.
3. A third scan brings one text of each class in families, which a fixed-size bitmap of text hashes lets through, to its
   family. There it is shingled, and a signature tree, joined with itself by dual traversal, finds the links.

A family of more than ``BLOCK`` shingles is dealt to blocks. Blocks are joined each for itself; then one text for each
component found; and what still lies outside a family's largest component is joined, in blocks, with all of it. Every pair
that could connect two components is looked at, and no task needs more than two blocks at a time.

Cases: null or blank text has an empty set and is a component of its own; fewer than five words are one shingle; equal
sets are linked; a null doc_id is a row like any other and never the least; repeated rows share their component; texts are
taken whole; an empty table gives no rows; further columns of the input don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import scratch, swept, written
from paperloom.llm.components import components
from paperloom.llm.signature_tree import Tree

N = 5
#: A shingle in so many texts of one batch of ``BATCH`` shingles is told of. It is shared if more than one batch does, or if it is in more texts of one.
LOCAL_SHARED = 2
BATCH = 4_000_000
#: Bits of the map of shared shingles, a power of two; a shingle that only looks shared by it comes last as well, for all texts alike.
SHARED_BITS = 1 << 27
#: Members of a posting list up to which its pairs are counted.
SHORT = 64
#: Bits of the map that lets the texts of families through.
MAP_BITS = 1 << 26
#: Shingles in a block that is joined for itself.
BLOCK = 16_384
#: A family's rest is joined with all of it in blocks of this share of the family, or ``BLOCK`` if that is more, or
#: ``MAX_BLOCK`` if that is less.
CROSS_SHARE = 1 / 32
MAX_BLOCK = 1_500_000
#: Words whose hashes a task remembers.
MEMORY = 500_000
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


@dataclass(frozen=True)
class Similarity:
    """Two sets link if intersection / union >= numerator / denominator."""

    numerator: int = 3
    denominator: int = 4

    def prefix(self, n: int) -> int:
        """So many members of a set of ``n`` can't all be missing from a set that links with it."""
        return n - -(-n * self.numerator // self.denominator) + 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


class Shingler:
    def __init__(self):
        self.memory: dict[bytes, int] = {}

    def _hash(self, words: list[bytes]) -> np.ndarray:
        if len(self.memory) > MEMORY:
            self.memory.clear()
        memory = self.memory
        for w in set(words).difference(memory):
            memory[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(memory.__getitem__, words), dtype=np.uint64, count=len(words))

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """The sorted set of each text."""
        split = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
        flat = self._hash([w for words in split for w in words])
        out, at = [], 0
        h = np.zeros(max(0, len(flat) - N + 1), dtype=np.uint64)
        for k in range(N):
            h += flat[k : k + len(h)] * _MUL[k]
        h = _mixed(h)
        for words in split:
            n = len(words)
            if n >= N:
                out.append(np.unique(h[at : at + n - N + 1]))
            elif n:
                out.append(_mixed((flat[at : at + n] * _MUL[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)))
            else:
                out.append(flat[:0])
            at += n
        return out


def class_of(members: np.ndarray) -> int:
    """64 bits that name the set; 0 for the empty one."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(members.tobytes())).astype(np.int64)) if len(members) else 0


def _scan(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    shingler = Shingler()
    for part in parts:
        for at in range(0, part.num_rows, 256):
            piece = part.slice(at, 256)
            yield piece, shingler.sets(piece.column(1).to_pylist())


def profile(docs: DataFrame) -> DataFrame:
    """Rows of kind 0: a doc_id, b class, n size of the set, mark and hash as in ``docs``. Rows of kind 1: a shingle, n texts of one batch that have it."""
    names_of = ["kind", "a", "b", "n", "mark", "hash"]

    def run(parts):
        seen: set[int] = set()
        held: list[np.ndarray] = []

        def shared():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            ok = counts >= LOCAL_SHARED
            k = int(ok.sum())
            held.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([1] * k, pa.int8()), pa.array(values[ok].astype(np.int64), pa.int64()), pa.nulls(k, pa.int64()), pa.array(counts[ok], pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())],
                names=names_of,
            )

        size = 0
        for piece, sets in _scan(parts):
            names = [class_of(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * len(sets), pa.int8()), piece.column(0), pa.array(names, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), piece.column(2), piece.column(3)],
                names=names_of,
            )
            for c, s in zip(names, sets, strict=True):
                if len(s) and c not in seen:
                    seen.add(c)
                    held.append(s)
                    size += len(s)
            if size > BATCH:
                yield shared()
                size = 0
        if held:
            yield shared()

    return docs.mapInArrow(run, "kind byte, a long, b long, n long, mark long, hash long")


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """Words of 64 bits with those of the longs in the only column set; ``bits`` / 64 rows at most come to the driver."""
    words = hashes.select(F.col(hashes.columns[0]).bitwiseAND(F.lit(bits - 1)).alias("bit"))
    words = words.select(F.shiftright("bit", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(bit & 63 AS int))").alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    marks = np.zeros(bits // 64, dtype=np.int64)
    got = words.toPandas()
    marks[got["word"].to_numpy(dtype=np.int64)] = got["mask"].to_numpy(dtype=np.int64)
    return marks


def marked(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bits of the longs are set."""
    bit = hashes & (len(marks) * 64 - 1)
    return (marks[bit >> 6] >> (bit & 63) & 1).astype(bool)


def shared_shingles(seen: DataFrame) -> DataFrame:
    """h of the shingles that ``profile`` holds shared."""
    told = seen.where("kind = 1").groupBy(F.col("a").alias("h")).agg(F.count("*").alias("batches"), F.max("n").alias("n"))
    return told.where(f"batches > 1 OR n > {LOCAL_SHARED}").select("h")


def postings(docs: DataFrame, shared: np.ndarray, similar: Similarity) -> DataFrame:
    """h, n, c: each class under its rarest shingles. ``shared``: a map of those that come last."""
    held = docs.sparkSession.sparkContext.broadcast(shared)

    def run(parts):
        last, seen = held.value, set()
        for _, sets in _scan(parts):
            h, n, c = [], [], []
            for s in sets:
                name = class_of(s)
                if not len(s) or name in seen:
                    continue
                seen.add(name)
                k = similar.prefix(len(s))
                common = marked(last, s.view(np.int64))
                s = np.concatenate([s[~common], s[common]])
                h.append(s[:k])
                n.append(np.full(k, len(s), dtype=np.int32))
                c.append(np.full(k, name, dtype=np.int64))
            if h:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).astype(np.int64)), pa.array(np.concatenate(n)), pa.array(np.concatenate(c))], names=["h", "n", "c"])

    return docs.mapInArrow(run, "h long, n int, c long")


class _Lists:
    """Connections from posting lists that come sorted by h, n, c, in pieces."""

    def __init__(self, similar: Similarity):
        self.s = similar
        self.kept = tuple(np.empty(0, dtype=np.int64) for _ in range(3))
        self.long: tuple | None = None  # h, n of the last member and first member of its run, of a long list that may go on

    def _fits(self, less: np.ndarray, more: np.ndarray) -> np.ndarray:
        return self.s.denominator * less >= self.s.numerator * more

    def read(self, h: np.ndarray, n: np.ndarray, c: np.ndarray, last: bool = False):
        """Pairs (u, v, common postings) of the lists that have ended; a long list connects with more than any pair needs."""
        h, n, c = (np.concatenate([a, b]) for a, b in zip(self.kept, (h, n, c), strict=True))
        fresh = np.ones(len(h), dtype=bool)
        fresh[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        h, n, c = h[fresh], n[fresh], c[fresh]
        if not len(h):
            return
        begins = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        sizes = np.diff(np.append(begins, len(h)))
        long = sizes > SHORT
        if self.long and h[0] == self.long[0]:
            long[0] = True
        end = len(h)
        if not last and not long[-1]:  # the last list may go on
            end = begins[-1]
        self.kept = h[end:], n[end:], c[end:]
        of_long = np.repeat(long, sizes)[:end]
        yield from self._long(h[:end][of_long], n[:end][of_long], c[:end][of_long])
        h, n, c = (x[:end][~of_long] for x in (h, n, c))
        for gap in range(1, SHORT):
            same = h[:-gap] == h[gap:] if gap < len(h) else np.empty(0, dtype=bool)
            if not same.any():
                break
            ok = np.flatnonzero(same)
            ok = ok[self._fits(n[ok], n[ok + gap])]
            yield c[ok], c[ok + gap], n[ok], n[ok + gap], np.ones(len(ok), dtype=np.int64)

    def _long(self, h, n, c):
        if not len(h):
            return
        goes_on = self.long is not None and h[0] == self.long[0]
        before = np.concatenate([[self.long[1] if goes_on else 0], n[:-1]])
        begins = ~self._fits(before, n)
        begins[1:] |= h[1:] != h[:-1]
        begins[0] |= not goes_on
        at = np.maximum.accumulate(np.where(begins, np.arange(len(h)), -1))
        center = np.where(at >= 0, c[at], self.long[2] if self.long else 0)
        self.long = h[-1], n[-1], center[-1]
        yield center, c, n, n, np.full(len(c), 1 << 40)


def connections(posted: DataFrame, similar: Similarity) -> DataFrame:
    """u, v: pairs of classes with enough postings in common to link, and connections that hold long lists together.

    What two sets didn't both post lies behind the last posting of one of them, so it adds no more to their overlap than
    that one has left. The common postings must make up the rest of the overlap that the similarity asks for.
    """

    def run(parts):
        lists = _Lists(similar)

        def sent(found):
            found = [np.concatenate(x) for x in zip(*found, strict=True)]
            u, v, a, b, k = found
            swap = u < v
            rows = pd.DataFrame({"u": np.where(swap, v, u), "v": np.where(swap, u, v), "a": np.where(swap, b, a), "b": np.where(swap, a, b), "k": k})
            rows = rows[rows["u"] != rows["v"]].groupby(["u", "v"], sort=False, as_index=False).agg({"a": "first", "b": "first", "k": "sum"})
            return pa.RecordBatch.from_pandas(rows.astype("int64"), preserve_index=False)

        found, size = [], 0
        none = np.empty(0, dtype=np.int64)
        for h, n, c in chain(((p.column(0).to_numpy(), p.column(1).to_numpy().astype(np.int64), p.column(2).to_numpy()) for p in parts), [(none, none, none)]):
            for x in lists.read(h, n, c, last=not len(h)):
                found.append(x)
                size += len(x[0])
            if size > 500_000:
                yield sent(found)
                found, size = [], 0
        if found:
            yield sent(found)

    dealt = posted.repartition(_parts(posted), "h").sortWithinPartitions("h", "n", "c")
    pairs = dealt.mapInArrow(run, "u long, v long, a long, b long, k long").groupBy("u", "v").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.sum("k").alias("k"))
    p, q = similar.numerator, similar.denominator
    asked = f"floor(({p} * (a + b) + {p + q - 1}) / {p + q}) - floor((greatest(a, b) * {p} + {q - 1}) / {q}) + 1"
    return pairs.where(f"k >= greatest(1, {asked})").select("u", "v")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def texts_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """hash and text of the rows with the hashes given and few others; one row for each task that has the text. ``classes``: hash of
    one text of each. A text is shorter than its set and, unlike hashes, is compressed on its way."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap(classes.select("hash"), MAP_BITS))

    def run(parts):
        seen: set[int] = set()
        for part in parts:
            hashes = part.column(0).to_numpy()
            rows = np.flatnonzero(marked(held.value, hashes))
            rows = [i for i, h in zip(rows.tolist(), hashes[rows].tolist(), strict=True) if not (h in seen or seen.add(h))]
            if rows:
                yield part.take(pa.array(rows, pa.int64()))

    return docs.where("text IS NOT NULL").select("hash", "text").mapInArrow(run, "hash long, text string")


def _joined(cells: DataFrame, texts: DataFrame, similar: Similarity) -> DataFrame:
    """u, v: a link from each class to the root that its cell's tree finds. ``cells``: cell columns x, y, z; c; hash of one of its
    texts; known (its component so far). Sets are made where a cell is joined, and never travel."""
    shingler = Shingler()  # one for each task

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["c", "text"]).sort_values("c")
        c = pdf["c"].to_numpy(dtype=np.int64)
        members = shingler.sets(pdf["text"].tolist())
        own = np.flatnonzero([class_of(m) == k for m, k in zip(members, c.tolist(), strict=True)])  # not another text of equal hash
        own = own[np.unique(c[own], return_index=True)[1]]
        c, known = c[own], pdf["known"].to_numpy(dtype=np.int64)[own]
        root = Tree([members[i] for i in own.tolist()], similar.numerator, similar.denominator).linked(known)
        ok = root != np.arange(len(root))
        return pd.DataFrame({"u": c[ok], "v": c[root[ok]]})

    return cells.join(texts, "hash").groupBy("x", "y", "z").applyInPandas(run, "u long, v long")


def links(families: DataFrame, docs: DataFrame, similar: Similarity) -> DataFrame:
    """node, root of the classes that links connect. ``families``: c, n, family, hash (of one text). ``docs``: hash, text."""
    spark = families.sparkSession
    weight = families.groupBy("family").agg(F.sum("n").alias("w"))
    blocks = F.ceil(F.col("w") / BLOCK).cast("int")
    dealt = written(families.join(weight, "family").withColumn("b", blocks).withColumn("i", F.pmod(F.xxhash64("c"), F.col("b")).cast("int")).drop("w"), "dealt")
    none = F.lit(-1)
    one = dealt.select(F.col("family").alias("x"), F.col("i").alias("y"), none.alias("z"), "c", "hash", F.col("c").alias("known"))
    found = written(_joined(one, texts_of(docs, families), similar), "links")
    large = written(dealt.where("b > 1"), "large-families")
    if large.isEmpty():
        return components(found)
    texts = texts_of(docs, large)
    for step in ("representatives", "rest"):
        swept(spark)
        roots = components(found)
        now = large.join(roots.select(F.col("node").alias("c"), "root"), "c", "left").withColumn("known", F.coalesce("root", "c")).drop("root")
        now = written(now, "now")
        sizes = now.groupBy("family", "known").agg(F.sum("n").alias("w"))
        largest = written(sizes.groupBy("family").agg(F.max_by("known", F.struct("w", "known")).alias("top"), F.count("*").alias("k")).where("k > 1"), "largest")
        if largest.isEmpty():
            return roots
        now = now.join(largest, "family")
        if step == "representatives":
            cells = now.where("c = known")
            # As many cells as hold a block each; what they leave apart the next step sees.
            part = cells.groupBy("family").agg(F.sum("n").alias("w")).withColumn("p", F.ceil(F.col("w") / BLOCK).cast("int"))
            cells = cells.join(part, "family").select(F.col("family").alias("x"), F.pmod(F.xxhash64("c", F.lit(1)), F.col("p")).cast("int").alias("y"), none.alias("z"), "c", "hash", "known")
        else:
            cells = crossed(now)
        found = found.unionByName(written(_joined(cells, texts, similar), step))
    return components(found)


def crossed(now: DataFrame) -> DataFrame:
    """Cells x, y, z that bring every class outside its family's largest component (``known`` is not ``top``) together with all
    classes of the family."""
    rest = written(now.where("known <> top"), "rest")
    part = rest.groupBy("family").agg(F.sum("n").alias("w")).join(now.groupBy("family").agg(F.sum("n").alias("all")), "family")
    part = part.withColumn("block", F.least(F.lit(float(MAX_BLOCK)), F.greatest(F.lit(float(BLOCK)), F.col("all") * CROSS_SHARE)))
    part = written(part.select("family", F.ceil(F.col("w") / F.col("block")).cast("int").alias("r"), F.ceil(F.col("all") / F.col("block")).cast("int").alias("s")), "cross-blocks")
    deal = lambda to, seed: F.pmod(F.xxhash64("c", F.lit(seed)), F.col(to)).cast("int")
    ours = rest.join(part, "family").select("family", "s", "c", "hash", "known", deal("r", 2).alias("y")).withColumn("z", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    theirs = now.join(part, "family").select("family", "c", "hash", "known", deal("s", 3).alias("z"), F.explode(F.sequence(F.lit(0), F.col("r") - 1)).alias("y"))
    return ours.select(F.col("family").alias("x"), "y", "z", "c", "hash", "known").unionByName(theirs.select(F.col("family").alias("x"), "y", "z", "c", "hash", "known"))


def join(docs: DataFrame, similar: Similarity = Similarity(), key: str = "doc_id", text: str = "text", mark: Column | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, class (of equal sets), component_id (the least doc_id that links reach),
    root (a class of the component, which names it where doc_ids are null or repeated; null for empty sets) and mark (a long that
    goes along with the row, null without one)."""
    spark = docs.sparkSession
    mark = F.lit(None) if mark is None else mark
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), mark.cast("long").alias("mark"), F.xxhash64(text).alias("hash"))
    with scratch(spark):
        seen = written(profile(docs), "profile", lasting=True)
        rows = seen.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("c"), "n", "mark", "hash")
        edges = written(connections(postings(docs, bitmap(shared_shingles(seen), SHARED_BITS), similar), similar), "connections")
        swept(spark)
        first = written(rows.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"), F.min("hash").alias("hash")), "classes")
        families = components(edges)
        families = families.select(F.col("node").alias("c"), F.col("root").alias("family")).unionByName(families.select(F.col("root").alias("c"), F.col("root").alias("family")).distinct())
        families = written(families.join(first.select("c", "n", "hash"), "c"), "families")
        swept(spark)
        roots = links(families, docs, similar)
        linked = first.join(roots, first["c"] == roots["node"], "left").select("c", "first", F.coalesce("root", "c").alias("root"))
        linked = written(linked, "linked")
        least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
        found = written(linked.join(least, "root").select("c", "component_id", "root"), "found", lasting=True)
    swept(spark)
    got = rows.join(found, "c", "left")
    return got.select("doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("class"), F.coalesce("component_id", "doc_id").alias("component_id"), "root", "mark")
