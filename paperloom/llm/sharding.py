"""Sharding by a hierarchical weighted hash tree.

Regions hold racks and racks hold shards. A row descends from the root: at each level every child draws
``-ln(u) / weight`` with ``u`` hashed from the key and the child's path, and the least draw wins, which is a choice in
proportion to the weights. A child's draw depends on nothing but the key, its path and its own weight, so raising one
child's weight moves rows only into that child, and a subtree whose weights stay as they are keeps its rows.

``Topology.grown()`` adds shards as a region of their own. Rows then move into the new region and nowhere else.

Cases: a null key hashes like the key ``null`` (all such rows share a shard); a null text has no bytes; repeated rows
get the same shard and different slots; an empty table gives no rows; further columns stay, and a further column named
like one of the results is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import written

#: 2**53, so that every drawn fraction is a double without rounding.
DRAW_BITS = 53
#: Rows that one slot bucket should hold; slots are counted inside buckets.
BUCKET_ROWS = 50_000
#: Most buckets per shard, which bounds the broadcast table of offsets.
MAX_BUCKETS = 4096


@dataclass(frozen=True)
class Topology:
    """``regions[i][j]`` lists the weights of the shards of rack j in region i; shards are numbered in that order."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    @classmethod
    def uniform(cls, regions: int, racks: int, shards: int) -> Topology:
        return cls(tuple(tuple((1.0,) * shards for _ in range(racks)) for _ in range(regions)))

    @property
    def n_shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)

    def grown(self, weights: tuple[float, ...] = (1.0,)) -> Topology:
        return Topology((*self.regions, (tuple(weights),)))


def _winner(key: Column, children: list[tuple[str, float]], seed: int) -> Column:
    """The index of the child (path, weight) with the least weighted draw; ties go to the earlier child."""

    def draw(path: str, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(path), F.lit(seed)), 64 - DRAW_BITS)
        return -F.log((bits.cast("double") + 0.5) / F.lit(float(1 << DRAW_BITS))) / F.lit(float(weight))

    if len(children) == 1:
        return F.lit(0)
    return F.least(*[F.struct(draw(path, w).alias("d"), F.lit(i).alias("i")) for i, (path, w) in enumerate(children)]).getField("i")


def _by_node(node: Column, choices: list[Column]) -> Column:
    out = F.when(node == 0, choices[0])
    for i, c in enumerate(choices[1:], 1):
        out = out.when(node == i, c)
    return out


def with_shard(df: DataFrame, key: str, topology: Topology, seed: int, out: str) -> DataFrame:
    """Adds the shard number of each key. Each level is a column of its own, so that no draw is made twice."""
    k = F.col(key)
    racks = [(i, j, rack) for i, region in enumerate(topology.regions) for j, rack in enumerate(region)]
    first_rack = [next(n for n, r in enumerate(racks) if r[0] == i) for i in range(len(topology.regions))]
    first_shard = [sum(len(r[2]) for r in racks[:n]) for n in range(len(racks))]
    df = df.withColumn("_region", _winner(k, [(f"{i}", sum(map(sum, region))) for i, region in enumerate(topology.regions)], seed))
    by_region = [F.lit(first_rack[i]) + _winner(k, [(f"{i}/{j}", sum(rack)) for j, rack in enumerate(region)], seed) for i, region in enumerate(topology.regions)]
    df = df.withColumn("_rack", _by_node(F.col("_region"), by_region))
    by_rack = [F.lit(first_shard[n]) + _winner(k, [(f"{i}/{j}/{x}", w) for x, w in enumerate(rack)], seed) for n, (i, j, rack) in enumerate(racks)]
    return df.withColumn(out, _by_node(F.col("_rack"), by_rack).cast("int")).drop("_region", "_rack")


def with_slots(df: DataFrame, shard: str, order: list[str], rows: int) -> DataFrame:
    """Adds ``slot``: gapless numbers from 0 inside each shard.

    Numbering whole shards would sort a shard in one task. Rows are put into hash buckets, numbered inside each, and
    shifted by the rows of the shard's earlier buckets; the broadcast offsets hold shards * ``MAX_BUCKETS`` rows at most.
    """
    n = max(1, min(MAX_BUCKETS, rows // BUCKET_ROWS))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    counts = df.groupBy(shard, "_bucket").agg(F.count("*").alias("_n"))
    offsets = counts.selectExpr(
        f"{shard} AS _shard", "_bucket AS _b", f"sum(_n) OVER (PARTITION BY {shard} ORDER BY _bucket) - _n AS _offset"
    )
    ranked = df.selectExpr(
        "*", f"row_number() OVER (PARTITION BY {shard}, _bucket ORDER BY {', '.join(order)}) - 1 AS _rank"
    )
    same = (F.col(shard) == F.col("_shard")) & (F.col("_bucket") == F.col("_b"))
    return (
        ranked.join(F.broadcast(offsets), same)
        .withColumn("slot", F.col("_offset") + F.col("_rank"))
        .drop("_bucket", "_rank", "_shard", "_b", "_offset")
    )


def shard(df: DataFrame, topology: Topology, key: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """Adds size, text_crc32, law, shard, slot and grown_shard (with one more shard) to every row; the text stays out of the shuffle."""
    text_or_none = F.coalesce(F.col(text), F.lit(""))
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    sized = df.select(
            *[F.col(c) for c in df.columns if c not in (*new, text)],
            (F.octet_length(text_or_none) + 8).cast("long").alias("size"),
            F.crc32(text_or_none).alias("text_crc32"),
            F.lit("key").alias("law"),
        )
    sized = with_shard(sized, key, topology, seed, "shard")
    placed = written(with_shard(sized, key, topology.grown(), seed, "grown_shard"), "placed")
    return with_slots(placed, "shard", [key, "size", "text_crc32"], placed.count())
