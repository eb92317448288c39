"""Nearest neighbours by an inverted index: vectors are parted by their nearest centroid, and a query looks into the parts nearest to it.

Centroids, and how many parts a query must look into, are fitted on a sample of at most ``SAMPLE`` vectors, drawn by a hash of their ids; all
vectors are indexed, whatever their number. The number of parts is the least with which ``recall`` of the sample's true neighbours are found for queries out of the
sample. In a sample neighbours are further off than among all vectors, so there the recall is rather higher. ``vectors.nearest`` is the exact way.

The index is a table parted by ``part``, so a search reads the parts that some query looks into only. Queries go in blocks, and each batch of vectors
meets the queries of its part by a matrix product; only k rows for each query and batch go on. Ties go to the lower vec_id.

Cases: equal vectors are in the same part; vectors without length have the cosine 0 with all and are in part 0; fewer vectors than parts
leave parts empty; no vectors or no queries give no rows; the embeddings of a table have one length and no nulls.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.operators import vectors as V

#: Vectors that the centroids are fitted on, at most.
SAMPLE = 20_000
ROUNDS = 12


@dataclass(frozen=True)
class Index:
    """Unit centroids, a row each, and the number of parts that a query looks into."""

    centroids: np.ndarray
    probes: int
    recall: float  # of the sample


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def fit(vectors: DataFrame, parts: int | None = None, k: int = 10, recall: float = 0.95) -> Index:
    """Centroids by rounds of assignment and mean on the sample; ``parts`` is the square root of the sample's size unless given."""
    n = vectors.count()
    chosen = vectors if n <= SAMPLE else vectors.where(F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * SAMPLE / n * 0.95)).limit(SAMPLE)
    rows = sorted(chosen.select("vec_id", "embedding").collect())
    if not rows:
        return Index(np.zeros((1, 1)), 1, 1.0)
    x = _unit(np.array([r["embedding"] for r in rows], dtype=np.float64))
    parts = min(len(x), parts or max(1, round(len(x) ** 0.5)))
    c = np.unique(x, axis=0)
    c = c[np.linspace(0, len(c) - 1, min(parts, len(c))).astype(int)]
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(1)
        sums, sizes = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(sums, own, x)
        c = np.where(sizes[:, None] > 0, _unit(sums), c)
    own = (x @ c.T).argmax(1)
    asked = x[:: max(1, len(x) // 500)]
    true = np.argpartition(-(asked @ x.T), min(k, len(x) - 1), axis=1)[:, :k]
    order = np.argsort(np.argsort(-(asked @ c.T), axis=1), axis=1)  # the place of each part for each query
    needed = np.sort(np.take_along_axis(order, own[true], 1).ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1
    return Index(c, probes, float((needed < probes).mean()))


def parted(vectors: DataFrame, index: Index) -> DataFrame:
    """vec_id, embedding and ``part`` of all vectors."""
    held = vectors.sparkSession.sparkContext.broadcast(index.centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = _unit(np.stack(pdf["embedding"].to_numpy()).astype(np.float64))
                yield pdf.assign(part=(x @ held.value.T).argmax(1).astype(np.int32))

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.select("vec_id", "embedding").mapInPandas(run, f"vec_id long, embedding {kind}, part int")


def write(vectors: DataFrame, index: Index, path: str) -> None:
    """All vectors, parted on disk; a part with very many goes to several files."""
    rows = parted(vectors, index)
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(8))
    rows.repartition("part", salt).write.partitionBy("part").parquet(path)


def search(spark: SparkSession, path: str, index: Index, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score (cosine, rounded to 6 places), rank over the index at ``path``."""
    stored = spark.read.schema("vec_id long, embedding array<double>, part int").parquet(path)
    n_blocks = max(1, -(-queries.count() // V.MAX_QUERIES))
    got = None
    for b in range(n_blocks):
        block = queries if n_blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b)
        found = _block(stored, block.orderBy("query_id").collect(), index, k)
        got = found if got is None else got.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return got.withColumn("rank", rank).where(F.col("rank") <= k)


def _block(stored: DataFrame, rows: list, index: Index, k: int) -> DataFrame:
    ids = np.array([r["query_id"] for r in rows], dtype=np.int64)
    q = _unit(np.array([r["embedding"] for r in rows], dtype=np.float64)) if rows else np.zeros((0, index.centroids.shape[1]))
    probes = np.argsort(-(q @ index.centroids.T), axis=1)[:, : index.probes]
    lookers = {int(p): np.flatnonzero((probes == p).any(1)) for p in np.unique(probes)}
    held = stored.sparkSession.sparkContext.broadcast((ids, q, lookers))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q, lookers = held.value
        for pdf in batches:
            for part, own in pdf.groupby("part"):
                at, v, names = lookers.get(int(part), []), _unit(np.stack(own["embedding"].to_numpy()).astype(np.float64)), own["vec_id"].to_numpy()
                step = max(1, V.CELLS // len(v))
                for i in range(0, len(at), step):
                    s = np.round(q[at[i : i + step]] @ v.T, 6)
                    best = np.lexsort((np.broadcast_to(names, s.shape), -s), axis=1)[:, : min(k, len(v))]
                    yield pd.DataFrame({"query_id": np.repeat(ids[at[i : i + step]], best.shape[1]), "vec_id": names[best].ravel(), "score": np.take_along_axis(s, best, 1).ravel()})

    return stored.where(F.col("part").isin(list(lookers))).mapInPandas(run, "query_id long, vec_id long, score double")
