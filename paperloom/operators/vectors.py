"""Nearest neighbours of a stated set of query vectors, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

#: Query vectors that are broadcast together, about; more go block by block, or past the vectors if those are no more than that.
MAX_QUERIES = 10_000
#: Scores that a task holds at a time.
CELLS = 4_000_000


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """query_id, vec_id, score (rounded to 6 places), rank. ``vectors``: vec_id, embedding; ``queries``: query_id, embedding.

    Queries go in blocks of about ``MAX_QUERIES``, each broadcast; every batch of vectors is one matrix product and gives its own
    k best for each query of the block, so only k rows for each query and batch reach the final ranking. Ties go to the lower
    vec_id. A vector without length has the cosine 0 with all.

    Where there are more queries than that but not more vectors, the vectors are broadcast instead, once, and each batch of queries gets
    its final ranks where it is. Queries in several blocks are read again for each, so they had better be written before.
    """
    n_blocks = max(1, -(-queries.count() // MAX_QUERIES))
    if n_blocks > 1:
        few = vectors.select("vec_id", "embedding").limit(MAX_QUERIES + 1).collect()
        if len(few) <= MAX_QUERIES:
            return _past(few, queries, k, metric)
    got = None
    for b in range(n_blocks):
        block = queries if n_blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b)
        found = _block(vectors, block.orderBy("query_id").collect(), k, metric)
        got = found if got is None else got.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return got.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("score", F.abs(F.col("score")) if metric != "cosine" else F.col("score"))


def _distances(q: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """Less the Euclidean distance of each query and vector that may be among the query's ``k`` nearest, the others far away.

    The expanded square loses digits for near vectors, at most ``lost``. All within twice that, and the rounding of results, of the k-th value are
    measured by differences, so that equals are all there, however many they are."""
    qq, vv = (q**2).sum(1)[:, None], (v**2).sum(1)[None, :]
    square = np.maximum(qq + vv - 2 * q @ v.T, 0)
    lost = (qq + vv.max()) * (q.shape[1] + 8) * np.finfo(np.float64).eps
    kth = np.partition(square, min(k, len(v)) - 1, axis=1)[:, min(k, len(v)) - 1 : min(k, len(v))]
    near = square <= (np.sqrt(kth + lost) + 1e-6) ** 2 + lost
    out = np.full(square.shape, -np.inf)
    for i, at in enumerate(near):
        out[i, at] = -np.linalg.norm(v[at] - q[i], axis=1)
    return out


def _best(scores: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's ``k`` highest scores, ties by name; only scores that reach the k-th one are sorted."""
    kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    row, at = np.nonzero(scores >= kth[:, None])
    order = np.lexsort((names[at], -scores[row, at], row))
    row, at = row[order], at[order]
    first = np.searchsorted(row, np.arange(len(scores)))
    return at[first[:, None] + np.arange(k)]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _scores(q: np.ndarray, v: np.ndarray, k: int, metric: str) -> np.ndarray:
    return np.round(_unit(q) @ _unit(v).T if metric == "cosine" else _distances(q, v, k), 6)


def _past(rows: list, queries: DataFrame, k: int, metric: str) -> DataFrame:
    """As ``nearest``, for all vectors as rows: a batch of queries at a time meets all of them."""
    rows = sorted(rows, key=lambda r: r["vec_id"])
    held = queries.sparkSession.sparkContext.broadcast((np.array([r["vec_id"] for r in rows], dtype=np.int64), np.array([r["embedding"] for r in rows], dtype=np.float64)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, v = held.value
        for pdf in batches:
            if not len(names):
                continue
            step, most = max(1, CELLS // len(v)), min(k, len(v))
            for i in range(0, len(pdf), step):
                own = pdf.iloc[i : i + step]
                s = _scores(np.stack(own["embedding"].to_numpy()).astype(np.float64), v, k, metric)
                best = _best(s, names, most)
                got = np.take_along_axis(s, best, 1)
                yield pd.DataFrame({
                    "query_id": np.repeat(own["query_id"].to_numpy(), most), "vec_id": names[best].ravel(), "score": (got if metric == "cosine" else np.abs(got)).ravel(), "rank": np.tile(np.arange(1, most + 1, dtype=np.int32), len(own)),
                })

    return queries.select("query_id", "embedding").mapInPandas(score, "query_id long, vec_id long, score double, rank int")


def _block(vectors: DataFrame, rows: list, k: int, metric: str) -> DataFrame:
    ids = np.array([r["query_id"] for r in rows], dtype=np.int64)
    matrix = np.array([r["embedding"] for r in rows], dtype=np.float64) if rows else np.zeros((0, 1))
    held = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, q = held.value
        for pdf in batches:
            if not len(pdf) or not len(q_ids):
                continue
            v, names = np.stack(pdf["embedding"].to_numpy()).astype(np.float64), pdf["vec_id"].to_numpy()
            step = max(1, CELLS // len(v))
            for i in range(0, len(q), step):
                s = _scores(q[i : i + step], v, k, metric)
                best = _best(s, names, min(k, len(v)))
                yield pd.DataFrame({"query_id": np.repeat(q_ids[i : i + step], best.shape[1]), "vec_id": names[best].ravel(), "score": np.take_along_axis(s, best, 1).ravel()})

    return vectors.select("vec_id", "embedding").mapInPandas(score, "query_id long, vec_id long, score double")
