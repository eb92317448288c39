"""Connected components of an edge table: tasks contract bounded shares of the edges to forests, and what they leave apart goes
on by alternating large and small stars, whose every step is joins and grouped minima."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import scratch, written

#: Edges that a task contracts at a time, of 16 bytes each. Up to so many need one task and no stars.
TASK_EDGES = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes but the roots, and the least node of each one's component."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = ends[: len(u)], ends[len(u) :], np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # a root hangs onto a lesser one
        while not np.array_equal(up := root[root], root):
            root = up
    ok = root != np.arange(len(root))
    return nodes[ok], nodes[root[ok]]


def _contracted(e: DataFrame, tasks: int, most: int) -> DataFrame:
    """The same components from a forest of each task's edges; a task holds 2 * ``most`` edges and a batch."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, size = [], [], 0
        for part in parts:
            us.append(part.column(0).to_numpy())
            vs.append(part.column(1).to_numpy())
            size += part.num_rows
            if size > 2 * most:
                u, v = forest(np.concatenate(us), np.concatenate(vs))
                us, vs, size = [u], [v], len(u)
                if size > most:
                    yield _batch(u, v)
                    us, vs, size = [], [], 0
        if size:
            yield _batch(*forest(np.concatenate(us), np.concatenate(vs)))

    return e.coalesce(max(1, tasks)).mapInArrow(run, "u long, v long")


def _batch(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _minima(pairs: DataFrame) -> DataFrame:
    return written(pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "minima")


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """``edges``: two columns of longs, any direction, loops and repeats allowed. Returns node, root (the least node of
    its component) for every node but the roots themselves. Joins write their minima first, so that both sides are plain
    exchanges and a node with very many edges can be split."""
    a, b = edges.columns
    with scratch(edges.sparkSession):
        e = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), "edges")
        many = e.count()
        while many > task_edges:  # as long as the tasks' forests have less than half of the edges
            less = written(_contracted(e, math.ceil(many / task_edges), task_edges).distinct(), "forests")
            e, before, many = less, many, less.count()
            if 2 * many > before:
                break
        if many > task_edges:
            while not _settled(e):  # every round brings some edge's end nearer to the least node
                with scratch(edges.sparkSession):
                    e = _round(e)
        else:
            e = _contracted(e, 1, task_edges)
        e = written(e, "components", lasting=True)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _settled(e: DataFrame) -> bool:
    """Whether the edges, each from a greater to a lesser node, are stars around the least nodes: no node has two edges down, or
    edges both down and up. One count for each node and no join."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("down")))).alias("end"))
    node = ends.groupBy("end.node").agg(F.sum("end.down").alias("down"), F.min("end.down").alias("least"))
    return node.where("down > 1 OR (down = 1 AND least = 0)").agg(F.count("*")).first()[0] == 0


def _round(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = both.where("v > u").join(_minima(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    large = written(large, "large-star")
    least = _minima(large)
    small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return written(small.unionByName(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct(), "small-star", lasting=True)
