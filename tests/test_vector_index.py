"""Recall of the index against the exact search, and its odd cases."""

import numpy as np

from pyspark.sql import functions as F

from paperloom.operators import vector_index as I
from paperloom.operators import vectors as V


def recall(spark, df, path, k=10, **fit):
    index = I.fit(df, k=k, **fit)
    I.write(df, index, path)
    q = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {tuple(r) for r in I.search(spark, path, index, q, k).select("query_id", "vec_id").collect()}
    true = {tuple(r) for r in V.nearest(df, q, k, "cosine").select("query_id", "vec_id").collect()}
    return len(got & true) / len(true), index


def test_recall_and_pruning(spark, tmp_path):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(30, 16))
    rows = [(i, (centers[i % 30] + 0.5 * rng.normal(size=16)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found, index = recall(spark, df, f"file://{tmp_path}/a")
    assert found >= 0.9 and index.probes < len(index.centroids) / 3  # clusters: few parts are looked into
    assert spark.read.parquet(f"file://{tmp_path}/a").count() == 3000
    apart = spark.createDataFrame([(i, rng.normal(size=16).tolist()) for i in range(1500)], "vec_id long, embedding array<double>")
    assert recall(spark, apart, f"file://{tmp_path}/b")[0] >= 0.9  # no clusters: more parts
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert recall(spark, table, f"file://{tmp_path}/c", k=5)[0] >= 0.9


def test_the_sample_is_bounded_and_all_vectors_are_indexed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "SAMPLE", 300)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, index = recall(spark, df, f"file://{tmp_path}/a")
    assert len(index.centroids) <= 18 and found >= 0.9
    assert spark.read.parquet(f"file://{tmp_path}/a").select("vec_id").distinct().count() == 2000


def test_ties_zeros_and_empty_tables(spark, tmp_path):
    rows = [(i, [1.0, 0.0]) for i in range(50)] + [(50, [0.0, 0.0]), (51, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    index = I.fit(df, parts=2, k=3, recall=1.0)
    I.write(df, index, f"file://{tmp_path}/a")
    q = spark.createDataFrame([(1, [5.0, 0.0]), (2, [0.0, 0.1])], "query_id long, embedding array<double>")
    got = [(r["query_id"], r["vec_id"], r["score"]) for r in I.search(spark, f"file://{tmp_path}/a", index, q, 3).orderBy("query_id", "rank").collect()]
    assert got[:3] == [(1, 0, 1.0), (1, 1, 1.0), (1, 2, 1.0)] and got[3] == (2, 51, 1.0)
    assert I.search(spark, f"file://{tmp_path}/a", index, q.limit(0), 3).count() == 0
    I.write(df.limit(0), I.fit(df.limit(0)), f"file://{tmp_path}/b")
    assert I.fit(df.limit(0)).probes == 1
