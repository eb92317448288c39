"""Operators on small tables, sources and sinks, streams against their batch form, and every query with SQL against DuckDB."""

import json
import math

import pytest
from pyspark.sql import functions as F

from paperloom.operators import cooccurrence as C
from paperloom.operators import knowledge as K
from paperloom.operators import vectors as V
from paperloom.plans import ORACLES, QUERIES
from paperloom.plans.scoring import embedded, scored
from paperloom.sources import readers, writers
from paperloom.streaming import batches

SF = "/root/testdata/sf0.001"
ANN = "pmid string, ann_id string, pos int, label string, identifier string, type string, category string, score int, accepted boolean, flag string"


def ann(spark, rows):
    return spark.createDataFrame([(p, f"{p}{i}", i, label, "", c, c, 1, True, "A") for i, (p, label, c) in enumerate(rows)], ANN)


def test_flattening_crosses_genes_diseases_and_tissues(spark):
    a = ann(spark, [("1", "v", "variant"), ("1", "g1", "gene"), ("1", "g2", "gene"), ("1", "d1", "disease"), ("1", "d2", "disease"), ("1", "t", "tissue"), ("2", "g3", "gene"), ("3", "w", "variant")])
    got = sorted((r["variant"], r["gene"], r["disease"], r["tissue"]) for r in C.flattened(a).collect())
    assert got == [("v", g, d, "t") for g in ("g1", "g2") for d in ("d1", "d2")] + [("w", "", "", "")]
    assert C.all_pairs(a).count() == 6 and C.all_pairs(a, keep_lonely=False).count() == 5


def test_region_join_equals_plain_overlap(spark):
    import random

    rnd = random.Random(2)
    span = lambda: (lambda s: (s, s + rnd.randrange(300)))(rnd.randrange(2000))
    r = [(i, rnd.choice("12"), *span()) for i in range(60)] + [(99, "1", 9, 3)]
    k = [(i, rnd.choice("12"), *span()) for i in range(60)]
    got = sorted(map(tuple, K.overlaps(spark.createDataFrame(r, "region_id long, chr string, start long, end long"), spark.createDataFrame(k, "kb_id long, chr string, start long, stop long")).collect()))
    assert got == sorted((a, b) for a, c, s, e in r for b, d, x, y in k if c == d and s <= e and x <= e and y >= s)


def test_nearest_equals_brute_force(spark):
    import numpy as np

    v = np.random.default_rng(3).normal(size=(80, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(5)
    q = df.where("vec_id < 4").select(F.col("vec_id").alias("query_id"), "embedding")
    for metric in ("cosine", "l2"):
        got = {(r["query_id"], r["rank"]): r["vec_id"] for r in V.nearest(df, q, 6, metric).collect()}
        f = v.astype(np.float32).astype(float)
        for i in range(4):
            s = (f @ f[i]) / np.linalg.norm(f, axis=1) / np.linalg.norm(f[i]) if metric == "cosine" else -np.linalg.norm(f - f[i], axis=1)
            assert [got[i, k + 1] for k in range(6)] == sorted(range(80), key=lambda j: (-round(s[j], 6), j))[:6]


def test_publications_in_both_envelopes(spark, tmp_path):
    doc = {"id": "7", "infons": {}, "passages": [{"offset": 0, "infons": {"type": "title"}, "text": "t", "annotations": [{"id": "a", "text": "x", "infons": {"type": "Gene"}, "locations": [{"offset": 3, "length": 1}]}, {"id": "b", "text": "y", "infons": {}}]}]}
    for name, key in (("one", "PubTator3"), ("two", "documents")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.json").write_text(json.dumps({key: [doc]}))
        got = readers.annotations(readers.publications(spark, str(tmp_path / name))).collect()
        assert [(r["pmid"], r["label"], r["type"], r["identifier"], r["pos"]) for r in got] == [("7", "x", "Gene", "", 3), ("7", "y", None, "", None)]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "f.json").write_text("{}")
    with pytest.raises(Exception, match="no documents"):
        readers.publications(spark, str(tmp_path / "bad")).collect()


def test_files_there_and_back(spark, tmp_path):
    df = spark.createDataFrame([("2", "a\n\"b\""), ("10", "c"), ("2", "d")], "pmid string, x string")
    writers.csv(df.replace('a\n"b"', "a;b"), str(tmp_path / "c"), ["x"])
    df = df.replace('a\n"b"', "a;b")
    assert sorted(map(tuple, readers.curated(spark, str(tmp_path / "c")).select("pmid", "x").collect())) == sorted(map(tuple, df.collect()))
    writers.id_list(df, str(tmp_path / "i"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "i")).collect()] == ["10", "2"]
    assert not writers.json_lines(df.limit(0), str(tmp_path / "j")) and writers.json_lines(df, str(tmp_path / "j"))
    (tmp_path / "o.obo").write_text('format: 1\n\n[Term]\nid: SO:1\nname: region\ndef: "A part." [x]\n\n[Typedef]\nid: y\n\n')
    assert list(map(tuple, readers.ontology(spark, str(tmp_path / "o.obo")).collect())) == [("SO:1", "region", "A part.")]


def test_stream_has_the_batch_result(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    q = batches.tumbling_counts(batches.events_stream(spark, str(tmp_path / "in")), late="60 days").writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted((r["start"], r["event_type"], r["n"]) for r in df.collect())
    assert key(spark.table("tumbling")) == key(batches.tumbling_counts(source))


def test_models_are_pluggable(spark):
    pairs = spark.createDataFrame([("v1", "TP53", "V1 in tp53"), ("v2", None, "x")], "variant string, entity string, passage string")
    assert sorted((r["variant"], r["has_relationship"], r["relationship_score"]) for r in scored(pairs).collect())[0] == ("v1", True, 10)
    e = embedded(spark.createDataFrame([(1, "a b"), (2, "A B"), (3, "")], "id int, text string")).collect()
    assert e[0]["embedding"] == e[1]["embedding"]


def shown(v):
    return "null" if v is None else f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in names) for r in df.collect())
    rel = duck.execute(ORACLES[name])
    at = {d[0]: i for i, d in enumerate(rel.description)}
    assert sorted(at) == names
    assert got == sorted(tuple(shown(r[at[c]]) for c in names) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_pair_metrics_of_known_sweep(spark):
    got = [tuple(r) for r in QUERIES["evidence_sweep"](spark, "/root/testdata/sf0.01").select("threshold", "tp", "fp", "fn").orderBy("threshold").collect()]
    assert got == [(None, 2069, 1996, 678), (6, 919, 911, 511), (7, 691, 684, 402), (8, 521, 493, 317), (9, 332, 302, 204), (10, 99, 116, 88)]


def test_name_pairs_and_diseases_are_checked_whole(spark):
    names = spark.read.parquet(f"{SF}/part.parquet").select("p_name").distinct().count()
    for name in ("text_ratio", "text_similar", "text_similar_rules"):
        assert QUERIES[name](spark, SF).select("a", "b").distinct().count() == names**2
    parts = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("l_partkey kb_id").distinct()
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", "l_partkey + l_linenumber % 2 * 5 kb_id").join(parts, "kb_id")
    assert QUERIES["validate_disease"](spark, SF).select("l_orderkey", "l_linenumber", "kb_id").distinct().count() == lines.distinct().count()
