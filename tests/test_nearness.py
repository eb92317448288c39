"""The region join and nearest neighbours on inputs that a plan or a cut could get wrong."""

import random

import numpy as np
import pytest

from paperloom.operators import knowledge, vectors

REGION, KNOWN = "region_id int, chr string, start long, end long", "kb_id int, chr string, start long, stop long"


def test_narrow_intervals_meet_in_narrow_bins_only(spark):
    rnd = random.Random(1)
    regions = [(i, "1", s := rnd.randrange(2_000_000), s + rnd.randrange(60)) for i in range(2000)]
    known = [(i, "1", s := rnd.randrange(2_000_000), s + rnd.randrange(60)) for i in range(2000)]
    r, k = spark.createDataFrame(regions, REGION), spark.createDataFrame(known, KNOWN)
    want = sorted((i, j) for i, _, a, b in regions for j, _, c, d in known if c <= b and d >= a)
    assert sorted(map(tuple, knowledge.overlaps(r, k).collect())) == want
    met = knowledge.candidates(r, k).count()
    assert met < 8 * len(want) + 100  # all pairs are 4,000,000


def test_regions_with_negative_starts_assemblies_and_clashing_names(spark):
    rnd = random.Random(2)
    span = lambda: (a := rnd.randrange(-90_000, 90_000), a + rnd.choice([0, 2, 64, 65, 1024, 30_000, 80_000_000]))
    regions = [(i, rnd.choice("12"), *span(), rnd.choice(["38", "37", None])) for i in range(70)]
    known = [(i, rnd.choice("12"), *span(), rnd.choice(["38", "37", None])) for i in range(70)]
    r = spark.createDataFrame(regions, REGION + ", assembly string").selectExpr("*", "1 AS _bin", "2 AS rs")
    k = spark.createDataFrame(known, KNOWN + ", assembly string").selectExpr("*", "1 AS _level", "2 AS ks")
    got = knowledge.overlaps(r, k, ("chr", "assembly"))
    assert sorted(map(tuple, got.collect())) == sorted((i, j) for i, x, a, b, s in regions for j, y, c, d, t in known if x == y and s is not None and s == t and c <= b and d >= a)
    assert knowledge.overlaps(r.limit(0), k).count() == 0
    assert {x["error"] for x in knowledge.enriched(r.where("assembly IS NULL"), k, ("chr", "assembly")).collect()} == {"missing coordinates"}


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("cells", [50, 4_000_000])
def test_equal_and_near_vectors_go_by_id(spark, monkeypatch, metric, cells):
    monkeypatch.setattr(vectors, "CELLS", cells)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 5)) * 1e4
    rows = [(i, base[0].tolist()) for i in range(100)] + [(100 + i, (base[i % 6] + rng.normal(size=5) * 1e-7).tolist()) for i in range(60)] + [(160, [0.0] * 5)]
    order = random.Random(5).sample(rows, len(rows))
    v = spark.createDataFrame(order, "vec_id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(i, rows[i][1]) for i in (0, 101, 105, 160)], "query_id long, embedding array<double>")
    got = {}
    for r in vectors.nearest(v, q, 5, metric).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    all_ = np.array([r[1] for r in rows])
    for i in got:
        x = np.array(rows[i][1])
        norm = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-300)
        s = -np.linalg.norm(all_ - x, axis=1) if metric == "l2" else norm(x) @ norm(all_).T
        assert [got[i][j] for j in range(1, 6)] == sorted(range(len(rows)), key=lambda j: (-round(s[j], 6), j))[:5]
    assert list(got[0].values()) == [0, 1, 2, 3, 4] or metric == "cosine"


def test_regions_are_made_distinct_once(spark):
    from paperloom.plans import QUERIES

    plan = QUERIES["region_enrich"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [region_id") == 1


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_many_queries_pass_few_vectors_once(spark, monkeypatch, metric):
    rng = np.random.default_rng(7)
    near = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(30)] + [(30, [0.0] * 4)]  # many ties
    v = spark.createDataFrame(random.Random(3).sample(near, len(near)), "vec_id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(100 + i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(90)], "query_id long, embedding array<double>").repartition(4)
    for k in (4, 40):
        want = vectors.nearest(v, q, k, metric)
        monkeypatch.setattr(vectors, "MAX_QUERIES", 31)
        got = vectors.nearest(v, q, k, metric)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Union" not in plan and "Window" not in plan  # not a branch for each block of queries
        assert got.dtypes == [(c, t) for c, t in want.dtypes] and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert vectors.nearest(v.limit(0), q, k, metric).count() == 0
        monkeypatch.setattr(vectors, "MAX_QUERIES", 10_000)


def test_contexts_are_embedded_once(spark, tmp_path):
    from paperloom.plans import coordinate_chain

    class Counting(coordinate_chain.HashEmbedder):
        def embed(self, texts):
            with open(f"{tmp_path}/asked", "a") as f:
                f.writelines("asked\n" for t in texts if t.startswith("about"))
            return super().embed(texts)

    found = spark.createDataFrame([(i, f"c.{i}A>G", f"about c.{i}A>G") for i in range(40)], "test_id long, coordinate string, context string")
    terms = spark.createDataFrame([("a", "lung"), ("b", "heart")], "id string, text string")
    assert coordinate_chain.termed(found, terms, embed=Counting).where("term IS NOT NULL").count() == 40
    assert len(open(f"{tmp_path}/asked").readlines()) == 40
