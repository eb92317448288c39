"""The chain against a plain loop over texts, and the splitter's pieces."""

import json
import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import splitter
from paperloom.plans import coordinate_chain as C


def test_tests_equal_a_plain_loop(spark, tmp_path):
    rnd = random.Random(4)
    sentence = lambda: rnd.choice(["lung and gene A1", "heart of B2", "nothing", "LUNG only"])
    texts = [(i, "\n".join(f"{sentence()} c.{rnd.randrange(6)}A>G {sentence()}" for _ in range(rnd.randint(0, 5)))) for i in range(25)] + [(25, None), (26, "")]
    tests = [(t, rnd.sample(range(30), rnd.randint(0, 5)), f"c.{rnd.randrange(7)}A>G", rnd.choice([{"tissue": "lung"}, {"tissue": "lung", "gene": "A1"}, {"gene": "B2", "x": "c.1"}, {}])) for t in range(60)]
    terms = spark.createDataFrame([("T1", "lung"), ("T2", "heart of"), ("T3", "gene A1")], "id string, text string")
    got = C.tested(
        spark.createDataFrame(tests, "test_id int, pmids array<int>, coordinate string, query map<string,string>"), spark.createDataFrame(texts, "pmid int, text string"), terms, cache=f"file://{tmp_path}/cache"
    )
    known, want = dict(texts), {}
    for t, pmids, coordinate, query in tests:
        want[t] = (False, None)
        for p in pmids:
            text = known.get(p) or ""
            if coordinate in text:
                context = " ".join(x for x in text.split("\n") if coordinate in x).lower()
                want[t] = (True, all(v.lower() in context for v in query.values()))
                break
    assert {r["test_id"]: (r["found"], r["linked"]) for r in got.collect()} == want
    assert {v for v in want.values()} == {(False, None), (True, True), (True, False)}


def test_terms_are_chosen_among_the_nearest(spark):
    found = spark.createDataFrame([("c.1A>G", "the lung is here"), ("c.2A>G", "a heart"), ("c.3A>G", "")], "coordinate string, context string")
    terms = spark.createDataFrame([("T1", "lung"), ("T2", "heart"), ("T3", "other words")], "id string, text string")
    got = {r["coordinate"]: json.loads(r["term"])["id"] for r in C.termed(found, terms, near=2).collect()}
    assert got["c.1A>G"] == "T1" and got["c.2A>G"] == "T2"
    assert C.links(C.termed(found, terms), F.create_map(F.lit("k"), F.lit("heart"))).where("link").count() == 1


@pytest.mark.parametrize("size,overlap", [(5, 0), (20, 7), (100, 99), (64, 20)])
def test_pieces_keep_to_the_size_and_lose_nothing(size, overlap):
    rnd = random.Random(size)
    for _ in range(150):
        parts = [rnd.choice([f"w{i}é", " ", "\n", "\n\n", "".join(f"{1000 * i + k}," for k in range(rnd.randint(1, 20))), f"s{i}. "]) for i in range(rnd.randint(0, 80))]
        text = "".join(parts)  # no two places read the same
        got = splitter.split(text, size, overlap)
        assert all(0 < len(p) <= size and p == p.strip() for p in got)
        at = 0
        for p in got:  # pieces come in order, and all but white space is in one
            where = max(text.find(p, max(0, at - overlap - 2) if overlap else at), 0)
            assert not text[at:where].strip(), (text, got)
            at = max(at, where + len(p))
        assert not text[at:].strip()
        if not overlap:
            assert "".join("".join(got).split()) == "".join(text.split())


def test_pieces_of_tables(spark):
    df = spark.createDataFrame([(1, "a b\n\nc d", "x"), (2, None, "y"), (3, " \n", "z"), (1, "a b\n\nc d", "x")], "id int, text string, piece string")
    rows = splitter.pieces(df, 4).select("id", "piece", "text").collect()
    assert sorted(map(tuple, rows)) == [(1, 0, "a b"), (1, 0, "a b"), (1, 1, "c d"), (1, 1, "c d")]
    assert [r["text"] for r in splitter.pieces(df.where("id = 1").limit(1), 3, 1, length=splitter.words).collect()] == ["a b", "c d"]
    assert splitter.pieces(df.limit(0), 4).count() == 0
    with pytest.raises(ValueError):
        splitter.pieces(df, 4, 4)


def test_of_terms_of_equal_text_only_the_lowest_are_compared(spark, monkeypatch):
    """The nearest of many terms that share few texts are those of a plain ranking of all of them."""
    rnd = random.Random(6)
    rows = [(f"T{i}", rnd.choice(["lung", "heart of", "gene A1", "lung heart", "", None])) for i in range(400)]
    terms = spark.createDataFrame(rows, "id string, text string")
    known = C.lowest(terms, 3)
    assert known.count() <= 5 * 3  # no text and the empty one are the same
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["lung", "heart", "A1 gene lung", "nothing", ""])], "query_id long, text string")
    queries = C.embedded(texts).select("query_id", "embedding")
    near = lambda t: sorted(map(tuple, C.vectors.nearest(C.embedded(t.select("vec_id", "text")), queries, 3).select("query_id", "vec_id", "rank").collect()))
    assert near(known) == near(terms.select(F.xxhash64("id").alias("vec_id"), "text"))
    seen = spark.sparkContext.accumulator(0)

    class Counts(C.HashEmbedder):
        def embed(self, some):
            seen.add(len(some))
            return super().embed(some)

    found = spark.createDataFrame([("c.1A>G", "the lung is here")], "coordinate string, context string")
    assert C.termed(found, terms, embed=Counts, near=2).count() == 1 and seen.value <= 2 * (5 * 2 + 1)


def test_best_places_equal_a_full_sort():
    import numpy as np

    rnd = np.random.default_rng(2)
    for n, k in ((1, 1), (7, 3), (50, 5), (5, 5)):
        scores, names = rnd.integers(0, 4, (9, n)) / 4, rnd.permutation(n) - 3
        scores[0] = -np.inf
        want = np.lexsort((np.broadcast_to(names, scores.shape), -scores), axis=1)[:, :k]
        assert (C.vectors._best(scores, names, k) == want).all()


def test_pieces_of_many_texts_come_together(spark, monkeypatch):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else "ab cd" * (i % 5)) for i in range(200)], "id long, text string").coalesce(1)
    want = [(i, n, p) for i, t in df.collect() if t for n, p in enumerate(splitter.split(t, 4, 1))]
    got = splitter.pieces(df, 4, 1)
    assert [tuple(r) for r in got.select("id", "piece", "text").collect()] == want

    class Table:
        schema, select = df.schema, lambda self, *c: self

        def mapInPandas(self, run, ddl):
            return run([df.toPandas()])

    for most, least in ((4_000_000, 1), (100, 5)):
        monkeypatch.setattr(splitter, "TOGETHER", most)
        frames = list(splitter.pieces(Table(), 4, 1))
        assert [tuple(r) for f in frames for r in f[["id", "piece", "text"]].itertuples(index=False)] == want
        assert least <= len(frames) < 30  # one for each text was 137
