"""Mixing and sharding: their laws, against plain Python, and the whole pipeline on a small table."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paperloom.llm import mixing, sharding
from paperloom.llm.sharding import Topology

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def made(n, seed=1):
    rnd = random.Random(seed)
    return [(i, " ".join(["w"] * rnd.randrange(0, 40)), rnd.choice(["en", "en", "de", None]), rnd.choice(["s0", "s0", "s1", "s2", None]), 0) for i in range(n)]


def fill(budget, children):
    """children: name -> (capacity, weight); by repeated sharing."""
    got, left = dict.fromkeys(children, 0.0), budget
    open_ = {k for k, (c, w) in children.items() if w > 0}
    while open_ and left > 1e-9:
        total = sum(children[k][1] for k in open_)
        full = {k for k in open_ if children[k][0] - got[k] <= left * children[k][1] / total + 1e-9}
        if not full:
            for k in open_:
                got[k] += left * children[k][1] / total
            break
        for k in full:
            left -= children[k][0] - got[k]
            got[k] = children[k][0]
        open_ -= full
        # The rest shares what is left anew; nothing has been given to it yet.
    return got


@pytest.mark.parametrize("share,epochs", [(0.5, 1), (0.9, 2), (1.7, 3)])
def test_mixing_equals_plain_budgeting(spark, share, epochs):
    rows = made(300) + [(300, None, "en", "s1", 0), (301, "w w", "en", "s1", 0), (301, "w w", "en", "s1", 0)]
    plan = mixing.Plan(share=share, max_epochs=epochs, seed=3, weights={("lang", "en"): 3.0, ("source", "s2"): 0.0})
    df = spark.createDataFrame(rows, DOCS).withColumn("epoch", F.lit("old"))
    got = Counter((r["doc_id"], r["epoch"]) for r in mixing.mix(df, plan, F.when(F.col("source") == "s0", "d0").otherwise("d1")).collect())
    count = lambda t: len((t or "").split())
    leaf = lambda r: ("d0" if r[3] == "s0" else "d1", r[2] or "?", r[3] or "?")
    tokens = Counter()
    for r in rows:
        tokens[leaf(r)] += count(r[1])
    budget = {(): share * sum(tokens.values())}
    for level in range(3):
        for up in [k for k in list(budget) if len(k) == level]:
            caps = defaultdict(float)
            for k, n in tokens.items():
                if k[:level] == up:
                    caps[k[: level + 1]] += n * epochs
            weight = lambda k: plan.weights.get((mixing.LEVELS[level], k[-1]), 1.0)  # noqa: B023, E731
            budget |= fill(budget[up], {k: (c, weight(k)) for k, c in caps.items()})
    want = Counter()
    for k, n in tokens.items():
        if not n or plan.weights.get(("source", k[2])) == 0.0:
            continue
        whole, rest = divmod(int(budget[k] + 1e-6), n)
        mine = [r for r in rows if leaf(r) == k]
        order = lambda r: hashlib.md5(f"3:{whole}:{r[0]}".encode()).hexdigest()  # noqa: B023, E731
        upto = 0
        by = defaultdict(list)
        for r in mine:
            by[order(r)].append(r)
        inside = set()
        for o in sorted(by):
            upto += sum(count(r[1]) for r in by[o])
            if rest > 0 and upto <= rest:
                inside.add(o)
        for r in mine:
            for e in range(whole + (order(r) in inside)):
                want[r[0], e] += 1
    assert got == want


def test_mixing_of_an_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS), mixing.Plan(), F.lit("d")).count() == 0


def test_shards_keep_their_law(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 100)
    rows = [(i, f"text {i % 7}é") for i in range(6000)] + [(6000, None), (6001, ""), (6002, "x"), (6002, "x"), (None, "y")]
    df = spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, shard string")
    got = sharding.shard(df, Topology.uniform(2, 3, 4), seed=5).collect()
    assert len(got) == len(rows)
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(24)) and max(sizes.values()) < 1.35 * min(sizes.values())
    grown = Counter(r["grown_shard"] for r in got)
    assert all(r["grown_shard"] in (r["shard"], 24) for r in got) and 170 < grown[24] < 310
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    texts = dict(rows)
    assert all(r["size"] == len((texts[r["doc_id"]] or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in got)
    assert sharding.shard(df.limit(0), Topology.uniform(1, 1, 2)).count() == 0


def test_changed_weights_move_rows_only_into_what_grew(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    old = Topology(((((1.0, 1.0)), (1.0, 1.0)), ((1.0, 1.0), (1.0, 1.0))))
    new = Topology(((((3.0, 1.0)), (1.0, 1.0)), ((1.0, 1.0), (1.0, 1.0))))
    both = sharding.with_shard(sharding.with_shard(df, "doc_id", old, 1, "a"), "doc_id", new, 1, "b").collect()
    assert all(r["b"] < 4 for r in both if r["a"] != r["b"])  # inside the region that grew
    assert all(r["b"] == r["a"] for r in both if r["b"] >= 4)
    shares = Counter(r["b"] for r in both)
    assert 0.24 < shares[0] / 5000 < 0.36


def test_pipeline(spark, tmp_path):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    item = " ".join(rnd.choices(words, k=30))
    clean = [(i, " ".join(rnd.choices(words, k=120)), "en", f"src{i % 4}", 0) for i in range(40)]
    copies = [(100 + i, clean[i][1] + " tail", "en", "src1", 0) for i in range(5)] + [(200, clean[7][1], "de", "src2", 0), (201, clean[7][1], "de", "src2", 0)]
    leaks = [(300 + i, " ".join(rnd.choices(words, k=60)) + " " + item.upper(), "en", "src1", 0) for i in range(3)]
    junk = [(400, "a b c d e " * 30, "en", "src1", 0), (401, "too short", "en", "src1", 0), (402, None, "en", "src1", 0)]
    rows = clean + copies + leaks + junk
    d = f"file://{tmp_path}"
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, d)
        assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    first = {r[0] for r in clean}
    assert kept == [first | {r[0] for r in copies + leaks}, first | {r[0] for r in leaks}, first]
    out = corpus_pipeline.run(spark, d).collect()
    assert {r["doc_id"] for r in out} < first and len(out) == len({r["doc_id"] for r in out}) and 25 <= len(out) < 40
