"""The join against brute force, and its parts."""

import random

import numpy as np
import pytest

from paperloom.llm import ngram_join
from paperloom.llm.signature_tree import Tree


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    ids, sets = [r[0] for r in rows], [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, k in enumerate(ids):
        least[find(i)] = min(least.get(find(i), k), k)
    return {(k, len(sets[i]), least[find(i)]) for i, k in enumerate(ids)}


def texts(seed, families=12, size=9):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    license_line = " ".join(rnd.choices(vocabulary, k=14))
    out = []
    for _ in range(families):
        base = rnd.choices(vocabulary, k=rnd.choice([3, 8, 30, 120, 300]))
        for _ in range(size):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            out.append(" ".join(words) + (f"\n{license_line}" if rnd.random() < 0.4 else ""))
    rnd.shuffle(out)
    return list(enumerate([*out, "", "  \n", "One TWO", "one two", "one\ttwo  ", "é É", out[0].upper()]))


@pytest.mark.parametrize("seed,block,short", [(1, 16_384, 64), (2, 300, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, block, short):
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "LOCAL_SHARED", 10)
    rows = texts(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = ngram_join.join(df).select("doc_id", "n_shingles", "component_id").collect()
    assert {tuple(r) for r in got} == brute(rows)
    assert len(got) == len(rows)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(5, None, 1), (3, "a b c d e f", 2), (3, "a b c d e f", 2), (None, "A b c d e f", 3), (9, "a b c d e f", 4), (7, "", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    got = sorted(tuple(r) for r in ngram_join.join(df).select("doc_id", "n_shingles", "component_id").na.fill(-1).collect())
    assert got == [(-1, 2, 3), (3, 2, 3), (3, 2, 3), (5, 0, 5), (7, 0, 7), (9, 2, 3)]


def test_no_set_is_written_or_travels(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 300)
    kept, kinds = ngram_join.written, set()

    def noted(df, *args, **more):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        kinds.update(t for _, t in df.dtypes)
        assert "members" not in plan
        return kept(df, *args, **more)

    monkeypatch.setattr(ngram_join, "written", noted)
    rows = texts(7, families=4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in ngram_join.join(df).select("doc_id", "n_shingles", "component_id").collect()} == brute(rows)
    assert "binary" not in kinds


def test_what_few_texts_of_each_batch_share_by_chance_is_found(spark):
    rnd = random.Random(3)
    phrases = [" ".join(f"p{i}x{j}" for j in range(5)) for i in range(115)]  # each in about 35 of 1,000 texts, and in 0.35 of a batch of 10
    rows = []
    for i in range(1000):
        parts = [*rnd.sample(phrases, 4), *(f"u{i}x{j}" for j in range(20))]
        rnd.shuffle(parts)
        rows.append((i, " ".join(parts), None, i))
    seen = ngram_join.profile(spark.createDataFrame(rows, "doc_id long, text string, mark long, hash long").repartition(100)).cache()
    own = {int(s.astype(np.int64)[0]) for s in ngram_join.Shingler().sets(phrases)}
    told = {r["a"] for r in seen.where("kind = 1").select("a").distinct().collect()}
    assert len(own & told) > 0.9 * len(own)  # three texts of one batch share fewer than half of them
    shared = {r["h"] for r in ngram_join.shared_shingles(seen).collect()}
    assert len(own & shared) > 0.8 * len(own) and shared <= own


def test_maps_hold_every_hash(spark):
    rnd = random.Random(2)
    own = [rnd.randrange(-(1 << 63), 1 << 63) for _ in range(300)] + [0, -1, 63, 64, (1 << 63) - 1]
    marks = ngram_join.bitmap(spark.createDataFrame([(h,) for h in own], "h long").repartition(3), 1 << 16)
    others = np.array([rnd.randrange(-(1 << 63), 1 << 63) for _ in range(10_000)])
    assert len(marks) == 1024 and ngram_join.marked(marks, np.array(own)).all() and ngram_join.marked(marks, others).mean() < 0.02
    assert not ngram_join.marked(ngram_join.bitmap(spark.createDataFrame([], "h long"), 1 << 16), others).any()


def test_empty_table(spark):
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("short,piece", [(64, 7), (4, 7), (4, 1000), (3, 1)])
def test_lists_connect_what_they_hold(monkeypatch, short, piece):
    monkeypatch.setattr(ngram_join, "SHORT", short)
    rnd = np.random.default_rng(5)
    rows = sorted({(int(h), int(10 + c % 7), int(c)) for h, c in zip(rnd.integers(0, 12, 150) ** 2, rnd.integers(0, 60, 150))})
    h, n, c = (np.array(x, dtype=np.int64) for x in zip(*rows))
    lists, got = ngram_join._Lists(ngram_join.Similarity()), {}
    for at in [*range(0, len(h), piece), None]:
        part = (h[:0], n[:0], c[:0]) if at is None else (h[at : at + piece], n[at : at + piece], c[at : at + piece])
        for u, v, _, _, k in lists.read(*part, last=at is None):
            for x, y, z in zip(u.tolist(), v.tolist(), k.tolist()):
                if x != y:
                    got[min(x, y), max(x, y)] = got.get((min(x, y), max(x, y)), 0) + z
    want = {}
    for i, (a, x, y) in enumerate(rows):
        for b, p, q in rows[:i]:
            if a == b and 4 * min(x, p) >= 3 * max(x, p):
                want[min(y, q), max(y, q)] = want.get((min(y, q), max(y, q)), 0) + 1
    exact = {k: z for k, z in got.items() if z < 1 << 40}
    assert all(want[k] >= z for k, z in exact.items())
    if short == 64:
        assert exact == want
    root = {x: x for x in range(60)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (x, y), z in got.items():
        if z >= 1 << 40:
            root[find(x)] = find(y)
    # What isn't counted in full is connected by long lists.
    assert all(exact.get(k, 0) == z or find(k[0]) == find(k[1]) for k, z in want.items())


def test_tree_finds_all_links():
    rnd = np.random.default_rng(4)
    sets = []
    for _ in range(30):
        base = rnd.integers(0, 2**63, rnd.integers(1, 200)).astype(np.uint64)
        for _ in range(8):
            keep = base[rnd.random(len(base)) > 0.12]
            sets.append(np.unique(keep if len(keep) else base))
    root = Tree(sets, 3, 4).linked()
    expect = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if 4 * both >= 3 * (len(a) + len(sets[j]) - both):
                x, y = expect[i], expect[j]
                expect = [min(x, y) if e in (x, y) else e for e in expect]
    assert root.tolist() == expect
