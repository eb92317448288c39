"""The similarity join against all pairs."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from paperloom.functions import similarity as S
from paperloom.operators import similar


def plain_rules(a, b):
    x, y = a.lower().strip(" "), b.lower().strip(" ")
    if not x or not y:
        return False
    wx, wy = x.split(), y.split()
    common = len(set(wx) & set(wy))
    return (
        x in y or y in x or set(wx) == set(wy) or (common >= 2 and common / max(len(wx), len(wy)) >= 0.5) or all(w in x and w in y for w in ("cancer", "syndrome")) or SequenceMatcher(None, x, y).ratio() >= 0.7
    )


@pytest.fixture(scope="module")
def names():
    rnd = random.Random(7)
    words = "breast cancer syndrome lung hereditary type ii familial alveolar capillary dysplasia of x tumor a p53 ab".split()
    out = {" ".join(rnd.choices(words, k=rnd.randint(1, 5))) for _ in range(90)}
    for n in sorted(out)[:60]:
        i = rnd.randrange(len(n))
        out.add(n[:i] + rnd.choice(["", "é", "z", n[i].upper()]) + n[i + 1 :])
    out |= {"".join(rnd.choices("abcdeé", k=rnd.randint(1, 12))) for _ in range(60)} | {"", " ", "A", "a a", "p53 tumor tumor", " lung ", "\U0001f600x", "x" * 250, "x" * 260 + "y"}
    return sorted(out)


def test_pairs_equal_all_pairs(spark, names):
    df = spark.createDataFrame([(n,) for n in [*names, None, *names[:20]]], "a string")
    left, right = df.where("a IS NULL OR crc32(a) % 2 = 0"), df.withColumnRenamed("a", "b")
    own = [n for n in names if n in {r["a"] for r in left.collect()}]
    for least in (0.7, 0.9):
        got = {(r["a"], r["b"]): r["ratio"] for r in similar.similar(left, right, least).collect()}
        want = {(a, b): r for a in own for b in names if a and b and (r := SequenceMatcher(None, a.lower(), b.lower()).ratio()) >= least}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
    met = similar.candidates(left, right)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "CartesianProduct" not in plan
    assert met.count() < 0.25 * len(own) * len(names)  # pairs that matching blocks are looked for in
    rules = similar.similar_by_rules(left, right)
    assert sorted(map(tuple, rules.collect())) == sorted((a, b) for a in own for b in names if plain_rules(a, b))
    assert similar.similar_by_rules(left.limit(0), right).count() == 0


def test_rows_equal_plain_rules_and_the_bound_is_one(spark, names):
    rnd = random.Random(8)
    pairs = [(rnd.choice(names), rnd.choice(names)) for _ in range(3000)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", S.text_similar_rules("a", "b").alias("y"), S.ratio_bound("a", "b").alias("most")).collect():
        assert r["y"] == plain_rules(r["a"], r["b"]), (r["a"], r["b"])
        if r["a"] and r["b"]:
            assert r["most"] >= SequenceMatcher(None, r["a"].lower(), r["b"].lower()).ratio() - 1e-9
    one = spark.createDataFrame([("Lynch syndrome and cancer", "hereditary cancer-predisposing syndrome")], "a string, b string")
    assert one.select(S.text_similar_rules("a", "b")).first()[0] and not one.select(S.text_similar("a", "b")).first()[0]
    assert df.where(F.lit(False)).select(S.text_similar("a", "b")).count() == 0
