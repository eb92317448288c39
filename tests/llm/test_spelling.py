"""Variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paperloom.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs, least, count, ratio, slip):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if slip and h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= count}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: b if b is not None and n[b] >= ratio * n[w] else None for w, b in best.items()}
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


@pytest.mark.parametrize("alphabet", ["ab", "abcdeé", "aàÿÀAß×"])
@pytest.mark.parametrize("leaves_open", [1, 2, 5])
def test_variants_equal_all_pairs(spark, monkeypatch, alphabet, leaves_open):
    monkeypatch.setattr(spelling, "OPEN", leaves_open)
    rnd = random.Random(len(alphabet))
    stems = ["".join(rnd.choices(alphabet, k=rnd.choice([3, 5, 5, 6, 7, 8, 9, 16, 17, 40]))) for _ in range(60)]

    def word():
        w = rnd.choice(stems)
        for _ in range(rnd.choice([0, 0, 0, 0, 1, 1, 2])):
            i = rnd.randrange(len(w) + 1)
            w = w[:i] + rnd.choice(["", rnd.choice(alphabet)]) + w[i + rnd.choice([0, 1]) :]
        return w

    docs = [(rnd.choice([i, None, 3]), rnd.choice([" ", "1", "_", "Œ", "\n"]).join(word() for _ in range(rnd.randint(0, 120)))) for i in range(60)]
    docs += [(None, None), (1, ""), (2, "a" * 3000), *docs[:20]]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit("x"), "run": F.lit(2)})
    got = {r["word"]: tuple(r)[1:] for r in spelling.grouped(df, 5, 2, 2, spelling.slipped).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == plain(docs, 5, 2, 2, True)
    assert any(x[0] for x in got.values())


def test_long_way_to_the_root_and_odd_tables(spark):
    words = ["b" * i + "a" * (12 - i) for i in range(8)]
    docs = [(i, f" {w}" * 2**i) for i, w in enumerate(words)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["word"]: r["root"] for r in spelling.grouped(df, count=1).collect()}
    assert got == dict.fromkeys(words, words[-1])
    assert spelling.grouped(df.limit(0)).count() == 0
    assert spelling.grouped(df.select("doc_id", F.lit("one two").alias("text"))).count() == 0
