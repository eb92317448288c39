"""The audit against plain filters run in every order, and the scan against regular expressions."""

import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.llm import filter_audit
from paperloom.llm.queries import FILTERS


def plain(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    return [len(words), len(set(words)), len(re.findall("[A-Z]", t)), len(re.findall(r"[#$%&*|]", t)), len(t)]


def made(n, seed, long=False):
    rnd = random.Random(seed)
    pieces = ["a", "b", "A ", "é", "  ", "\n", "x y", "#", "\x85", "　", "zz ", "\x1f", "\x00", "😀", " wörd"]
    sizes = [0, 1, 5, 300, 3000 if long else 400]
    return ["".join(rnd.choice(pieces) for _ in range(rnd.choice(sizes))) for _ in range(n)] + [None, "", " ", "x" * 5000, "ab " * 3000]


@pytest.mark.parametrize("size", [16, 1 << 10, 1 << 20])
def test_scan_of_buffers(monkeypatch, size):
    monkeypatch.setattr(filter_audit, "SLICE", size)
    texts = made(200, 3, True)
    for kind in (pa.string(), pa.large_string()):
        for array, own in ((pa.array(texts, kind), texts), (pa.array(texts, kind)[7:90], texts[7:90]), (pa.array([], kind), [])):
            counts, keys = filter_audit.measured(array)
            assert counts.tolist() == [plain(t) for t in own]
            assert len(set(keys)) == len({t or "" for t in own})


def test_words_with_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(filter_audit, "BASE", 1)  # the hash of a word is then the sum of its bytes
    monkeypatch.setattr(filter_audit, "POWERS", filter_audit.Powers())
    monkeypatch.setattr(filter_audit, "PART", 0)
    texts = ["ab ba ab ac bb ca", "ab ba", "", "ba", "abc cba bca abc " * 50]
    counts, _ = filter_audit.measured(pa.array(texts))
    assert counts.tolist() == [plain(t) for t in texts]


def test_audit_equals_every_order_of_plain_filters(spark):
    rnd = random.Random(8)
    texts = [t if t is None or rnd.random() < 0.4 else " ".join(f"{rnd.choice('abcDE')}{rnd.randrange(900)}" for _ in range(rnd.choice([30, 210, 400]))) + rnd.choice(["", "#"]) for t in made(90, 4)]
    texts += rnd.choices(texts, k=80)
    docs = [(rnd.choice([i, i, i, None, 7]), t, rnd.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    docs += docs[:9]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in rnd.choices([*range(170), None], k=150)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"n": F.lit(1), "n_words": F.lit("x"), "part": F.lit(2), "mask": F.lit(3)})
    fails = {name: F.expr(rule) for name, rule in FILTERS.items()}
    counts = filter_audit.masks(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), fails, duplicates="E")
    got = {(r["part"], r["filter_order"], r["step"]): r[3:] for r in filter_audit.audit(counts, "ABCDE").collect()}

    def failing(doc_id, text):
        w, d, c, s, n = plain(text)
        twin = doc_id is not None and any(i is not None and i < doc_id and (t or "") == (text or "") for i, t, _ in docs)
        return {x for x, bad in zip("ABCDE", (w < 200, 100 * d < 50 * w, 100 * c > 3 * n, s > 0, twin), strict=True) if bad}

    rows = [(p or "", failing(i, t), *(i is not None and any(x[0] == i and x[k] == 1 for x in labels) for k in (1, 2))) for i, t, p in docs]
    want, first = {}, {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                out = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                count = lambda rule: sum(map(rule, own))
                want[part, order, step] = [len(left), len(out), count(lambda r: f in r[1]) - len(out), count(lambda r: r[1] == {f}), sum(r[2] for r in out), sum(r[3] for r in out)]
                first[part, f] = first.get((part, f), 0) + len(out)
    assert got == {(p, o, s): (*v, first[p, o[s - 1]]) for (p, o, s), v in want.items()}
    none = filter_audit.masks(df.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), fails, duplicates="E")
    assert filter_audit.audit(none, "ABCDE").count() == 0


def test_powers_are_inverse():
    up, down = filter_audit.Powers().upto(1000)
    assert np.all(up * down == 1)
