"""Spans of names against a plain search, by the automaton and by the join."""

import random

import ahocorasick
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.operators import recogniser


def plain(text, names):
    low, out, at = text.lower(), [], 0
    border = lambda i: not (0 < i < len(low) and (low[i - 1] == "_" or low[i - 1].isalnum()) and (low[i] == "_" or low[i].isalnum()))
    while at < len(low):
        fits = [n for n in names if low.startswith(n, at) and border(at) and border(at + len(n))]
        if fits:
            n = max(fits, key=len)
            out.append((at, at + len(n), text[at : at + len(n)], names[n]))
            at += len(n)
        else:
            at += 1
    return out


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_spans_equal_plain_search(spark, most):
    rnd = random.Random(3)
    words = ["lung", "lung development", "development", "p53", "p53-like", "IL-2", "il", "a_b", "é", "éclair", "2", "foxf1", "lung development disorder", "x y z", "y z"]
    names = [(w.upper() if rnd.random() < 0.5 else f" {w} ", rnd.choice(["gene", "disease"])) for w in words] + [("lung", "a"), (None, "gene"), (" ", "gene"), ("-x", "gene"), ("x.", "gene"), ("y z", None)]
    known = {}
    for n, kind in names:
        low = (n or "").strip().lower()
        if low and (low[0] == "_" or low[0].isalnum()) and (low[-1] == "_" or low[-1].isalnum()):
            known[low] = min((k for k in (known.get(low), kind) if k), default=None)
    texts = ["".join(rnd.choice([*words, " ", " ", "-", ".", "Lung", "x", "_", "\n", "É"]) for _ in range(rnd.randint(0, 60))) for _ in range(150)]
    rows = [*enumerate(texts), (900, None), (901, ""), (902, texts[0]), (None, texts[1]), (903, "İ lung İl-2")]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("spans", F.lit(1))
    got = {r["id"]: [tuple(s) for s in r["spans"]] for r in recogniser.recognised(df, spark.createDataFrame(names, "name string, kind string"), most).collect()}
    want = {i: plain(t or "", known) for i, t in rows if i != 903}
    assert {i: s for i, s in got.items() if i != 903} == want
    assert [s[:3] for s in got[903]] == [(2, 6, "lung"), (10, 11, "2")]
    assert recogniser.recognised(df.limit(0), spark.createDataFrame(names, "name string, kind string"), most).count() == 0
    none = recogniser.recognised(df, spark.createDataFrame([], "name string, kind string"), most)
    assert none.count() == len(rows) and none.where("size(spans) > 0").count() == 0


def test_few_texts_at_a_time_are_turned_into_strings():
    machine = ahocorasick.Automaton()
    machine.add_word("lung", (4, "part"))
    machine.make_automaton()
    part = pa.RecordBatch.from_pydict({"id": list(range(200)), "text": [f"lung {i}" if i % 2 else None for i in range(200)]})
    got = list(recogniser._scanned(part, 1, machine))
    assert len(got) > 2 and all(b.num_rows <= recogniser.AT_A_TIME for b in got)
    assert {b.column(1).buffers()[2].address for b in got} == {part.column(1).buffers()[2].address}  # not copied
    whole = pa.Table.from_batches(got).to_pydict()
    assert whole["id"] == list(range(200)) and [len(s) for s in whole["spans"]] == [i % 2 for i in range(200)]
