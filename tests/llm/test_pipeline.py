"""The near-duplicate stage where doc_ids are null or repeated."""

import random

import corpus_pipeline


def test_near_duplicates_with_null_and_repeated_ids(spark):
    rnd = random.Random(9)
    a, b, c, d, e, f = (" ".join(f"{rnd.choice('abcdefgh')}{rnd.randrange(5000)}" for _ in range(80)) for _ in range(6))
    rows = [(1, a), (5, a), (5, b), (None, c), (None, d), (None, a), (None, d), (7, e), (7, f), (8, "hi"), (8, "hi"), (9, "hi"), (None, None), (None, "ho")]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    key = lambda r: (r[0] or 0, r[1] or "")
    want = [(1, a), (5, b), (None, c), (None, d), (7, e), (7, f), (8, "hi"), (None, None), (None, "ho")]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
