"""The cache as a stream's state against a plain replay, over batches and restarts."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from paperloom.operators import cache
from paperloom.streaming import cache_state

SCHEMA = "key string, number long, at timestamp, value double"


def plain(rows, ttl):
    held, out = {}, {}
    for key, number, at, value in sorted(rows, key=lambda r: (r[2], r[1])):
        hit = key in held and at < held[key][0] + timedelta(seconds=ttl)
        if not hit:
            held[key] = (at, value)
        out[number] = ("hit" if hit else "miss", held[key][1])
    return out, held


def test_hits_expiry_and_replacement_over_restarts(spark, tmp_path):
    rnd, start, ttl = random.Random(3), datetime(2024, 1, 1), 3600
    rows = [(rnd.choice(["a", "b", None, "rare" if i % 40 == 0 else "c"]), i, start + timedelta(seconds=200 * i + rnd.randrange(100)), rnd.choice([None, float(i)])) for i in range(300)]
    want, held = plain(rows, ttl)
    source, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")
    for part in range(3):  # three runs, each goes on from the state before
        spark.createDataFrame([*rows[part * 100 : part * 100 + 100], *([("a", 999, None, 1.0)] if part == 1 else [])], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        requests = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        cache_state.started(spark, requests, out, checkpoint, ttl, "1 minute").awaitTermination()
    got = spark.read.schema(cache_state.ANSWER).parquet(out)
    assert {r["number"]: (r["state"], r["value"]) for r in got.collect()} == want and got.count() == len(rows)
    misses = got.where("state = 'miss'").select("key", "number", "at", "value")
    last = cache.latest(misses.withColumn("key", F.coalesce("key", F.lit("?"))), "key", "at", "number", "value")
    now = start + timedelta(seconds=200 * 300)
    valid = {r["key"] for r in cache.unexpired(last, "at", ttl, F.lit(now)).collect()}
    assert valid == {k or "?" for k, (at, _) in held.items() if at + timedelta(seconds=ttl) > now} and 0 < len(valid) < len(held)
