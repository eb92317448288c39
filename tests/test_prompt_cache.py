"""The prompt cache over runs: what is asked, what is replaced, what a compaction leaves."""

import glob
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from paperloom.operators import prompt_cache as P


class Asked:
    """A model over tables that remembers its prompts and numbers its runs."""

    def __init__(self):
        self.prompts, self.runs = [], 0

    def __call__(self, df):
        self.runs += 1
        rows = [r["prompt"] for r in df.select("prompt").collect()]
        self.prompts += rows
        return df.withColumn("answer", F.when(F.col("prompt") != "mute", F.concat(F.lit(f"{self.runs}:"), "prompt")))


def run(spark, path, model, prompts, **more):
    got = P.answered(spark.createDataFrame([(p, 1) for p in prompts], "prompt string, key int"), path, model, "m", **more)
    return {r["prompt"]: (r["answer"], r["source"]) for r in got.collect()}


def test_a_prompt_is_asked_once(spark, tmp_path):
    path, model = f"file://{tmp_path}/cache", Asked()
    assert run(spark, path, model, ["a", "b", "b", None]) == {"a": ("1:a", "model"), "b": ("1:b", "model"), "": ("1:", "model")}
    assert run(spark, path, model, ["b", "c", "mute"]) == {"b": ("1:b", "cache"), "c": ("2:c", "model"), "mute": (None, "model")}
    assert P.compacted(spark, path) == 1 and P.version(spark, path) == 1
    assert sorted(n for n in os.listdir(tmp_path / "cache") if not n.startswith(".")) == ["base-1", "current-1"]
    model.prompts.clear()
    assert run(spark, path, model, ["a", "b", "c", "", "mute"])["c"] == ("2:c", "cache")
    assert model.prompts == ["mute"]
    assert P.compacted(spark, path) == 2 and P.entries(spark, path).count() == 4


def test_corrupt_entries_are_misses_and_are_replaced(spark, tmp_path):
    path, model = f"file://{tmp_path}/cache", Asked()
    run(spark, path, model, ["a"])
    bad = spark.createDataFrame([(None, "forged", "no checksum", datetime(2999, 1, 1))], P.ENTRY).withColumn("key", P.key_of("m", F.lit("b")))
    bad.write.parquet(f"{path}/add-0-bad")
    for f in glob.glob(f"{tmp_path}/cache/add-0-*/part-*.parquet"):
        if "add-0-bad" not in f:
            with open(f, "wb") as out:
                out.write(b"broken")
    assert run(spark, path, model, ["a", "b"]) == {"a": ("2:a", "model"), "b": ("2:b", "model")}
    P.compacted(spark, path)
    assert run(spark, path, model, ["a", "b"]) == {"a": ("2:a", "cache"), "b": ("2:b", "cache")}


def test_old_entries_and_failing_models(spark, tmp_path):
    path, model = f"file://{tmp_path}/cache", Asked()
    at = lambda s: F.lit(datetime(2024, 1, 1, 0, 0, s))
    run(spark, path, model, ["a"], now=at(0))
    assert run(spark, path, model, ["a"], now=at(9), ttl=10)["a"] == ("1:a", "cache")
    assert run(spark, path, model, ["a"], now=at(10), ttl=10)["a"] == ("3:a", "model")
    assert P.entries(spark, path).first()["answer"] == "3:a"

    def fails(df):
        return df.withColumn("answer", F.raise_error(F.lit("no model")).cast("string"))

    with pytest.raises(Exception, match="no model"):
        run(spark, path, fails, ["z"])
    assert run(spark, path, model, ["z"])["z"][1] == "model"


def test_a_compaction_that_meets_another_writer(spark, tmp_path, monkeypatch):
    path, model = f"file://{tmp_path}/cache", Asked()
    run(spark, path, model, ["a"])
    create = P.folders.create

    def between(s, p):
        monkeypatch.setattr(P.folders, "create", create)
        run(spark, path, model, ["late"])  # added to the version that goes
        return create(s, p)

    monkeypatch.setattr(P.folders, "create", between)
    P.compacted(spark, path)
    assert {k: v[1] for k, v in run(spark, path, model, ["a", "late"]).items()} == {"a": "cache", "late": "cache"}


def test_the_order_of_settings_does_not_matter(spark):
    row = spark.range(1).select(
        P.key_of("m", F.lit("p"), F.create_map(F.lit("t"), F.lit("0"), F.lit("n"), F.lit("5"))).alias("a"), P.key_of("m", F.lit("p"), F.create_map(F.lit("n"), F.lit("5"), F.lit("t"), F.lit("0"))).alias("b"),
        P.key_of("m", F.lit("p"), F.create_map(F.lit("n"), F.lit("6"), F.lit("t"), F.lit("0"))).alias("c"), P.key_of("m", F.lit("p")).alias("d"), P.key_of("m2", F.lit("p")).alias("e"),
    ).first()
    assert row["a"] == row["b"] and len({row["a"], row["c"], row["d"], row["e"]}) == 4
