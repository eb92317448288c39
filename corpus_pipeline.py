"""The corpus pipeline: quality rules, near-duplicate join, decontamination, mixing and sharding.

Each stage works on all that the stage before kept, written as Parquet and read again. A stage deletes its own intermediate tables
before it returns, but for small ones that its result still reads, and ``run`` deletes a stage's table once the next one's is written.

Cases: null text is empty: it has no words and fails the first stage's base rule; a null doc_id is a key like any other; of equal rows
one stays, and of one doc_id with several texts each text that no other row is near to; empty texts and texts without words go in
the first stage; very long texts are taken whole; without labels only the base rule counts, and without benchmark items nothing is
contaminated; empty documents give no rows; further columns stay up to the last stage, and names beginning with ``_`` are reserved.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import decontaminate, mixing, ngram_join, quality, sharding
from paperloom.llm.common import removed, scratch, swept, table, written
from paperloom.llm.queries import LEARNING, MIX, SHARDS, domain

#: No document twice: one epoch of every source at most.
ONCE = replace(MIX, max_epochs=1)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a learned rule go."""
    with scratch(spark):
        rules = quality.learn(docs, table(spark, sf_dir, "labels"), LEARNING)
    return quality.apply(docs, rules).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links connect, the row of the least doc_id stays, one without doc_id if there are no others; of
    repeated rows one. A row is known by its doc_id, which can be null or repeated, and a hash of its text."""
    mark = F.xxhash64(F.col("text").isNull(), "text")
    with scratch(spark):
        found = ngram_join.join(docs, mark=mark)
        short = F.col("n_shingles") == 0  # no links; equal rows are repeated ones
        group = [F.when(~short, F.col("root")).alias("_group"), F.when(short, F.col("doc_id")).alias("_id"), F.when(short, F.col("mark")).alias("_text")]
        rows = found.groupBy(*group, "doc_id", "mark").agg(F.count("*").alias("times"))
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "times")).alias("least")
        kept = written(rows.groupBy("_group", "_id", "_text").agg(least).selectExpr("least.doc_id AS _id", "least.mark AS _mark", "least.times > 1 AS _often"), "kept", lasting=True)
    same = F.expr("d.doc_id <=> k._id AND d._mark = k._mark")
    marked = docs.withColumn("_mark", mark).alias("d").join(kept.alias("k"), same).select("d.*", "_often")
    once, often = (marked.where(x).drop("_often") for x in ("NOT _often", "_often"))
    return once.unionByName(often.dropDuplicates(["doc_id", "_mark"])).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source gives what its share of the token budget holds."""
    return mixing.mix(docs, ONCE, domain()).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes."""
    got = sharding.shard(docs.select("doc_id", "text"), SHARDS, seed=11)
    return got.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source mixing", source_mixing),
    ("sharding", shards),
]
#: Near-duplicate components and learned rules have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:  # nothing reads the table before last any more
            removed(before)
        before = docs
        swept(spark)
    return docs
