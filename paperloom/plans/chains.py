"""Chains of model calls: relationships of pairs, and coordinates to ontology terms. Models stand behind protocols."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import llm_json as J
from paperloom.functions import text as T
from paperloom.operators import prompt_cache, vectors
from paperloom.plans.scoring import Embedder, HashEmbedder, embedded

PROMPT = "Variant: {variant}\nEntities: {entities}\nPassage: {passage}"


class Model(Protocol):
    def complete(self, prompt: str) -> str:
        """The answer to a prompt."""


class PassageModel:
    """Answers in JSON, with a trailing comma: a name in the passage beside the variant scores 10, any other 0."""

    def complete(self, prompt: str) -> str:
        variant, entities, passage = (line.split(": ", 1)[1] if ": " in line else "" for line in prompt.split("\n", 2))
        said = variant in passage
        rows = [f'{{"entity_text": "{e}", "relationship_score": {10 if said and e in passage else 0}, "has_relationship": {str(said and e in passage).lower()}}}' for e in entities.split("|")]
        return 'Answer: {"relationships": [' + ", ".join(rows) + ",]}"


def completed(df: DataFrame, prompt: str = "prompt", make: Callable[[], Model] = PassageModel) -> DataFrame:
    """Adds ``answer``; one model for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            yield pdf.assign(answer=[model.complete(p) for p in pdf[prompt].fillna("")])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{ddl}, answer string")


def related(pairs: DataFrame, keys: list[str], make: Callable[[], Model] = PassageModel, least: int = 6, cache: str | None = None) -> DataFrame:
    """Accepted relationships of (keys, variant, entity, passage): one prompt for each variant of a passage, asked once for equal
    prompts; its answer is repaired and parsed, and what the model accepts with ``least`` or more is merged back with the pairs.
    With ``cache``, the folder of a prompt cache, only prompts that no run before has asked go to the model."""
    asked = pairs.groupBy(*keys, "variant", "passage").agg(F.array_sort(F.collect_set("entity")).alias("entities"))
    prompt = F.concat(F.lit("Variant: "), "variant", F.lit("\nEntities: "), F.array_join("entities", "|"), F.lit("\nPassage: "), "passage")
    asked = asked.withColumn("prompt", prompt).drop("entities", "passage")
    prompts, complete = asked.select("prompt").distinct(), lambda df: completed(df, make=make)
    answers = (prompt_cache.answered(prompts, cache, complete, make.__name__) if cache else complete(prompts)).select("prompt", F.explode(J.relationships(F.col("answer"))).alias("r"))
    told = asked.join(answers, "prompt").select(*keys, "variant", F.col("r.entity_text").alias("entity"), F.col("r.relationship_score").cast("int").alias("score"), F.col("r.has_relationship").alias("ok"))
    told = told.where(F.col("ok") & (F.col("score") >= least)).dropDuplicates([*keys, "variant", "entity"]).drop("ok")
    return pairs.join(told, [*keys, "variant", "entity"])


def inferred(texts: DataFrame, terms: DataFrame, make: Callable[[], Embedder] = HashEmbedder, around: int = 60, near: int = 5) -> DataFrame:
    """doc_id, coordinate, context, term_id, rank: the ontology terms nearest to the text around each coordinate of a text.

    ``texts``: doc_id, text. ``terms``: id, text. Each distinct context is embedded once.
    """
    each = texts.select("doc_id", "text", F.explode(F.array_distinct(T.found(F.col("text"), T.COORDINATES))).alias("coordinate"))
    at = F.expr("locate(coordinate, text)")
    each = each.select("doc_id", "coordinate", F.substring("text", F.greatest(F.lit(1), at - around), F.length("coordinate") + 2 * around).alias("context"))
    contexts = each.select(F.col("context").alias("text")).distinct().withColumn("query_id", F.xxhash64("text"))
    queries = embedded(contexts, make).select("query_id", "embedding")
    names = terms.select(F.xxhash64("id").alias("vec_id"), F.col("id").alias("term_id"), "text")
    known = embedded(names.select("vec_id", "text"), make).select("vec_id", "embedding")
    hits = vectors.nearest(known, queries, near, "cosine").select("query_id", "vec_id", "rank").join(names.select("vec_id", "term_id"), "vec_id").drop("vec_id")
    return each.withColumn("query_id", F.xxhash64("context")).join(hits, "query_id").drop("query_id")


def linked(rows: DataFrame, keys: list[str], test: str) -> DataFrame:
    """For each key whether all its links hold, and the least rank at which one does: (keys, every, first), null if none does."""
    return rows.groupBy(*keys).agg(F.bool_and(test).alias("every"), F.min(F.when(F.col(test), F.col("rank"))).alias("first"))
