"""Model calls behind small protocols: pairs go to a scorer batch by batch, texts to an embedder; the defaults need no network."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Scorer(Protocol):
    def score(self, variant: str, entity: str, passage: str) -> tuple[bool, int, str]:
        """(has a relationship, 0 to 10, why)."""


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray:
        """One row for each text."""


class PassageScorer:
    """Scores a pair by whether both names stand in the passage."""

    def score(self, variant: str, entity: str, passage: str) -> tuple[bool, int, str]:
        n = (variant.lower() in passage.lower()) + (entity.lower() in passage.lower())
        return n == 2, 5 * n, f"{n} of 2 names in the passage"


class HashEmbedder:
    """Unit vectors of hashed words; equal texts have equal vectors."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                out[i, int.from_bytes(h[:4], "big") % self.size] += 1 if h[4] & 1 else -1
        return out / np.maximum(1e-12, np.linalg.norm(out, axis=1, keepdims=True))


def scored(pairs: DataFrame, make: Callable[[], Scorer] = PassageScorer) -> DataFrame:
    """Pairs (variant, entity, passage) with has_relationship, relationship_score and explanation; one scorer for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for pdf in batches:
            got = [scorer.score(*x) for x in pdf[["variant", "entity", "passage"]].fillna("").itertuples(index=False)]
            yield pdf.assign(has_relationship=[g[0] for g in got], relationship_score=[g[1] for g in got], explanation=[g[2] for g in got])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInPandas(run, f"{ddl}, has_relationship boolean, relationship_score int, explanation string")


def embedded(texts: DataFrame, make: Callable[[], Embedder] = HashEmbedder) -> DataFrame:
    """(id, text) with ``embedding``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            yield pdf.assign(embedding=list(model.embed(pdf["text"].fillna("").tolist())))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    return texts.mapInPandas(run, f"{ddl}, embedding array<double>")
