"""Texts split into pieces of a size by the coarsest separator that does: blank lines, lines, words, then single code points.

A piece that is too long for its separator goes on with the next one. Pieces that stand side by side are merged up to the size, and each
merged piece begins with as much of the end of the one before as ``overlap`` allows. Separators stay at the head of what follows them; white space
around a piece goes, and empty pieces with it. Work and memory are linear in a text, which has to fit into a task as any string does.

Cases: null and blank texts have no pieces; one word longer than the size is cut; repeated rows are each split.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

SEPARATORS = ("\n\n", "\n", " ", "")
#: Code points of pieces that a task gives back at a time.
TOGETHER = 4_000_000


def _cut(text: str, separator: str) -> list[str]:
    """The text's parts, each but the first beginning with the separator."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in (first, *(separator + r for r in rest)) if p]


def _merged(parts: list[str], size: int, overlap: int, length: Callable[[str], int]) -> Iterator[str]:
    held: deque[tuple[str, int]] = deque()
    total = 0
    for part in parts:
        n = length(part)
        if held and total + n > size:
            yield "".join(p for p, _ in held)
            while held and (total > overlap or total + n > size):
                total -= held.popleft()[1]
        held.append((part, n))
        total += n
    if held:
        yield "".join(p for p, _ in held)


def split(text: str, size: int, overlap: int = 0, separators: tuple[str, ...] = SEPARATORS, length: Callable[[str], int] = len) -> list[str]:
    """The pieces; none is longer than ``size`` if ``separators`` end with the empty one and lengths of parts add up."""
    found = next(i for i, s in enumerate(separators) if not s or s in text or i == len(separators) - 1)
    out, small = [], []
    for part in _cut(text, separators[found]):
        if length(part) <= size:
            small.append(part)
            continue
        out += _merged(small, size, overlap, length)
        small = []
        out += split(part, size, overlap, separators[found + 1 :], length) if found + 1 < len(separators) else [part]
    out += _merged(small, size, overlap, length)
    return [p for p in (x.strip() for x in out) if p]


def words(text: str) -> int:
    return len(text.split())


def pieces(df: DataFrame, size: int, overlap: int = 0, text: str = "text", length: Callable[[str], int] = len) -> DataFrame:
    """The further columns, ``piece`` (0, 1, ...) and the piece's text, for each piece; no shuffle."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap is less than the size")
    rest = [f for f in df.schema if f.name not in (text, "piece")]
    names = [f.name for f in rest]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            others, at, nth, found, held = pdf[names], [], [], [], 0

            def rows():
                return others.iloc[at].reset_index(drop=True).assign(piece=nth, **{text: found})

            for i, whole in enumerate(pdf[text]):
                own = split(whole, size, overlap, SEPARATORS, length) if whole else []
                at += [i] * len(own)
                nth += range(len(own))
                found += own
                held += sum(map(len, own))
                if held > TOGETHER:
                    yield rows()
                    at, nth, found, held = [], [], [], 0
            if found:
                yield rows()

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "piece int", f"`{text}` string"])
    return df.select(*names, text).mapInPandas(run, ddl)
