"""Names of a dictionary in texts: spans by longest match, without regard to case, at the borders of words.

A dictionary of up to ``MOST`` bytes is broadcast and every worker makes one automaton of it, which finds all names in one pass over a text. A larger
one is joined: every word of a text that some name begins with meets these names, and those that go on like the text are candidates; so neither the
dictionary nor a text's candidates have to fit anywhere but in the shuffle. Both then choose alike: from left to right the longest
name, and what overlaps a chosen one goes.

Cases: null text and null or blank names have no spans; names are trimmed, and of a name given twice the least kind holds; a name begins and ends
with a letter, digit or underscore, or it is left out; letters whose lower case is longer are taken as they are; repeated rows get equal spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,name:string,kind:string>>"
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("kind", pa.string())]))
#: Bytes of names that are broadcast.
MOST = 32 << 20
#: Texts that a task turns into Python's strings, with their spans, together.
AT_A_TIME = 64
WORD = re.compile(r"\w+")


def _low(text: str) -> str:
    """Lower case of the same length, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _at_border(text: str, a: int, b: int) -> bool:
    return (a == 0 or not _is_word(text[a - 1])) and (b == len(text) or not _is_word(text[b]))


def _is_word(c: str) -> bool:
    return c == "_" or c.isalnum()


def chosen(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """From left to right the longest, without overlaps."""
    out, at = [], 0
    for a, b, kind in sorted(set(found), key=lambda x: (x[0], -x[1])):
        if a >= at:
            out.append((a, b, kind))
            at = b
    return out


def names_of(names: DataFrame) -> DataFrame:
    """name (trimmed, lower case), kind, first (its first word) of the names that can be found."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            low = [_low(n.strip()) if n else "" for n in pdf["name"]]
            ok = [bool(n) and _is_word(n[0]) and _is_word(n[-1]) for n in low]
            rows = pd.DataFrame({"name": low, "kind": pdf["kind"]})[ok]
            if len(rows):
                yield rows.assign(first=[WORD.match(n)[0] for n in rows["name"]])

    return names.select("name", F.col("kind").cast("string").alias("kind")).mapInPandas(run, "name string, kind string, first string").groupBy("name", "first").agg(F.min("kind").alias("kind"))


def _spans(text: str, found: list[tuple[int, int, str]]) -> list[dict]:
    return [{"start": a, "end": b, "name": text[a:b], "kind": kind} for a, b, kind in chosen(found)]


def _scanned(part: pa.RecordBatch, place: int, machine) -> Iterator[pa.RecordBatch]:
    """The rows with their spans. Few texts at a time are Python's; the columns pass on as they came, without a copy."""
    for at in range(0, part.num_rows, AT_A_TIME):
        some, out = part.slice(at, AT_A_TIME), []
        for text in some.column(place):
            text = text.as_py() or ""
            low = _low(text)
            ends = machine.iter(low) if len(machine) else ()
            out.append(_spans(text, [(e + 1 - n, e + 1, kind) for e, (n, kind) in ends if _at_border(low, e + 1 - n, e + 1)]))
        yield pa.RecordBatch.from_arrays([*some.columns, pa.array(out, SPAN_TYPE)], names=[*some.schema.names, "spans"])


def recognised(texts: DataFrame, names: DataFrame, most: int = MOST) -> DataFrame:
    """``texts`` (with a column text) and ``spans``: start, end (code points), name as it stands in the text, kind. ``names``: name, kind."""
    known = names_of(names)
    size = known.agg(F.sum(F.octet_length("name") + F.coalesce(F.octet_length("kind"), F.lit(0)) + 16)).first()[0] or 0
    rest = [f for f in texts.schema if f.name != "spans"]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), f"spans {SPANS}"])
    texts = texts.select(*[f.name for f in rest])
    if size <= most:
        place = texts.columns.index("text")
        held = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in known.select("name", "kind").collect()])

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for name, kind in held.value:
                machine.add_word(name, (len(name), kind))
            if len(machine):
                machine.make_automaton()
            for part in batches:
                yield from _scanned(part, place, machine)

        return texts.mapInArrow(scan, ddl)

    rows = texts.withColumn("_row", F.xxhash64("text")).select("_row", "text").where("text <> ''").dropDuplicates(["text"])

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row, text in pdf[["_row", "text"]].itertuples(index=False):
                at: dict[str, list[int]] = {}
                for m in WORD.finditer(_low(text)):
                    at.setdefault(m[0], []).append(m.start())
                if at:
                    yield pd.DataFrame({"_row": row, "first": list(at), "at": pd.Series(list(at.values()), dtype=object)})

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, found in pdf[["text", "_names"]].itertuples(index=False):
                low = _low(text)
                ok = [(a, a + len(x["name"]), x["kind"]) for x in found for a in x["at"] if low.startswith(x["name"], a) and _at_border(low, a, a + len(x["name"]))]
                out.append(_spans(text, ok))
            yield pd.DataFrame({"_t": pdf["text"], "spans": out})

    met = rows.mapInPandas(words, "_row long, first string, at array<int>").join(known, "first")
    each = met.groupBy("_row").agg(F.collect_list(F.struct("name", "kind", "at")).alias("_names"))  # of one text
    got = rows.join(each, "_row").select("text", "_names").mapInPandas(verified, f"_t string, spans {SPANS}")
    return texts.join(got, F.col("text") == F.col("_t"), "left").select(*[f.name for f in rest], F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))
