"""Repair and reading of JSON in model answers, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import bind

SCHEMA = "relationships ARRAY<STRUCT<entity_type: STRING, entity_text: STRING, entity_id: STRING, has_relationship: BOOLEAN, relationship_score: INT, explanation: STRING>>"


def sliced(c: Column) -> Column:
    """From the first opening to the last closing brace; ``{}`` if there are none."""
    got = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)(\{.*\})", 1)
    return F.when(got == "", F.lit("{}")).otherwise(got)


def fenced(c: Column) -> Column:
    """The first fenced block, else the outermost braces, else the answer."""
    block = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.nullif(block, F.lit("")), F.nullif(braces, F.lit("")), c)


def no_trailing_commas(c: Column) -> Column:
    return F.regexp_replace(c, r",(\s*[}\]])", "$1")


def missing_commas(c: Column) -> Column:
    return F.regexp_replace(c, r'(["}\d])\s+(")', "$1, $2")


def quoted_keys(c: Column) -> Column:
    return F.regexp_replace(c, r"([{,])\s*([a-zA-Z0-9_]+)\s*:", '$1 "$2":')


def double_quotes(c: Column) -> Column:
    """Single quotes outside of double-quoted strings become double ones: the even pieces between double quotes are outside."""
    return F.array_join(F.transform(F.split(c, '"', -1), lambda x, i: F.when(i % 2 == 0, F.replace(x, F.lit("'"), F.lit('"'))).otherwise(x)), '"')


def valid(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def repaired(c: Column, cumulative_empty: bool = False) -> Column:
    """The answer's JSON: as it is, or after the four repairs if they make it valid; else as it was, or with
    ``cumulative_empty`` an empty list of relationships. In that mode the first valid state of another order of repairs wins."""
    if not cumulative_empty:
        fixed = lambda s: double_quotes(quoted_keys(missing_commas(no_trailing_commas(s))))
        return bind(sliced(c), lambda s: F.when(valid(s), s).otherwise(bind(fixed(s), lambda x: F.when(valid(x), x).otherwise(s))))

    def next_state(s: Column, fixes: list) -> Column:
        rest = F.lit('{"relationships": []}') if not fixes else bind(fixes[0](s), lambda x: next_state(x, fixes[1:]))
        return F.when(valid(s), s).otherwise(rest)

    return bind(sliced(c), lambda s: next_state(s, [double_quotes, no_trailing_commas, missing_commas, quoted_keys]))


def relationships(c: Column) -> Column:
    """The relationships of an answer; none if the key is missing or the JSON is broken."""
    got = F.from_json(repaired(c), SCHEMA)["relationships"]
    return F.coalesce(got, F.from_json(F.lit('{"relationships": []}'), SCHEMA)["relationships"])
