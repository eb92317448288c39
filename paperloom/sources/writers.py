"""Sinks: tables of relationships as CSV and JSON Lines, identifier lists, chat examples, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators import records


def csv(df: DataFrame, path: str, first: list[str] | None = None) -> None:
    """With a header; the columns in ``first`` come first and the rest by name."""
    names = [c for c in first or [] if c in df.columns]
    df.select(*names, *sorted(c for c in df.columns if c not in names)).write.csv(path, header=True)


def json_lines(df: DataFrame, path: str) -> bool:
    """Writes unless there is nothing to write; says whether it did."""
    if df.isEmpty():
        return False
    df.write.json(path)
    return True


def id_list(df: DataFrame, path: str, column: str = "pmid") -> None:
    """The distinct values in the order of their text, range-parted, so that the parts in order make one sorted list."""
    df.select(F.col(column).cast("string").alias("value")).distinct().orderBy("value").write.text(path)


def chat_examples(df: DataFrame, path: str) -> None:
    """Rows of question, answer and metadata (a struct) as one JSON object a line; rows with an empty question are left out."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    rows = df.where(F.coalesce(F.trim("question"), F.lit("")) != "")
    rows.select(F.to_json(F.struct(F.array(message("user", "question"), message("assistant", "answer")).alias("messages"), "metadata")).alias("value")).write.text(path)


def report(df: DataFrame, path: str, status: str) -> None:
    """Rows and their statistics by status, side by side."""
    df.groupBy(status).agg(F.count("*").alias("n")).write.json(f"{path}/statistics")
    df.write.json(f"{path}/rows")


def entity_csv(rels: DataFrame, path: str, base: list[str]) -> None:
    """Scored relationships, one row for each entity with only its category's columns filled."""
    records.entity_rows(rels, base).write.csv(path, header=True)


def union_csv(parts: list[DataFrame], path: str, first: list[str] | None = None) -> None:
    """All parts in one table with the union of their columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    csv(out, path, first)


def lines(df: DataFrame, path: str, column: str) -> None:
    """One value a line."""
    df.select(F.col(column).cast("string").alias("value")).write.text(path)


def append_json(df: DataFrame, path: str) -> None:
    """Adds rows to a folder of JSON Lines."""
    df.write.mode("append").json(path)


def sheets(tables: dict[str, DataFrame], path: str) -> None:
    """Several tables side by side, each a CSV folder under its name."""
    for name, df in tables.items():
        csv(df, f"{path}/{name}", df.columns)
