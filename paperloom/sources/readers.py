"""Readers of exported publications, curated tables, identifier lists and ontologies, with explicit schemas."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = (
    "ARRAY<STRUCT<id: STRING, infons: MAP<STRING, STRING>, passages: ARRAY<STRUCT<offset: INT, infons: MAP<STRING, STRING>, text: STRING, "
    "annotations: ARRAY<STRUCT<id: STRING, text: STRING, infons: MAP<STRING, STRING>, locations: ARRAY<STRUCT<offset: INT, length: INT>>>>>>>>"
)
# Names under which an export may hold its documents.
ENVELOPES = ("PubTator3", "documents")


def publications(spark: SparkSession, path: str) -> DataFrame:
    """pmid, infons, passages of annotated publications in JSON files; a file with neither envelope fails the read."""
    schema = ", ".join(f"`{e}` {DOCUMENT}" for e in ENVELOPES)
    files = spark.read.schema(schema).option("multiLine", True).json(path)
    docs = F.coalesce(*[F.col(e) for e in ENVELOPES], F.raise_error(F.lit(f"no documents under any of {ENVELOPES}")))
    return files.select(F.explode(docs).alias("d")).select(F.col("d.id").alias("pmid"), "d.infons", "d.passages")


def annotations(docs: DataFrame) -> DataFrame:
    """One row for each annotation: pmid, passage_idx, ann_idx, ann_id, label, type, identifier (empty if missing), pos (null without a location)."""
    p = docs.select("pmid", F.posexplode("passages").alias("passage_idx", "p"))
    a = p.select("pmid", "passage_idx", F.posexplode("p.annotations").alias("ann_idx", "a"))
    return a.select(
        "pmid", "passage_idx", "ann_idx", F.col("a.id").alias("ann_id"), F.col("a.text").alias("label"), F.col("a.infons")["type"].alias("type"),
        F.coalesce(F.col("a.infons")["identifier"], F.lit("")).alias("identifier"), F.get("a.locations", F.lit(0))["offset"].alias("pos"),
    )


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """pmid: the distinct, trimmed, non-blank lines of text files."""
    return spark.read.text(path).select(F.trim("value").alias("pmid")).where("pmid <> ''").distinct()


def curated(spark: SparkSession, path: str) -> DataFrame:
    """A curated table with a header and quoted cells over several lines; all columns are strings."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)


def texts(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """file, text of all files of a suffix in a folder."""
    return spark.read.option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def terms(stanzas: DataFrame) -> DataFrame:
    """id, name, definition (null if there is none) of term stanzas in ``value``; other stanzas are left out."""
    s = stanzas.where(F.startswith(F.ltrim("value"), F.lit("[Term]")))
    line = lambda k: F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^{k}: (.*)$", 1)), F.lit(""))
    return s.select(line("id").alias("id"), line("name").alias("name"), F.regexp_replace(line("def"), r'^"(.*)".*$', "$1").alias("definition"))


def ontology(spark: SparkSession, path: str) -> DataFrame:
    """id, name, definition of the terms of an OBO file; stanzas are parted by blank lines."""
    return terms(spark.read.option("lineSep", "\n\n").text(path))


def publication(docs: DataFrame, pmid: str) -> DataFrame:
    """One publication, or no row."""
    return docs.where(F.col("pmid") == pmid).limit(1)


def by_format(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Publications in BioC JSON (``biocjson``) or as flat lines ``pmid|t|title`` and ``pmid|a|abstract`` (``pubtator``); other formats fail."""
    if kind == "biocjson":
        return publications(spark, path)
    if kind == "pubtator":
        lines = spark.read.text(path).select(F.split("value", r"\|", 3).alias("p")).where(F.size("p") == 3)
        part = lambda k: F.max(F.when(F.col("p")[1] == k, F.col("p")[2]))
        return lines.groupBy(F.col("p")[0].alias("pmid")).agg(part("t").alias("title"), part("a").alias("abstract"))
    raise ValueError(f"unknown format {kind!r}; biocjson and pubtator are known")


@F.pandas_udf(T.StringType())
def _literal_json(lines: pd.Series) -> pd.Series:
    """A Python literal that is a mapping, as JSON; null for any other text."""

    def read(line: str | None) -> str | None:
        try:
            value = ast.literal_eval(line.strip())
            return json.dumps(value) if isinstance(value, dict) else None
        except (ValueError, SyntaxError, TypeError, AttributeError, RecursionError, MemoryError):
            return None

    return lines.map(read)


def literal_lines(spark: SparkSession, path: str, schema: str, gene: str) -> DataFrame:
    """Rows of a file with one Python mapping a line, with the gene they were asked for. Words inside strings stay as they are; lines that
    are no mapping, or can't be read, are left out."""
    lines = spark.read.text(path).select(_literal_json("value").alias("_json")).where("_json IS NOT NULL")
    return lines.select(F.from_json("_json", schema).alias("r")).select("r.*", F.lit(gene).alias("gene"))


def whole_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON file that holds one object or one array over many lines."""
    read = spark.read.option("multiLine", True)
    return (read.schema(schema) if schema else read).json(path)
