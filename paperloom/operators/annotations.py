"""Operators over annotations: selection by type, grouping and counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Annotation types by category, and concept names that stand for types.
CATEGORY_OF_TYPE = {
    "Mutation": "variant", "DNAMutation": "variant", "Variant": "variant", "Gene": "gene", "Disease": "disease", "Tissue": "tissue", "Species": "species", "Chemical": "chemical",
}
ALIASES = {
    "gene": "Gene", "disease": "Disease", "chemical": "Chemical", "species": "Species", "mutation": "Mutation", "variant": "Mutation", "cellline": "CellLine", "tissue": "Tissue",
}


def canonical_type(c: Column) -> Column:
    """The type that a concept name stands for, or the name itself."""
    pairs = [x for k, v in ALIASES.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(c)), c)


def by_type(ann: DataFrame, wanted: list[str], with_type: bool = False) -> DataFrame:
    """Annotations of the wanted types; names and aliases in any case."""
    types = {ALIASES.get(w.lower(), w) for w in wanted}
    got = ann.where(canonical_type(F.col("type")).isin(sorted(types)))
    return got.select("pmid", "ann_id", "label", *(["type"] if with_type else []))


def in_order(label: str, *order: str) -> Column:
    """The labels of a group, in order, as one string."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, label))), lambda x: x[label]), "; ")


def grouped(ann: DataFrame, unknown: str | None = None) -> DataFrame:
    """Labels by document and type. Annotations without a type are left out, or come under ``unknown``."""
    kind = F.coalesce("type", F.lit(unknown)) if unknown else F.col("type")
    rows = ann.withColumn("type", kind).where(F.col("type").isNotNull())
    return rows.groupBy("pmid", "type").agg(in_order("label", "pos", "ann_id").alias("labels"), F.count("*").alias("n"))


def type_counts(ann: DataFrame) -> DataFrame:
    """Annotations by document and type; those without a type form a group of their own."""
    return ann.groupBy("pmid", "type").agg(F.count("*").alias("n"))


def entity_stats(ann: DataFrame) -> DataFrame:
    """For each document the number of entities in each category, one column each."""
    categories = ("variant", "gene", "disease", "tissue", "species", "chemical")
    return ann.groupBy("pmid").agg(*[F.count_if(F.col("category") == c).alias(f"n_{c}") for c in categories])


def content_info(docs: DataFrame, ann: DataFrame) -> DataFrame:
    """pmid, n_passages, n_annotations and ``by_type`` (a map of counts) of each document (pmid, passages), from its annotations as the reader gives them."""
    counts = ann.groupBy("pmid", "type").agg(F.count("*").alias("n")).groupBy("pmid").agg(F.sum("n").alias("n_annotations"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"))
    sizes = docs.select("pmid", F.size(F.coalesce("passages", F.array())).alias("n_passages"))
    return sizes.join(counts, "pmid", "left").select("pmid", "n_passages", F.coalesce("n_annotations", F.lit(0)).cast("long").alias("n_annotations"), "by_type")


def passage_counts(ann: DataFrame) -> DataFrame:
    """Annotations by document, passage and type, and by type over all (pmid and passage_idx null), in one pass."""
    return ann.groupingSets([["pmid", "passage_idx", "type"], ["type"]], "pmid", "passage_idx", "type").agg(F.count("*").alias("n"))


def complete(ann: DataFrame, types: list[str], made: str) -> DataFrame:
    """pmid, expected (annotations of the types), made (those of them for which ``made`` holds), status: OK or missing."""
    wanted = ann.where(F.col("type").isin(types)).groupBy("pmid").agg(F.count("*").alias("expected"), F.count_if(made).alias("made"))
    return wanted.withColumn("status", F.when(F.col("expected") == F.col("made"), "OK").otherwise("missing"))


def context(docs: DataFrame, ann: DataFrame) -> DataFrame:
    """pmid, title and abstract (the first passage of each kind) and a list of the distinct labels of each category, empty if there are none."""
    of = lambda kind: F.get(F.transform(F.filter("passages", lambda p: p["infons"]["type"] == kind), lambda p: p["text"]), F.lit(0))
    by = ann.groupBy("pmid").agg(*[F.array_sort(F.collect_set(F.when(F.lower("type").isin([t.lower() for t, c in CATEGORY_OF_TYPE.items() if c == kind]), F.col("label")))).alias(kind) for kind in sorted(set(CATEGORY_OF_TYPE.values()))])
    kinds = [c for c in by.columns if c != "pmid"]
    met = docs.select("pmid", of("title").alias("title"), of("abstract").alias("abstract")).join(by, "pmid", "left")
    return met.select("pmid", "title", "abstract", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in kinds])
