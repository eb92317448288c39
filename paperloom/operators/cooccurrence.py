"""Co-occurrence of variants with other entities in a passage, as joins on the passage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHOWN = ("ann_id", "label", "identifier", "score", "flag")


def passage(df: DataFrame) -> list[str]:
    """The columns that name a passage: the publication's number and, where there is one, the passage's place in it."""
    return [c for c in ("pmid", "passage_idx") if c in df.columns]


def pairs(variants: DataFrame, others: DataFrame, keep_lonely: bool = True) -> DataFrame:
    """A row for each variant and entity of one passage; with ``keep_lonely`` variants without any stay, with nulls."""
    on = passage(variants)
    v = variants.select(*on, *[F.col(c).alias(f"variant_{c}") for c in SHOWN if c in variants.columns])
    e = others.select(*on, "category", *[F.col(c).alias(f"entity_{c}") for c in SHOWN if c in others.columns])
    return v.join(e, on, "left" if keep_lonely else "inner")


def all_pairs(ann: DataFrame, keep_lonely: bool = True) -> DataFrame:
    return pairs(ann.where("category = 'variant'"), ann.where("category <> 'variant'"), keep_lonely)


def passages_with_variants(ann: DataFrame) -> DataFrame:
    """Annotations of passages in which a variant occurs."""
    on = passage(ann)
    return ann.join(ann.where("category = 'variant'").select(*on), on, "left_semi")


def nested(ann: DataFrame) -> DataFrame:
    """A row for each variant with the labels of each category, sorted and joined.

    The entities of a passage are gathered once, not once for each of its variants.
    """
    on = passage(ann)
    names = {"gene": "genes", "disease": "diseases", "tissue": "tissues", "species": "species", "chemical": "chemicals"}
    lists = ann.where("category <> 'variant'").groupBy(*on).agg(
        *[F.array_join(F.array_sort(F.collect_list(F.when(F.col("category") == c, F.col("label")))), "; ").alias(n) for c, n in names.items()]
    )
    v = ann.where("category = 'variant'").select(*on, "ann_id", F.col("label").alias("variant"))
    return v.join(lists, on, "left").select(*on, "ann_id", "variant", *[F.coalesce(n, F.lit("")).alias(n) for n in names.values()])


def flattened(ann: DataFrame) -> DataFrame:
    """Each variant with every combination of its passage's genes, diseases and tissues; an empty string stands for none."""
    on = passage(ann)
    v = ann.where("category = 'variant'").select(*on, "ann_id", F.col("label").alias("variant"))
    for c in ("gene", "disease", "tissue"):
        e = ann.where(F.col("category") == c).select(*on, F.col("label").alias(c))
        v = v.join(e, on, "left").withColumn(c, F.coalesce(c, F.lit("")))
    return v
