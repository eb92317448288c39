"""The engine's tables over the test tables: publications, annotations, predictions, a knowledge base, regions, texts.

Each adapter has its SQL for the oracles beside it, as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.annotations import CATEGORY_OF_TYPE

#: Part types stand for annotation types.
TYPE_OF_PART = {"PROMO": "Mutation", "ECONOMY": "Gene", "SMALL": "Disease", "MEDIUM": "Tissue", "LARGE": "Species", "STANDARD": "Chemical"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt over as many tasks as a shuffle has. A small file of many short rows is one row group, which one task would read
    and work through, however long its rows take."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _case(c: str, values: dict[str, str]) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


_TYPE = _case("p_type", TYPE_OF_PART)
_CATEGORY = _case("p_type", {k: CATEGORY_OF_TYPE[v] for k, v in TYPE_OF_PART.items()})


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """pmid, ann_id, pos, label, identifier, type, category, score, accepted, flag: one annotation for each line item."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_linestatus", "l_returnflag")
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").cast("string").alias("pmid"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ann_id"),
        F.col("l_linenumber").alias("pos"), F.col("p_name").alias("label"), F.col("p_brand").alias("identifier"),
        F.expr(_TYPE).alias("type"), F.expr(_CATEGORY).alias("category"), F.round(F.col("l_discount") * 100).cast("int").alias("score"),
        (F.col("l_linestatus") == "O").alias("accepted"), F.col("l_returnflag").alias("flag"),
    )


ANN = f"""ann AS (SELECT CAST(l_orderkey AS VARCHAR) pmid, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) ann_id,
  l_linenumber pos, p_name "label", p_brand identifier, {_TYPE} "type", {_CATEGORY} category,
  CAST(round(l_discount * 100) AS INTEGER) score, l_linestatus = 'O' accepted, l_returnflag flag
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def publications(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("pmid"), F.col("o_orderpriority").alias("title"), "o_orderstatus", "o_orderdate", "o_totalprice", "o_custkey")


PUB = "pub AS (SELECT CAST(o_orderkey AS VARCHAR) pmid, o_orderpriority title, o_orderstatus, o_orderdate, o_totalprice, o_custkey FROM orders)"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """pmid, variant, gene, score, flag: variants and genes that occur together."""
    from paperloom.operators.cooccurrence import pairs

    a = annotations(spark, d)
    got = pairs(a.where("category = 'variant'"), a.where("category = 'gene'"), keep_lonely=False)
    return got.select("pmid", F.col("variant_label").alias("variant"), F.col("entity_label").alias("gene"), F.col("entity_score").alias("score"), F.col("entity_flag").alias("flag"))


PRED = f"""{ANN}, pred AS (SELECT v.pmid, v."label" variant, e."label" gene, e.score, e.flag FROM ann v JOIN ann e ON v.pmid = e.pmid
  WHERE v.category = 'variant' AND e.category = 'gene')"""


def knowledge(spark: SparkSession, d: str) -> DataFrame:
    """kb_id, name, significance, chr, start, stop, genes, phenotypes: known variants with their genes and phenotypes as arrays."""
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_brand")
    genes = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nations = table(spark, d, "nation").select("n_nationkey", "n_name")
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(genes, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("p_partkey").alias("kb_id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))
        .agg(
            F.array_sort(F.collect_set(F.struct(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("symbol")))).alias("genes"),
            F.array_sort(F.collect_set(F.struct(F.col("s_nationkey").cast("string").alias("id"), F.col("n_name").alias("name")))).alias("phenotypes"),
        )
        .select(
            "kb_id", "name", "brand", F.when(F.col("size") < 17, "Pathogenic").when(F.col("size") < 34, "Benign").otherwise("Uncertain significance").alias("significance"),
            (F.col("kb_id") % 22 + 1).cast("string").alias("chr"), (F.col("kb_id") * 10).alias("start"), (F.col("kb_id") * 10 + F.col("size")).alias("stop"), "genes", "phenotypes",
        )
    )


KB_FLAT = """kbf AS (SELECT DISTINCT p_partkey kb_id, p_name "name", p_brand brand, p_size size, CAST(s_suppkey AS VARCHAR) gene_id, s_name symbol, CAST(s_nationkey AS VARCHAR) ph_id, n_name ph_name
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
  kb AS (SELECT DISTINCT kb_id, "name", brand, CASE WHEN size < 17 THEN 'Pathogenic' WHEN size < 34 THEN 'Benign' ELSE 'Uncertain significance' END significance,
  CAST(kb_id % 22 + 1 AS VARCHAR) chr, kb_id * 10 "start", kb_id * 10 + size stop FROM kbf)"""


def notated(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, text: the documents' whole texts between variant notation made from the document's number."""
    n = F.col("doc_id").cast("string")
    text = F.concat(
        F.lit("FOX"), F.expr("substr('ABCDE', cast(doc_id % 5 AS int) + 1, 1)"), F.lit("1 c."), n, F.lit("A>G; chr"), (F.col("doc_id") % 22 + 1).cast("string"), F.lit(":"), n, F.lit("-"),
        (F.col("doc_id") + 5).cast("string"), F.lit(" rs"), n, F.lit(", p.Arg"), n, F.lit("Cys and c."), n, F.lit("del near 15q"), (F.col("doc_id") % 30).cast("string"), F.lit(" in lung development; "),
        F.coalesce("text", F.lit("")), F.lit(" c."), n, F.lit("A>G"),
    )
    return table(spark, d, "documents").select("doc_id", text.alias("text"))


NOTE = """note AS (SELECT doc_id, concat('FOX', substr('ABCDE', CAST(doc_id % 5 AS INTEGER) + 1, 1), '1 c.', doc_id, 'A>G; chr', doc_id % 22 + 1, ':', doc_id, '-', doc_id + 5, ' rs', doc_id,
  ', p.Arg', doc_id, 'Cys and c.', doc_id, 'del near 15q', doc_id % 30, ' in lung development; ', "text", ' c.', doc_id, 'A>G') "text" FROM documents)"""
