"""Queries that aggregate, rank, look up the knowledge base, search vectors, and keep caches and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.operators import annotations as A
from paperloom.operators import cache
from paperloom.operators import evaluation as E
from paperloom.operators import knowledge as K
from paperloom.operators import relationships as R
from paperloom.operators import vector_index
from paperloom.operators import vectors as V
from paperloom.operators.numbering import numbered
from paperloom.plans.adapters import ANN, KB_FLAT, PRED, annotations, knowledge, predictions, table
from paperloom.plans.registry import query
from paperloom.sources import folders
from paperloom.streaming import batches as S

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


@query("group_by_type", f"WITH {ANN} SELECT pmid, \"type\", string_agg(\"label\", '; ' ORDER BY pos, ann_id, \"label\") labels, count(*) n FROM ann WHERE \"type\" IS NOT NULL GROUP BY pmid, \"type\"")
def group_by_type(spark, d):
    return A.grouped(annotations(spark, d))


_UNTYPED = "u AS (SELECT * REPLACE (CASE WHEN pos % 5 = 0 THEN NULL ELSE \"type\" END AS \"type\") FROM ann)"


def _untyped(spark, d):
    return annotations(spark, d).withColumn("type", F.when(F.col("pos") % 5 != 0, F.col("type")))


@query("ann_grouped", f"WITH {ANN}, {_UNTYPED} SELECT pmid, coalesce(\"type\", 'Unknown') \"type\", string_agg(\"label\", '; ' ORDER BY pos, ann_id, \"label\") labels, count(*) n FROM u GROUP BY pmid, coalesce(\"type\", 'Unknown')")
def ann_grouped(spark, d):
    return A.grouped(_untyped(spark, d), unknown="Unknown")


@query("ann_type_counts", f"WITH {ANN}, {_UNTYPED} SELECT pmid, \"type\", count(*) n FROM u GROUP BY pmid, \"type\"")
def ann_type_counts(spark, d):
    return A.type_counts(_untyped(spark, d))


@query("pub_entity_stats", f"WITH {ANN} SELECT pmid, " + ", ".join(f"CAST(count_if(category = '{c}') AS BIGINT) n_{c}" for c in ("variant", "gene", "disease", "tissue", "species", "chemical")) + " FROM ann GROUP BY pmid")
def pub_entity_stats(spark, d):
    return A.entity_stats(annotations(spark, d))


@query("group_by_variant_key", f"WITH {ANN}, k AS (SELECT coalesce(nullif(CASE WHEN pos % 3 = 0 THEN '' ELSE identifier END, ''), nullif(\"label\", '')) \"key\" FROM ann WHERE category = 'variant') SELECT \"key\", count(*) n FROM k WHERE \"key\" IS NOT NULL GROUP BY 1")
def group_by_variant_key(spark, d):
    v = annotations(spark, d).where("category = 'variant'").withColumn("identifier", F.when(F.col("pos") % 3 == 0, "").otherwise(F.col("identifier")))
    return v.select(R.variant_key("identifier", "label").alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"))


@query("validation_stats", """SELECT count(*) total, CAST(count_if(l_returnflag = 'A') AS BIGINT) valid, CAST(count_if(l_returnflag = 'N') AS BIGINT) invalid, CAST(count_if(l_returnflag = 'R') AS BIGINT) errors,
  CASE WHEN count(*) = 0 THEN 0.0 ELSE round(100.0 * count_if(l_returnflag = 'A') / count(*), 4) END percent_valid FROM lineitem""")
def validation_stats(spark, d):
    n = F.count("*")
    flag = lambda f: F.count_if(F.col("l_returnflag") == f)
    return table(spark, d, "lineitem").agg(
        n.alias("total"), flag("A").alias("valid"), flag("N").alias("invalid"), flag("R").alias("errors"), F.when(n == 0, 0.0).otherwise(F.round(100 * flag("A") / n, 4)).alias("percent_valid")
    )


@query("gt_rollup", f"""WITH {PRED} SELECT variant, string_agg(DISTINCT gene, '; ' ORDER BY gene) genes, string_agg(DISTINCT pmid, '; ' ORDER BY pmid) pmids, CAST(arg_min(score, (pmid, gene, score)) FILTER (WHERE score > 0) AS INTEGER) first_score
  FROM pred WHERE flag IN ('N', 'R') GROUP BY variant""")
def gt_rollup(spark, d):
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "; ")
    p = predictions(spark, d).where("flag IN ('N', 'R')")
    first = F.min_by("score", F.when(F.col("score") > 0, F.struct("pmid", "gene", "score")))
    return p.groupBy("variant").agg(joined("gene").alias("genes"), joined("pmid").alias("pmids"), first.alias("first_score"))


def _prf(entity: str) -> str:
    return f"""WITH {ANN}, q AS (SELECT v."label" variant, e."label" entity, e.flag FROM ann v JOIN ann e ON v.pmid = e.pmid WHERE v.category = 'variant' AND e.category = '{entity}'),
  p AS (SELECT DISTINCT variant, entity FROM q WHERE flag = 'A'), t AS (SELECT DISTINCT variant, entity FROM q WHERE flag = 'R'),
  c AS (SELECT (SELECT count(*) FROM (FROM p INTERSECT FROM t)) tp, (SELECT count(*) FROM (FROM p EXCEPT FROM t)) fp, (SELECT count(*) FROM (FROM t EXCEPT FROM p)) fn),
  r AS (SELECT *, round(tp / nullif(tp + fp, 0), 6) "precision", round(tp / nullif(tp + fn, 0), 6) recall FROM c)
  SELECT *, round(2 * "precision" * recall / nullif("precision" + recall, 0), 6) f1 FROM r"""


def _prf_of(entity: str):
    def run(spark, d):
        from paperloom.operators.cooccurrence import pairs

        a = annotations(spark, d)
        q = pairs(a.where("category = 'variant'"), a.where(F.col("category") == entity), keep_lonely=False)
        q = q.select(F.col("variant_label").alias("variant"), F.col("entity_label").alias("entity"), F.col("entity_flag").alias("flag"))
        return E.pair_metrics(q.where("flag = 'A'"), q.where("flag = 'R'"), ["variant", "entity"])

    return run


for _e in ("gene", "disease"):
    query(f"pair_prf_{_e}", _prf(_e))(_prf_of(_e))


@query("coverage", f"""WITH {PRED}, t AS (SELECT DISTINCT gene FROM pred WHERE flag = 'R' AND score >= 9), p AS (SELECT DISTINCT gene FROM pred WHERE flag = 'A' AND score >= 9)
  SELECT 'gene' what, (SELECT count(*) FROM (FROM t INTERSECT FROM p)) covered, (SELECT count(*) FROM t) total, round(100.0 * (SELECT count(*) FROM (FROM t INTERSECT FROM p)) / nullif((SELECT count(*) FROM t), 0), 4) percent""")
def coverage(spark, d):
    p = predictions(spark, d).where("score >= 9")
    return E.coverage(p.where("flag = 'A'"), p.where("flag = 'R'"), "gene")


@query("rel_distinct_counts", f"WITH {PRED} SELECT count(*) n, count(DISTINCT variant) variants, count(DISTINCT gene) genes, count(DISTINCT pmid) pmids FROM pred")
def rel_distinct_counts(spark, d):
    return predictions(spark, d).agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(f"{c}s") for c in ("variant", "gene", "pmid")])


@query("top_entities", f"WITH {ANN}, c AS (SELECT \"label\", count(*) n FROM ann WHERE category = 'gene' GROUP BY 1) SELECT \"label\", n, row_number() OVER (ORDER BY n DESC, \"label\") rank FROM c QUALIFY rank <= 10")
def top_entities(spark, d):
    c = annotations(spark, d).where("category = 'gene'").groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(10)
    return c.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "label")).cast("long"))


@query("variants_per_pmid", f"WITH {ANN} SELECT pmid, count(*) n FROM ann WHERE category = 'variant' GROUP BY pmid")
def variants_per_pmid(spark, d):
    return annotations(spark, d).where("category = 'variant'").groupBy("pmid").agg(F.count("*").alias("n"))


@query("entities_per_pmid", f"WITH {ANN}, s AS (SELECT pmid, category, count(DISTINCT \"label\") k FROM ann WHERE category <> 'variant' GROUP BY 1, 2) SELECT pmid, CAST(sum(k) AS BIGINT) n FROM s GROUP BY pmid")
def entities_per_pmid(spark, d):
    return annotations(spark, d).where("category <> 'variant'").groupBy("pmid").agg(F.count_distinct("category", "label").alias("n"))


@query("pub_content_info", f"WITH {ANN} SELECT pmid, count(DISTINCT pos % 2) n_passages, count(*) n_annotations, string_agg(DISTINCT \"type\", '; ' ORDER BY \"type\") types FROM ann GROUP BY pmid")
def pub_content_info(spark, d):
    return annotations(spark, d).groupBy("pmid").agg(
        F.count_distinct(F.col("pos") % 2).alias("n_passages"), F.count("*").alias("n_annotations"), F.array_join(F.array_sort(F.collect_set("type")), "; ").alias("types")
    )


@query("variant_completeness", f"""WITH {ANN}, a AS (SELECT pmid, count(*) expected FROM ann WHERE category = 'variant' GROUP BY pmid), b AS (SELECT pmid, count(*) made FROM ann WHERE category = 'variant' AND accepted GROUP BY pmid)
  SELECT a.pmid, expected, coalesce(made, 0) made, CASE WHEN expected = coalesce(made, 0) THEN 'OK' ELSE 'missing' END status FROM a LEFT JOIN b ON a.pmid = b.pmid""")
def variant_completeness(spark, d):
    v = annotations(spark, d).where("category = 'variant'").groupBy("pmid").agg(F.count("*").alias("expected"), F.count_if("accepted").alias("made"))
    return v.withColumn("status", F.when(F.col("expected") == F.col("made"), "OK").otherwise("missing"))


@query("variant_annotation_report", f"WITH {ANN} SELECT pmid, count(*) n, string_agg(\"label\", '; ' ORDER BY \"label\") variants FROM ann WHERE category = 'variant' GROUP BY pmid QUALIFY row_number() OVER (ORDER BY count(*) DESC, pmid) <= 25")
def variant_annotation_report(spark, d):
    v = annotations(spark, d).where("category = 'variant'").groupBy("pmid").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("label")), "; ").alias("variants"))
    return v.orderBy(F.desc("n"), "pmid").limit(25)


@query("entity_counts_grouping_sets", f"WITH {ANN} SELECT pmid, \"type\", count(*) n FROM ann GROUP BY GROUPING SETS ((pmid, \"type\"), (\"type\"))")
def entity_counts_grouping_sets(spark, d):
    return annotations(spark, d).groupingSets([["pmid", "type"], ["type"]], "pmid", "type").agg(F.count("*").alias("n"))


@query("pmids_per_gene", f"WITH {ANN} SELECT p_name gene, count(DISTINCT pmid) n FROM (SELECT DISTINCT p_name FROM part) LEFT JOIN ann ON \"label\" = p_name AND category = 'gene' AND score = 10 AND flag = 'A' GROUP BY 1")
def pmids_per_gene(spark, d):
    genes = table(spark, d, "part").select(F.col("p_name").alias("gene")).distinct()
    a = annotations(spark, d).where("category = 'gene' AND score = 10 AND flag = 'A'").groupBy(F.col("label").alias("gene")).agg(F.count_distinct("pmid").alias("n"))
    return genes.join(a, "gene", "left").select("gene", F.coalesce("n", F.lit(0)).alias("n"))


@query("pub_report", f"WITH {ANN}, s AS (SELECT pmid, max(score) score, bool_or(category = 'variant') has FROM ann GROUP BY pmid) SELECT count(*) total, round(100.0 * count_if(score >= 3) / nullif(count(*), 0), 4) percent_relevant, round(avg(score), 6) mean_score, CAST(count_if(has) AS BIGINT) with_variants FROM s")
def pub_report(spark, d):
    s = annotations(spark, d).groupBy("pmid").agg(F.max("score").alias("score"), F.bool_or(F.col("category") == "variant").alias("has"))
    return s.agg(F.count("*").alias("total"), E.ratio(100 * F.count_if(F.col("score") >= 3), F.count("*"), 4).alias("percent_relevant"), F.round(F.avg("score"), 6).alias("mean_score"), F.count_if("has").alias("with_variants"))


@query("year_hist", "SELECT CAST(year(o_orderdate) AS INTEGER) \"year\", count(*) n FROM orders GROUP BY 1")
def year_hist(spark, d):
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))


@query("gene_token_top", "WITH t AS (SELECT unnest(string_split(p_name, ' ')) token FROM part), c AS (SELECT token, count(*) n FROM t GROUP BY 1) SELECT token, n FROM c QUALIFY row_number() OVER (ORDER BY n DESC, token) <= 10")
def gene_token_top(spark, d):
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("token")).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(10)


@query("ner_accuracy", "SELECT round(CAST(sum(quality) AS DOUBLE) / count(*), 6) accuracy, count(*) n FROM labels")
def ner_accuracy(spark, d):
    return table(spark, d, "labels").agg(E.ratio(F.sum("quality"), F.count("*")).alias("accuracy"), F.count("*").alias("n"))


@query("llm_accuracy", "SELECT round(avg(CASE WHEN l_linestatus = 'O' THEN CAST(l_returnflag = 'A' AS INTEGER) END), 6) accuracy FROM lineitem")
def llm_accuracy(spark, d):
    return table(spark, d, "lineitem").agg(F.round(F.avg(F.when(F.col("l_linestatus") == "O", (F.col("l_returnflag") == "A").cast("int"))), 6).alias("accuracy"))


@query("debug_structure", f"WITH {ANN}, s AS (SELECT pmid, count_if(category = 'gene') g, count_if(category = 'disease') x, count_if(category = 'tissue') t FROM ann GROUP BY pmid) SELECT CAST(count_if(g > 0) AS BIGINT) with_genes, CAST(count_if(x > 0) AS BIGINT) with_diseases, CAST(count_if(t > 0) AS BIGINT) with_tissues, count(*) total FROM s")
def debug_structure(spark, d):
    s = A.entity_stats(annotations(spark, d))
    return s.agg(*[F.count_if(F.col(f"n_{c}") > 0).alias(f"with_{c}s") for c in ("gene", "disease", "tissue")], F.count("*").alias("total"))


@query("variant_class_dist", """WITH v AS (SELECT CASE event_type WHEN 'error' THEN 'c.1_2delinsA' WHEN 'click' THEN 'c.5del' WHEN 'view' THEN 'c.7A>G' WHEN 'signup' THEN 'c.3dup' ELSE 'p.X' END x FROM events),
  k AS (SELECT CASE WHEN contains(x, 'delins') THEN 'delins' WHEN contains(x, 'del') THEN 'del' WHEN contains(x, 'dup') THEN 'dup' WHEN contains(x, 'ins') THEN 'ins' WHEN contains(x, '>') THEN 'sub' ELSE 'other' END "class" FROM v)
  SELECT "class", count(*) n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) percent FROM k GROUP BY 1""")
def variant_class_dist(spark, d):
    from paperloom.functions.text import variant_class

    made = F.expr("CASE event_type WHEN 'error' THEN 'c.1_2delinsA' WHEN 'click' THEN 'c.5del' WHEN 'view' THEN 'c.7A>G' WHEN 'signup' THEN 'c.3dup' ELSE 'p.X' END")
    c = table(spark, d, "events").select(variant_class(made).alias("class")).groupBy("class").agg(F.count("*").alias("n"))
    return c.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


@query("prompt_dup_stats", "WITH m AS (SELECT md5(role || ':' || \"text\") k, count(*) c FROM conversations GROUP BY 1) SELECT count(*) \"distinct\", CAST(sum(c) AS BIGINT) total, round(CAST(count(*) AS DOUBLE) / sum(c), 6) ratio, max(c) most FROM m")
def prompt_dup_stats(spark, d):
    m = table(spark, d, "conversations").groupBy(cache.key_of("role", "text").alias("k")).agg(F.count("*").alias("c"))
    return m.agg(F.count("*").alias("distinct"), F.sum("c").alias("total"), E.ratio(F.count("*"), F.sum("c")).alias("ratio"), F.max("c").alias("most"))


@query("graph_stats", f"WITH {PRED}, e AS (SELECT DISTINCT least('v:' || variant, 'g:' || gene) a, greatest('v:' || variant, 'g:' || gene) b FROM pred) SELECT (SELECT count(*) FROM (SELECT a FROM e UNION SELECT b FROM e)) nodes, (SELECT count(*) FROM e) edges")
def graph_stats(spark, d):
    p = predictions(spark, d).select("variant", "gene").distinct()
    nodes = p.select(F.concat(F.lit("v:"), "variant").alias("x")).union(p.select(F.concat(F.lit("g:"), "gene"))).distinct().agg(F.count("*").alias("nodes"))
    return nodes.join(F.broadcast(p.agg(F.count("*").alias("edges"))))


@query("extract_prf_by_doc", f"""WITH {PRED}, p AS (SELECT DISTINCT pmid, gene FROM pred WHERE flag IN ('A', 'N')), t AS (SELECT DISTINCT pmid, gene FROM pred WHERE flag IN ('N', 'R')),
  m AS (SELECT coalesce(p.pmid, t.pmid) pmid, p.pmid IS NOT NULL ip, t.pmid IS NOT NULL ig FROM p FULL JOIN t ON p.pmid = t.pmid AND p.gene = t.gene),
  c AS (SELECT pmid, CAST(count_if(ip AND ig) AS BIGINT) tp, CAST(count_if(ip AND NOT ig) AS BIGINT) fp, CAST(count_if(ig AND NOT ip) AS BIGINT) fn FROM m GROUP BY pmid),
  r AS (SELECT *, round(tp / nullif(tp + fp, 0), 6) "precision", round(tp / nullif(tp + fn, 0), 6) recall FROM c) SELECT *, round(2 * "precision" * recall / nullif("precision" + recall, 0), 6) f1 FROM r""")
def extract_prf_by_doc(spark, d):
    p = predictions(spark, d)
    return E.pair_metrics(p.where("flag IN ('A', 'N')"), p.where("flag IN ('N', 'R')"), ["pmid", "gene"], ["pmid"])


@query("pmid_first_gene", f"WITH {PRED} SELECT pmid, arg_min(gene, (gene, variant)) gene FROM pred GROUP BY pmid")
def pmid_first_gene(spark, d):
    return predictions(spark, d).groupBy("pmid").agg(F.min_by("gene", F.struct("gene", "variant")).alias("gene"))


@query("pmids_for_genes", "WITH r AS (SELECT l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) rn FROM lineitem) SELECT DISTINCT CAST(l_orderkey AS VARCHAR) pmid FROM r WHERE rn <= 1000")
def pmids_for_genes(spark, d):
    rn = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey"))
    return table(spark, d, "lineitem").withColumn("rn", rn).where("rn <= 1000").select(F.col("l_orderkey").cast("string").alias("pmid")).distinct()


@query("top20_per_key", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS INTEGER) rank FROM events QUALIFY rank <= 20")
def top20_per_key(spark, d):
    return table(spark, d, "events").withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id"))).where("rank <= 20").select("user_id", "event_id", "rank")


@query("batch_assign", "SELECT s_suppkey, CAST(floor((row_number() OVER (ORDER BY s_suppkey) - 1) / 30) AS BIGINT) batch FROM supplier")
def batch_assign(spark, d):
    return numbered(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", "i").select("s_suppkey", F.floor((F.col("i") - 1) / 30).alias("batch"))


@query("topk_score", "SELECT event_id, value FROM events QUALIFY row_number() OVER (ORDER BY value DESC, event_id) <= 5")
def topk_score(spark, d):
    return table(spark, d, "events").orderBy(F.desc("value"), "event_id").limit(5).select("event_id", "value")


_LEVELS = "l AS (SELECT DISTINCT CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE CAST(round(l_discount * 100) AS INTEGER) END t FROM lineitem)"


def _levels(spark, d):
    return table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") % 7 != 0, F.round(F.col("l_discount") * 100).cast("int")).alias("t")).distinct()


@query("threshold_sort_nulls_last", f"WITH {_LEVELS} SELECT t, CAST(row_number() OVER (ORDER BY t NULLS LAST) AS INTEGER) rank FROM l")
def threshold_sort_nulls_last(spark, d):
    return _levels(spark, d).withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("t"))))


@query("threshold_sort_nulls_first", f"WITH {_LEVELS} SELECT t, CAST(row_number() OVER (ORDER BY t NULLS FIRST) AS INTEGER) rank FROM l")
def threshold_sort_nulls_first(spark, d):
    return _levels(spark, d).withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_first("t"))))


@query("offset_limit", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100")
def offset_limit(spark, d):
    return table(spark, d, "customer").select("c_custkey").orderBy("c_custkey").offset(100).limit(50)


@query("kb_by_gene", f"WITH {KB_FLAT} SELECT DISTINCT kb_id FROM kbf WHERE symbol = 'Supplier#000000007' ORDER BY kb_id LIMIT 100")
def kb_by_gene(spark, d):
    return knowledge(spark, d).where(F.exists("genes", lambda g: g["symbol"] == "Supplier#000000007")).select("kb_id").orderBy("kb_id").limit(100)


@query("kb_by_significance", f"WITH {KB_FLAT} SELECT kb_id, significance FROM kb WHERE lower(significance) = 'pathogenic' ORDER BY kb_id LIMIT 100")
def kb_by_significance(spark, d):
    return knowledge(spark, d).where(F.lower("significance") == "pathogenic").select("kb_id", "significance").orderBy("kb_id").limit(100)


@query("kb_by_phenotype", f"WITH {KB_FLAT} SELECT DISTINCT kb_id FROM kbf WHERE contains(lower(ph_name), 'nation_3') ORDER BY kb_id LIMIT 100")
def kb_by_phenotype(spark, d):
    return knowledge(spark, d).where(F.exists("phenotypes", lambda p: F.contains(F.lower(p["name"]), F.lit("nation_3")))).select("kb_id").orderBy("kb_id").limit(100)


@query("kb_by_region", f"WITH {KB_FLAT} SELECT kb_id FROM kb WHERE chr = '5' AND \"start\" <= 9000 AND stop >= 1000 ORDER BY kb_id LIMIT 100")
def kb_by_region(spark, d):
    return knowledge(spark, d).where("chr = '5' AND start <= 9000 AND stop >= 1000").select("kb_id").orderBy("kb_id").limit(100)


@query("kb_lookup_with_stub", f"WITH {KB_FLAT} SELECT i.k kb_id, coalesce(\"name\", 'Variant ' || i.k) \"name\", coalesce(significance, 'Not provided') significance FROM (SELECT c_custkey * 3 k FROM customer) i LEFT JOIN kb ON kb_id = i.k")
def kb_lookup_with_stub(spark, d):
    ids = table(spark, d, "customer").select((F.col("c_custkey") * 3).alias("kb_id"))
    kb = knowledge(spark, d).select("kb_id", "name", "significance")
    return ids.join(kb, "kb_id", "left").select("kb_id", F.coalesce("name", F.concat(F.lit("Variant "), "kb_id")).alias("name"), F.coalesce("significance", F.lit("Not provided")).alias("significance"))


@query("variant_publications", "SELECT p_partkey, string_agg(DISTINCT CAST(l_orderkey AS VARCHAR), '; ' ORDER BY CAST(l_orderkey AS VARCHAR)) pmids FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_returnflag = 'R' GROUP BY 1")
def variant_publications(spark, d):
    ln = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_partkey", F.col("l_orderkey").cast("string").alias("pmid"))
    p = table(spark, d, "part").select("p_partkey")
    return p.join(ln, p["p_partkey"] == ln["l_partkey"]).groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_set("pmid")), "; ").alias("pmids"))


_RELS = """r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey + l_linenumber % 2 * 5 kb_id, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE CAST(l_suppkey AS VARCHAR) END gene_id,
  upper('supplier#00000000' || l_suppkey % 10) gene, CAST(l_orderkey % 25 AS VARCHAR) ph_id, 'nation_' || l_orderkey % 30 ph FROM lineitem)"""


def _rels(spark, d):
    return table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_partkey + l_linenumber % 2 * 5 kb_id", "CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE CAST(l_suppkey AS STRING) END gene_id",
        "upper('supplier#00000000' || l_suppkey % 10) gene", "CAST(l_orderkey % 25 AS STRING) ph_id", "'nation_' || l_orderkey % 30 ph",
    )


_GENE_OK = "EXISTS (SELECT 1 FROM kbf WHERE kbf.kb_id = r.kb_id AND ((r.gene_id <> '' AND kbf.gene_id = r.gene_id) OR lower(symbol) = lower(r.gene)))"
_PH_OK = "EXISTS (SELECT 1 FROM kbf WHERE kbf.kb_id = r.kb_id AND ((r.ph_id <> '' AND kbf.ph_id = r.ph_id) OR lower(ph_name) = lower(r.ph)))"


@query("validate_relationships", f"""WITH {KB_FLAT}, {_RELS}, c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, EXISTS (SELECT 1 FROM kb WHERE kb.kb_id = r.kb_id) k, {_GENE_OK} g, {_PH_OK} p FROM r)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN NOT k THEN 'variant not found' WHEN g AND p THEN 'gene and disease confirmed' WHEN g THEN 'gene confirmed' WHEN p THEN 'disease confirmed' ELSE 'nothing confirmed' END reason,
  CASE WHEN k AND (g OR p) THEN 'valid' ELSE 'invalid' END result FROM c""")
def validate_relationships(spark, d):
    return K.validated(_rels(spark, d), knowledge(spark, d), similar=False).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "reason", "result")


@query("validate_relationships_similar")
def validate_relationships_similar(spark, d):
    """As above, and similar disease names confirm as well."""
    return K.validated(_rels(spark, d), knowledge(spark, d)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "reason", "result")


@query("validate_gene", f"WITH {KB_FLAT}, {_RELS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM r WHERE {_GENE_OK}")
def validate_gene(spark, d):
    r, kb = _rels(spark, d), knowledge(spark, d).select("kb_id", "genes")
    return r.join(kb, "kb_id").where(K.gene_matches(F.col("genes"), F.col("gene_id"), F.col("gene"))).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("validate_disease")
def validate_disease(spark, d):
    """Every relationship of a known variant; a disease is confirmed by its id or a similar name."""
    r = _rels(spark, d).select("l_orderkey", "l_linenumber", "kb_id", "ph_id", "ph")
    return K.similar_phenotypes(r, knowledge(spark, d).select("kb_id", "phenotypes"), "kb_id", "ph", "ph_id")


@query("region_enrich", f"""WITH {KB_FLAT}, g AS (SELECT DISTINCT l_orderkey * 100 + l_linenumber region_id, CAST(l_suppkey % 22 + 1 AS VARCHAR) chr, l_partkey * 10 "start", l_partkey * 10 + CAST(l_quantity AS BIGINT) "end" FROM lineitem)
  SELECT DISTINCT region_id, kb_id FROM g JOIN kb ON g.chr = kb.chr AND kb."start" <= g."end" AND kb.stop >= g."start" """)
def region_enrich(spark, d):
    g = table(spark, d, "lineitem").selectExpr("l_orderkey * 100 + l_linenumber region_id", "CAST(l_suppkey % 22 + 1 AS STRING) chr", "l_partkey * 10 start", "l_partkey * 10 + CAST(l_quantity AS BIGINT) end")
    return K.overlaps(g, knowledge(spark, d)).distinct()


_REGIONS = """g AS (SELECT event_id region_id, CASE WHEN event_id % 9 > 0 THEN CAST(user_id % 22 + 1 AS VARCHAR) END chr, user_id * 7 "start", user_id * 7 + event_id % 5000 - 20 "end" FROM events)"""


@query("region_enrich_left", f"""WITH {KB_FLAT}, {_REGIONS}, h AS (SELECT region_id, string_agg(DISTINCT CAST(kb_id AS VARCHAR), ';' ORDER BY CAST(kb_id AS VARCHAR)) ids FROM g JOIN kb ON g.chr = kb.chr AND kb."start" <= g."end" AND kb.stop >= g."start" WHERE g."start" <= g."end" GROUP BY 1)
  SELECT g.region_id, coalesce(ids, '') ids, CASE WHEN chr IS NULL THEN 'missing coordinates' WHEN "start" > "end" THEN 'start after end' END error FROM g LEFT JOIN h ON h.region_id = g.region_id""")
def region_enrich_left(spark, d):
    g = table(spark, d, "events").selectExpr("event_id region_id", "CASE WHEN event_id % 9 > 0 THEN CAST(user_id % 22 + 1 AS STRING) END chr", "user_id * 7 start", "user_id * 7 + event_id % 5000 - 20 end")
    got = K.enriched(g, knowledge(spark, d))
    return got.select("region_id", F.array_join(F.array_sort(F.transform("kb_ids", lambda x: x.cast("string"))), ";").alias("ids"), "error")


_KNN = """WITH q AS (SELECT vec_id query_id, CAST(embedding AS DOUBLE[]) a FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, round({f}(a, CAST(embedding AS DOUBLE[])), 6) score FROM q, embeddings)
  SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score {o}, vec_id) AS INTEGER) rank, round(score, 4) score FROM s QUALIFY rank <= 5"""


def _knn(metric: str):
    def run(spark, d):
        e = table(spark, d, "embeddings").select("vec_id", "embedding")
        queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
        return V.nearest(e, queries, 5, metric).select("query_id", "vec_id", "rank", F.round("score", 4).alias("score"))

    return run


query("knn_cosine", _KNN.format(f="list_cosine_similarity", o="DESC"))(_knn("cosine"))
query("knn_l2", _KNN.format(f="list_distance", o=""))(_knn("l2"))


@query("knn_indexed")
def knn_indexed(spark, d):
    """As ``knn_cosine``, by the index; tests hold its recall against that."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    at, index = folders.fresh(spark, "vectors"), vector_index.fit(e, k=5)
    vector_index.write(e, index, at)
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector_index.search(spark, at, index, queries, 5).select("query_id", "vec_id", "rank", F.round("score", 4).alias("score"))


@query("cache_latest", "SELECT user_id, arg_max(value, (ts, event_id)) value, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') ts FROM events GROUP BY user_id")
def cache_latest(spark, d):
    return cache.latest(table(spark, d, "events"), "user_id", "ts", "event_id", "value").select("user_id", "value", F.date_format("ts", STAMP).alias("ts"))


@query("cache_ttl_valid", "SELECT event_id FROM events WHERE ts + INTERVAL 86400 SECONDS > TIMESTAMP '2024-01-20 12:00:00'")
def cache_ttl_valid(spark, d):
    return cache.unexpired(table(spark, d, "events"), "ts", 86_400, F.expr("TIMESTAMP '2024-01-20 12:00:00'")).select("event_id")


@query("cache_lru", "SELECT user_id FROM (SELECT user_id, max(ts) ts FROM events GROUP BY user_id) ORDER BY ts DESC, user_id LIMIT 50")
def cache_lru(spark, d):
    return cache.most_recent_keys(table(spark, d, "events").select("user_id", "ts"), "user_id", "ts", 50).select("user_id")


@query("cache_prefix_invalidate", "SELECT event_id, event_type || ':' || user_id \"key\" FROM events WHERE NOT starts_with(event_type || ':' || user_id, 'click:1')")
def cache_prefix_invalidate(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat_ws(":", "event_type", "user_id").alias("key"))
    return cache.without_prefix(e, "key", "click:1")


@query("rate_gap", "WITH g AS (SELECT event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 x FROM events) SELECT event_id, round(x, 3) gap, coalesce(x < 600, false) too_soon FROM g")
def rate_gap(spark, d):
    return cache.gaps(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 600).select("event_id", "gap", "too_soon")


@query("stream_tumbling_counts", "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S.%f') \"start\", event_type, count(*) n FROM events GROUP BY ALL")
def stream_tumbling_counts(spark, d):
    return S.tumbling_counts(table(spark, d, "events")).withColumn("start", F.date_format("start", STAMP))


@query("stream_session_counts", """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL '6 hours' THEN 1 ELSE 0 END fresh, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') "start", count(*) n FROM s GROUP BY user_id, k""")
def stream_session_counts(spark, d):
    return S.session_counts(table(spark, d, "events")).withColumn("start", F.date_format("start", STAMP))
