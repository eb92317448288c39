"""Queries over annotations and relationships: scans, filters, joins, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.operators import annotations as A
from paperloom.operators import cooccurrence as C
from paperloom.operators import evaluation as E
from paperloom.operators import relationships as R
from paperloom.operators.numbering import numbered
from paperloom.plans.adapters import ANN, NOTE, PRED, PUB, annotations, notated, predictions, publications, table
from paperloom.plans.registry import query

THRESHOLDS = [None, 6, 7, 8, 9, 10]
VAR = "v AS (SELECT pmid, ann_id, \"label\", identifier, score, flag FROM ann WHERE category = 'variant')"
OTH = "e AS (SELECT pmid, ann_id, \"label\", identifier, category, score, flag FROM ann WHERE category <> 'variant')"


@query("scan_publications", f"WITH {PUB} SELECT pmid, title FROM pub")
def scan_publications(spark, d):
    return publications(spark, d).select("pmid", "title")


@query("ann_by_type", f"WITH {ANN} SELECT pmid, ann_id, \"label\", \"type\" FROM ann WHERE \"type\" IN ('Gene', 'Mutation')")
def ann_by_type(spark, d):
    return A.by_type(annotations(spark, d), ["gene", "variant"], with_type=True)


@query("rel_load_filter", f"WITH {PRED} SELECT pmid, variant, gene FROM pred WHERE variant <> '' AND gene <> ''")
def rel_load_filter(spark, d):
    return predictions(spark, d).where("variant <> '' AND gene <> ''").select("pmid", "variant", "gene")


@query("rel_filter_entity", f"WITH {ANN} SELECT DISTINCT v.pmid, v.ann_id FROM ann v JOIN ann e ON v.pmid = e.pmid WHERE v.category = 'variant' AND e.category = 'gene' AND (e.\"label\" = 'red widget' OR e.identifier = 'Brand#7')")
def rel_filter_entity(spark, d):
    a = annotations(spark, d)
    genes = a.where("category = 'gene'").groupBy("pmid").agg(F.collect_list(F.struct("label", "identifier")).alias("genes"))
    nested = a.where("category = 'variant'").select("pmid", "ann_id").join(genes, "pmid", "left")
    # The value may be a text or an id.
    return R.with_entity(nested, "genes", "red widget").select("pmid", "ann_id").unionByName(R.with_entity(nested, "genes", "Brand#7").select("pmid", "ann_id")).distinct()


@query("rel_filter_flat", f"WITH {ANN}, {VAR}, {OTH} SELECT v.pmid, v.ann_id variant_ann_id, e.ann_id entity_ann_id FROM v JOIN e ON v.pmid = e.pmid WHERE e.category = 'disease' AND e.\"label\" = 'blue bolt'")
def rel_filter_flat(spark, d):
    got = C.all_pairs(annotations(spark, d), keep_lonely=False).where("category = 'disease' AND entity_label = 'blue bolt'")
    return got.select("pmid", "variant_ann_id", "entity_ann_id")


@query("score_threshold", f"""WITH {PRED}, s AS (SELECT pmid, variant, max(score) m FROM pred GROUP BY pmid, variant) SELECT pmid, variant FROM s WHERE m IS NULL OR m >= 7""")
def score_threshold(spark, d):
    s = predictions(spark, d).groupBy("pmid", "variant").agg(F.collect_list("score").alias("scores"))
    return s.where(R.passes(F.col("scores"), 7)).select("pmid", "variant")


@query("llm_accept", f"WITH {ANN} SELECT pmid, ann_id, score FROM ann WHERE accepted AND category IN ('gene', 'disease', 'tissue', 'species', 'chemical')")
def llm_accept(spark, d):
    return annotations(spark, d).where(F.col("accepted") & F.col("category").isin("gene", "disease", "tissue", "species", "chemical")).select("pmid", "ann_id", "score")


@query("filter_gene", f"WITH {PRED} SELECT pmid, variant, gene FROM pred WHERE gene = 'red widget'")
def filter_gene(spark, d):
    return predictions(spark, d).where("gene = 'red widget'").select("pmid", "variant", "gene")


@query("filter_disease", f"WITH {ANN} SELECT ann_id, \"label\" FROM ann WHERE category = 'disease' AND regexp_matches(\"label\", '(?i)RED|^small')")
def filter_disease(spark, d):
    return annotations(spark, d).where(F.col("category") == "disease").where(F.coalesce(F.col("label").rlike("(?i)RED|^small"), F.lit(False))).select("ann_id", "label")


@query("filter_cascade", "SELECT event_id FROM events WHERE value IS NOT NULL AND props IS NOT NULL AND value >= 10")
def filter_cascade(spark, d):
    return table(spark, d, "events").where("value IS NOT NULL").where("props IS NOT NULL").where("value >= 10").select("event_id")


@query("gene_in_list", f"WITH {PRED} SELECT gene, count(*) n FROM pred WHERE gene IN ('red widget', 'blue bolt', 'hot gear') GROUP BY gene")
def gene_in_list(spark, d):
    return predictions(spark, d).where(F.col("gene").isin("red widget", "blue bolt", "hot gear")).groupBy("gene").agg(F.count("*").alias("n"))


@query("pmid_validate", "SELECT event_id, CAST(user_id AS VARCHAR) || CASE WHEN event_id % 7 = 0 THEN 'x' ELSE '' END pmid, event_id % 7 <> 0 valid FROM events")
def pmid_validate(spark, d):
    pmid = F.concat(F.col("user_id").cast("string"), F.when(F.col("event_id") % 7 == 0, "x").otherwise(""))
    return table(spark, d, "events").select("event_id", pmid.alias("pmid")).withColumn("valid", F.col("pmid").rlike("^[0-9]+$"))


@query("coord_validate", "SELECT event_id, user_id - 5 \"start\", user_id - 5 + event_id % 11 - 3 \"end\", (0 <= user_id - 5 AND event_id % 11 - 3 >= 0 AND event_type <> '') valid FROM events")
def coord_validate(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", (F.col("user_id") - 5).alias("start"), (F.col("user_id") - 5 + F.col("event_id") % 11 - 3).alias("end"))
    return e.select("event_id", "start", "end", ((F.col("event_type") != "") & (F.col("start") >= 0) & (F.col("start") <= F.col("end"))).alias("valid"))


@query("search_text", "SELECT doc_id FROM documents WHERE contains(lower(\"text\"), 'thth')")
def search_text(spark, d):
    return table(spark, d, "documents").where(F.contains(F.lower("text"), F.lit("thth"))).select("doc_id")


@query("relation_lookup", f"WITH {PRED} SELECT DISTINCT variant, gene FROM pred WHERE variant = 'red widget' AND score >= 5")
def relation_lookup(spark, d):
    return predictions(spark, d).where("variant = 'red widget' AND score >= 5").select("variant", "gene").distinct()


@query("cooccur_pairs", f"WITH {ANN}, {VAR}, {OTH} SELECT v.pmid, v.ann_id variant_ann_id, e.ann_id entity_ann_id, e.category FROM v LEFT JOIN e ON v.pmid = e.pmid")
def cooccur_pairs(spark, d):
    return C.all_pairs(annotations(spark, d)).select("pmid", "variant_ann_id", "entity_ann_id", "category")


@query("cooccur_inner", f"WITH {ANN}, {VAR}, {OTH} SELECT v.pmid, v.ann_id variant_ann_id, e.ann_id entity_ann_id FROM v JOIN e ON v.pmid = e.pmid")
def cooccur_inner(spark, d):
    return C.all_pairs(annotations(spark, d), keep_lonely=False).select("pmid", "variant_ann_id", "entity_ann_id")


_LIST = "coalesce(string_agg(\"label\", '; ' ORDER BY \"label\") FILTER (WHERE category = '{}'), '') {}"


@query("cooccur_nested", f"""WITH {ANN}, l AS (SELECT pmid, {", ".join(_LIST.format(c, n) for c, n in (("gene", "genes"), ("disease", "diseases"), ("tissue", "tissues"), ("species", "species"), ("chemical", "chemicals")))}
  FROM ann WHERE category <> 'variant' GROUP BY pmid) SELECT a.pmid, a.ann_id, a."label" variant, coalesce(genes, '') genes, coalesce(diseases, '') diseases, coalesce(tissues, '') tissues,
  coalesce(species, '') species, coalesce(chemicals, '') chemicals FROM ann a LEFT JOIN l ON a.pmid = l.pmid WHERE a.category = 'variant'""")
def cooccur_nested(spark, d):
    return C.nested(annotations(spark, d))


@query("passages_with_variants", f"WITH {ANN} SELECT pmid, ann_id FROM ann WHERE pmid IN (SELECT pmid FROM ann WHERE category = 'variant')")
def passages_with_variants(spark, d):
    return C.passages_with_variants(annotations(spark, d)).select("pmid", "ann_id")


@query("cooccur_flatten", f"""WITH {ANN} SELECT v.pmid, v.ann_id, v."label" variant, coalesce(g."label", '') gene, coalesce(s."label", '') disease, coalesce(t."label", '') tissue FROM ann v
  LEFT JOIN ann g ON g.pmid = v.pmid AND g.category = 'gene' LEFT JOIN ann s ON s.pmid = v.pmid AND s.category = 'disease' LEFT JOIN ann t ON t.pmid = v.pmid AND t.category = 'tissue' WHERE v.category = 'variant'""")
def cooccur_flatten(spark, d):
    return C.flattened(annotations(spark, d))


@query("merge_cooc_llm", f"""WITH {PRED}, c AS (SELECT DISTINCT pmid, variant, gene FROM pred WHERE flag IN ('A', 'N')), s AS (SELECT pmid, variant, gene, max(score) score FROM pred WHERE flag IN ('N', 'R') GROUP BY ALL)
  SELECT coalesce(c.pmid, s.pmid) pmid, coalesce(c.variant, s.variant) variant, coalesce(c.gene, s.gene) gene, coalesce(score, 0) score FROM c FULL JOIN s ON c.pmid = s.pmid AND c.variant = s.variant AND c.gene = s.gene""")
def merge_cooc_llm(spark, d):
    p = predictions(spark, d)
    return R.merged(p.where("flag IN ('A', 'N')"), p.where("flag IN ('N', 'R')"), ["pmid", "variant"], "gene")


@query("pmid_availability", "SELECT CAST(o_orderkey AS VARCHAR) pmid, o_orderkey IN (SELECT l_orderkey FROM lineitem) available FROM orders")
def pmid_availability(spark, d):
    have = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")).distinct().withColumn("available", F.lit(True))
    o = table(spark, d, "orders").select("o_orderkey")
    return o.join(have, o["o_orderkey"] == have["k"], "left").select(F.col("o_orderkey").cast("string").alias("pmid"), F.coalesce("available", F.lit(False)).alias("available"))


@query("missing_pmids", "SELECT CAST(o_orderkey AS VARCHAR) pmid FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_pmids(spark, d):
    o, ln = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select("l_orderkey")
    return o.join(ln, o["o_orderkey"] == ln["l_orderkey"], "left_anti").select(F.col("o_orderkey").cast("string").alias("pmid"))


@query("extra_pmids", "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) pmid FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def extra_pmids(spark, d):
    o, ln = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey"), table(spark, d, "lineitem").select("l_orderkey").distinct()
    return ln.join(o, ln["l_orderkey"] == o["o_orderkey"], "left_anti").select(F.col("l_orderkey").cast("string").alias("pmid"))


@query("gt_semi_pmids", f"WITH {PRED} SELECT DISTINCT pmid, variant, gene FROM pred WHERE flag IN ('N', 'R') AND pmid IN (SELECT pmid FROM pred WHERE flag IN ('A', 'N') AND score >= 8)")
def gt_semi_pmids(spark, d):
    p = predictions(spark, d)
    return p.where("flag IN ('N', 'R')").select("pmid", "variant", "gene").distinct().join(p.where("flag IN ('A', 'N') AND score >= 8").select("pmid"), "pmid", "left_semi")


@query("assignment_accuracy", f"""WITH {PRED}, k AS (SELECT DISTINCT variant FROM pred WHERE flag = 'A' INTERSECT SELECT DISTINCT variant FROM pred WHERE flag = 'R'),
  h AS (SELECT DISTINCT a.variant FROM pred a JOIN pred b ON a.variant = b.variant AND a.gene = b.gene WHERE a.flag = 'A' AND b.flag = 'R')
  SELECT (SELECT count(*) FROM k) common, (SELECT count(*) FROM h) "right", round(100.0 * (SELECT count(*) FROM h) / nullif((SELECT count(*) FROM k), 0), 4) percent""")
def assignment_accuracy(spark, d):
    p = predictions(spark, d)
    return E.accuracy_by_overlap(p.where("flag = 'A'"), p.where("flag = 'R'"), "variant", "gene")


@query("count_reconcile", f"""WITH {PRED}, a AS (SELECT gene, count(*) n FROM pred WHERE flag = 'A' GROUP BY gene), b AS (SELECT gene, count(*) n FROM pred WHERE flag = 'R' AND score > 5 GROUP BY gene)
  SELECT a.gene, a.n n_csv, coalesce(b.n, 0) n_json, a.n - coalesce(b.n, 0) diff FROM a LEFT JOIN b ON a.gene = b.gene""")
def count_reconcile(spark, d):
    p = predictions(spark, d)
    a = p.where("flag = 'A'").groupBy("gene").agg(F.count("*").alias("n_csv"))
    b = p.where("flag = 'R' AND score > 5").groupBy("gene").agg(F.count("*").alias("n_json"))
    return a.join(b, "gene", "left").withColumn("n_json", F.coalesce("n_json", F.lit(0))).withColumn("diff", F.col("n_csv") - F.col("n_json"))


@query("runlength_assign", """WITH g AS (SELECT n_nationkey, n_name, sum(n_nationkey * 3 + 2) OVER (ORDER BY n_nationkey) - (n_nationkey * 3 + 2) lo, sum(n_nationkey * 3 + 2) OVER (ORDER BY n_nationkey) hi FROM nation),
  p AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) i FROM supplier) SELECT s_suppkey, n_name FROM p JOIN g ON i > lo AND i <= hi""")
def runlength_assign(spark, d):
    # The lengths are a dimension of a few rows.
    n = F.col("n_nationkey") * 3 + 2
    hi = F.sum(n).over(Window.orderBy("n_nationkey"))
    g = table(spark, d, "nation").select("n_name", (hi - n).alias("lo"), hi.alias("hi"))
    p = numbered(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", "i")
    return p.join(F.broadcast(g), (F.col("i") > F.col("lo")) & (F.col("i") <= F.col("hi"))).select("s_suppkey", "n_name")


@query("snippets_build", """WITH r AS (SELECT p_name, l_orderkey, l_linenumber, l_suppkey, o_orderpriority, row_number() OVER (PARTITION BY p_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) rn, p_partkey
  FROM part JOIN lineitem ON p_partkey = l_partkey JOIN orders ON l_orderkey = o_orderkey) SELECT p_partkey, l_orderkey, l_linenumber, l_suppkey, contains(o_orderpriority, p_name) "found" FROM r WHERE rn <= 20""")
def snippets_build(spark, d):
    p, ln, o = (table(spark, d, t) for t in ("part", "lineitem", "orders"))
    r = p.select("p_partkey", "p_name").join(ln.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey"), F.col("p_partkey") == F.col("l_partkey"))
    r = r.join(o.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    r = r.withColumn("rn", F.row_number().over(Window.partitionBy("p_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey"))).where("rn <= 20")
    return r.select("p_partkey", "l_orderkey", "l_linenumber", "l_suppkey", F.contains("o_orderpriority", "p_name").alias("found"))


@query("bench_expand", """SELECT b.item_id, c.doc_id, k."chunk" FROM benchmark b JOIN documents c ON c.doc_id % 40 = b.item_id JOIN (SELECT doc_id, unnest(range(CAST(ceil(length("text") / 1000.0) AS BIGINT))) "chunk" FROM documents) k ON k.doc_id = c.doc_id""")
def bench_expand(spark, d):
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 40).alias("item_id"), F.explode(F.expr("sequence(0L, cast(ceil(length(text) / 1000.0) AS long) - 1)")).alias("chunk"))
    return docs.join(table(spark, d, "benchmark").select("item_id"), "item_id").select("item_id", "doc_id", "chunk")


@query("union_missing_cols", "SELECT s_suppkey k, s_name \"name\", s_acctbal bal, CAST(NULL AS VARCHAR) segment FROM supplier UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer")
def union_missing_cols(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True)


@query("union_distinct", "SELECT l_partkey k FROM lineitem WHERE l_returnflag = 'A' UNION SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def union_distinct(spark, d):
    ln = table(spark, d, "lineitem")
    return ln.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("k")).union(ln.where("l_returnflag = 'R'").select("l_partkey")).distinct()


@query("intersect_sets", f"WITH {PRED} SELECT variant, gene FROM pred WHERE flag = 'A' INTERSECT SELECT variant, gene FROM pred WHERE flag = 'R'")
def intersect_sets(spark, d):
    p = predictions(spark, d)
    return p.where("flag = 'A'").select("variant", "gene").intersect(p.where("flag = 'R'").select("variant", "gene"))


@query("except_sets", f"WITH {PRED} SELECT pmid, variant FROM pred WHERE flag = 'A' EXCEPT SELECT pmid, variant FROM pred WHERE flag = 'R'")
def except_sets(spark, d):
    p = predictions(spark, d)
    return p.where("flag = 'A'").select("pmid", "variant").subtract(p.where("flag = 'R'").select("pmid", "variant"))


@query("extractor_venn", """WITH u AS (SELECT l_partkey k, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) a, max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) b, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) c FROM lineitem GROUP BY 1)
  SELECT a, b, c, count(*) n FROM u GROUP BY a, b, c""")
def extractor_venn(spark, d):
    ln = table(spark, d, "lineitem")
    u = ln.groupBy("l_partkey").agg(*[F.max((F.col("l_returnflag") == f).cast("int")).alias(n) for f, n in (("A", "a"), ("N", "b"), ("R", "c"))])
    return u.groupBy("a", "b", "c").agg(F.count("*").alias("n"))


@query("evidence_sweep", f"""WITH {PRED}, th AS (SELECT unnest([-1, 6, 7, 8, 9, 10]) t), p AS (SELECT DISTINCT t, pmid, variant, gene FROM pred, th WHERE flag IN ('A', 'N') AND score >= t),
  g AS (SELECT DISTINCT t, q.pmid, variant, gene FROM pred q JOIN (SELECT DISTINCT t, pmid FROM p) k ON k.pmid = q.pmid WHERE flag IN ('N', 'R')),
  m AS (SELECT coalesce(p.t, g.t) t, p.pmid IS NOT NULL ip, g.pmid IS NOT NULL ig FROM p FULL JOIN g ON p.t = g.t AND p.pmid = g.pmid AND p.variant = g.variant AND p.gene = g.gene),
  c AS (SELECT t, count_if(ip AND ig) tp, count_if(ip AND NOT ig) fp, count_if(ig AND NOT ip) fn FROM m GROUP BY t), r AS (SELECT *, round(tp / nullif(tp + fp, 0), 6) "precision", round(tp / nullif(tp + fn, 0), 6) recall FROM c)
  SELECT CASE WHEN t >= 0 THEN t END threshold, CAST(tp AS BIGINT) tp, CAST(fp AS BIGINT) fp, CAST(fn AS BIGINT) fn, "precision", recall, round(2 * "precision" * recall / nullif("precision" + recall, 0), 6) f1 FROM r""")
def evidence_sweep(spark, d):
    p = predictions(spark, d)
    return E.sweep(p.where("flag IN ('A', 'N')"), p.where("flag IN ('N', 'R')"), THRESHOLDS)


@query("coord_overlap_texts", f"WITH {NOTE} SELECT doc_id, contains(\"text\", 'rs1') has_rs FROM note")
def coord_overlap_texts(spark, d):
    return notated(spark, d).select("doc_id", F.contains("text", F.lit("rs1")).alias("has_rs"))
