"""Queries of operators over gene and disease at once, of whole documents with their passages, and of lookups by any identifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import annotations as A
from paperloom.operators import evaluation as E
from paperloom.operators import records as R
from paperloom.operators import relationships as L
from paperloom.operators import recogniser, splitter
from paperloom.plans import coordinate_chain
from paperloom.plans.adapters import ANN, KB_FLAT, NOTE, annotations, knowledge, notated, table
from paperloom.plans.registry import query
from paperloom.sources import readers

#: Relationships with holes: a variant, gene and disease that can be missing, scores as lists that can be null or empty.
_RELS = """SELECT l_orderkey * 10 + l_linenumber rel_id, l_orderkey, nullif(CASE WHEN l_linenumber % 5 = 0 THEN '' ELSE concat('rs', l_partkey) END, 'rs7') variant,
  CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE concat('G', l_suppkey % 50) END gene, CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE concat('d', l_partkey % 40) END disease, l_returnflag flag, CAST(l_quantity AS INT) q, l_discount disc FROM lineitem"""
_REL = f"rel AS ({_RELS.replace('INT)', 'INTEGER)')})"


def _rels(spark, d):
    table(spark, d, "lineitem").createOrReplaceTempView("_rels_lineitem")
    return spark.sql(_RELS.replace("FROM lineitem", "FROM _rels_lineitem"))


@query("rel_load_any", f"WITH {_REL} SELECT rel_id, variant, gene, disease FROM rel WHERE variant <> '' AND (gene <> '' OR disease <> '')")
def rel_load_any(spark, d):
    return L.usable(_rels(spark, d)).select("rel_id", "variant", "gene", "disease")


_LISTS = "CASE WHEN q % 4 > 0 THEN [q % 11, q % 7] END gs, CASE WHEN q % 3 = 0 THEN [] WHEN q % 3 = 1 THEN [q % 13] END ds"


@query("score_threshold_both", f"WITH {_REL}, s AS (SELECT rel_id, {_LISTS} FROM rel) SELECT rel_id FROM s WHERE (gs IS NULL OR list_max(gs) >= 6) AND (ds IS NULL OR coalesce(list_max(ds), -1) >= 6)")
def score_threshold_both(spark, d):
    q = F.col("q")
    r = _rels(spark, d).withColumns({
        "gs": F.when(q % 4 > 0, F.array(q % 11, q % 7)), "ds": F.when(q % 3 == 0, F.array().cast("array<int>")).when(q % 3 == 1, F.array(q % 13)),
    })
    return L.reaching(r, 6, ("gs", "ds")).select("rel_id")


@query("coverage_all", f"""WITH {_REL}, k AS (SELECT flag, 'variants' what, variant v FROM rel UNION ALL SELECT flag, 'genes', gene FROM rel UNION ALL SELECT flag, 'diseases', disease FROM rel),
  m AS (SELECT what, v, bool_or(flag = 'A') p, bool_or(flag = 'R') t FROM k WHERE v <> '' AND flag IN ('A', 'R') GROUP BY ALL)
  SELECT what, CAST(count_if(p AND t) AS BIGINT) covered, CAST(count_if(t) AS BIGINT) total, round(100.0 * count_if(p AND t) / nullif(count_if(t), 0), 4) percent FROM m GROUP BY what""")
def coverage_all(spark, d):
    r = _rels(spark, d).select("flag", *[F.nullif(F.col(c), F.lit("")).alias(c) for c in ("variant", "gene", "disease")])
    return E.coverages(r.where("flag = 'A'"), r.where("flag = 'R'"), {"variants": "variant", "genes": "gene", "diseases": "disease"})


_TRUTH = "SELECT *, CASE WHEN q % 3 = 0 THEN concat('chr', q % 22 + 1) END chr, CASE WHEN q % 5 = 0 THEN l_orderkey END \"start\", CASE WHEN q % 7 = 0 THEN l_orderkey + q END \"end\", CASE WHEN q % 2 = 0 THEN 'SNP' ELSE 'structural' END mode FROM rel WHERE flag <> 'A'"


@query("gt_rollup_all", f"""WITH {_REL}, t AS ({_TRUTH}) SELECT variant, coalesce(string_agg(DISTINCT nullif(gene, ''), '; ' ORDER BY nullif(gene, '')), '') genes, coalesce(string_agg(DISTINCT disease, '; ' ORDER BY disease), '') diseases,
  string_agg(DISTINCT CAST(l_orderkey AS VARCHAR), '; ' ORDER BY CAST(l_orderkey AS VARCHAR)) pmids, string_agg(DISTINCT mode, '; ' ORDER BY mode) modes,
  arg_min(chr, rel_id) FILTER (chr IS NOT NULL) chr, arg_min("start", rel_id) FILTER ("start" IS NOT NULL) "start", arg_min("end", rel_id) FILTER ("end" IS NOT NULL) "end" FROM t WHERE variant IS NOT NULL GROUP BY variant""")
def gt_rollup_all(spark, d):
    q, key = F.col("q"), F.col("l_orderkey")
    t = _rels(spark, d).where("flag <> 'A'").withColumn("mode", F.when(q % 2 == 0, "SNP").otherwise("structural"))
    sets = {"genes": F.nullif(F.col("gene"), F.lit("")), "diseases": F.lower("disease"), "pmids": key, "modes": F.col("mode")}
    firsts = {"chr": F.when(q % 3 == 0, F.concat(F.lit("chr"), (q % 22 + 1).cast("string"))), "start": F.when(q % 5 == 0, key), "end": F.when(q % 7 == 0, key + q)}
    return E.rolled_up(t, "variant", sets, firsts, F.col("rel_id"))


def _documents(spark, d):
    """Documents of the exchange format: a title, an abstract and a body, with the annotations of every three positions in one passage."""
    a = annotations(spark, d).groupBy("pmid").agg(F.collect_list(F.struct("ann_id", "label", "type", "identifier", F.col("pos").cast("int").alias("pos"))).alias("anns"))
    kinds = F.array(*map(F.lit, ("title", "abstract", "body")))
    last = F.array_max(F.transform("anns", lambda x: F.floor((x["pos"] - 1) / 3).cast("int")))
    mark = lambda x: F.struct(x["ann_id"].alias("id"), x["label"].alias("text"), F.create_map(F.lit("type"), x["type"], F.lit("identifier"), x["identifier"]).alias("infons"), F.array(F.struct(x["pos"].alias("offset"), F.lit(1).alias("length"))).alias("locations"))
    own = lambda i: F.transform(F.filter("anns", lambda x: F.floor((x["pos"] - 1) / 3) == i), mark)
    passage = lambda i: F.struct(F.lit(0).alias("offset"), F.create_map(F.lit("type"), F.get(kinds, i)).alias("infons"), F.concat(F.get(kinds, i), F.lit(" of "), "pmid").alias("text"), own(i).alias("annotations"))
    return a.select("pmid", F.transform(F.sequence(F.lit(0), last), passage).alias("passages"))


_PA = f"{ANN}, pa AS (SELECT *, CAST((pos - 1) // 3 AS INTEGER) passage_idx FROM ann)"


@query("content_by_type", f"""WITH {_PA}, c AS (SELECT pmid, "type", count(*) n FROM pa GROUP BY ALL), p AS (SELECT pmid, CAST(max(passage_idx) + 1 AS INTEGER) n_passages, count(*) n_annotations FROM pa GROUP BY pmid)
  SELECT p.pmid, n_passages, n_annotations, string_agg("type" || '=' || n, ';' ORDER BY "type") by_type FROM p JOIN c USING (pmid) GROUP BY ALL""")
def content_by_type(spark, d):
    docs = _documents(spark, d)
    by = F.array_join(F.transform(F.map_entries("by_type"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return A.content_info(docs, readers.annotations(docs)).withColumn("by_type", by)


@query("passage_counts", f"WITH {_PA} SELECT pmid, passage_idx, \"type\", count(*) n FROM pa GROUP BY GROUPING SETS ((pmid, passage_idx, \"type\"), (\"type\"))")
def passage_counts(spark, d):
    return A.passage_counts(readers.annotations(_documents(spark, d)))


@query("completeness_three_types", f"""WITH {ANN} SELECT pmid, count(*) expected, CAST(count_if(accepted) AS BIGINT) made, CASE WHEN count(*) = count_if(accepted) THEN 'OK' ELSE 'missing' END status FROM ann WHERE "type" IN ('Mutation', 'Gene', 'Disease') GROUP BY pmid""")
def completeness_three_types(spark, d):
    return A.complete(annotations(spark, d), ["Mutation", "Gene", "Disease"], "accepted")


@query("context_entities", f"""WITH {_PA} SELECT pmid, 'title of ' || pmid title, CASE WHEN max(passage_idx) >= 1 THEN 'abstract of ' || pmid END abstract, coalesce(string_agg(DISTINCT "label", ';' ORDER BY "label") FILTER (category = 'variant'), '') variants,
  coalesce(string_agg(DISTINCT "label", ';' ORDER BY "label") FILTER (category = 'gene'), '') genes, coalesce(string_agg(DISTINCT "label", ';' ORDER BY "label") FILTER (category = 'species'), '') species FROM pa GROUP BY pmid""")
def context_entities(spark, d):
    docs = _documents(spark, d)
    got = A.context(docs, readers.annotations(docs))
    return got.select("pmid", "title", "abstract", *[F.array_join(c, ";").alias(to) for c, to in (("variant", "variants"), ("gene", "genes"), ("species", "species"))])


@query("extract_prf_mean", f"""WITH {_REL}, p AS (SELECT DISTINCT l_orderkey, gene FROM rel WHERE flag IN ('A', 'N') AND gene <> ''), t AS (SELECT DISTINCT l_orderkey, gene FROM rel WHERE flag IN ('N', 'R') AND gene <> ''),
  m AS (SELECT coalesce(p.l_orderkey, t.l_orderkey) k, p.gene IS NOT NULL ip, t.gene IS NOT NULL ig FROM p FULL JOIN t ON p.l_orderkey = t.l_orderkey AND p.gene = t.gene),
  c AS (SELECT k, count_if(ip AND ig) tp, count_if(ip AND NOT ig) fp, count_if(ig AND NOT ip) fn FROM m GROUP BY k), r AS (SELECT coalesce(round(tp / nullif(tp + fp, 0), 6), 0) p, coalesce(round(tp / nullif(tp + fn, 0), 6), 0) r FROM c)
  SELECT count(*) documents, round(avg(p), 6) mean_precision, round(avg(r), 6) mean_recall, round(avg(coalesce(round(2 * p * r / nullif(p + r, 0), 6), 0)), 6) mean_f1 FROM r""")
def extract_prf_mean(spark, d):
    r = _rels(spark, d).where("gene <> ''")
    return E.averaged(E.pair_metrics(r.where("flag IN ('A', 'N')"), r.where("flag IN ('N', 'R')"), ["l_orderkey", "gene"], ["l_orderkey"]))


@query("graph_edges_by_kind", f"""WITH {_REL}, e AS (SELECT 'gene-variant' kinds, 'gene:' || gene a, 'variant:' || variant b FROM rel WHERE gene <> '' AND variant <> '' UNION SELECT 'disease-variant', 'disease:' || disease, 'variant:' || variant FROM rel WHERE disease <> '' AND variant <> ''),
  n AS (SELECT kinds, a x FROM e UNION SELECT kinds, b FROM e), c AS (SELECT kinds, count(*) nodes FROM n GROUP BY kinds) SELECT e.kinds, count(*) edges, any_value(nodes) nodes FROM e JOIN c ON e.kinds = c.kinds GROUP BY e.kinds""")
def graph_edges_by_kind(spark, d):
    r = _rels(spark, d).where("variant <> ''")
    edge = lambda kind: r.where(f"{kind} <> ''").select(F.lit("variant").alias("kind_a"), F.col("variant").alias("a"), F.lit(kind).alias("kind_b"), F.col(kind).alias("b"))
    return E.edge_counts(edge("gene").unionByName(edge("disease")))


@query("prompt_variant_distribution", "WITH m AS (SELECT conv_id, to_json(list({'role': role, 'content': \"text\"} ORDER BY turn)) k FROM conversations GROUP BY conv_id), v AS (SELECT k, count(DISTINCT conv_id % 5) n FROM m GROUP BY k) SELECT n variants, count(*) messages FROM v GROUP BY n")
def prompt_variant_distribution(spark, d):
    """How many distinct prompts have how many variants; a prompt is all messages of a conversation."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    m = table(spark, d, "conversations").groupBy("conv_id").agg(F.md5(F.to_json(said)).alias("k"))
    return m.groupBy("k").agg(F.count_distinct(F.col("conv_id") % 5).alias("variants")).groupBy("variants").agg(F.count("*").alias("messages"))


@query("publication_report", f"""WITH {NOTE}, w AS (SELECT doc_id, (length(lower("text")) - length(replace(lower("text"), 'lung', ''))) // 4 lung, (length(lower("text")) - length(replace(lower("text"), 'development', ''))) // 11 dev FROM note)
  SELECT count(*) total, round(100.0 * count_if(lung + dev >= 2) / nullif(count(*), 0), 4) percent_relevant, round(avg(lung + dev), 6) mean_score, CAST(sum(lung) AS BIGINT) lung, CAST(sum(dev) AS BIGINT) development FROM w""")
def publication_report(spark, d):
    low = F.lower("text")
    times = lambda w: F.floor((F.length("low") - F.length(F.replace("low", F.lit(w), F.lit("")))) / len(w)).cast("long")
    w = notated(spark, d).select(low.alias("low")).select(times("lung").alias("lung"), times("development").alias("development"))
    score = F.col("lung") + F.col("development")
    return w.agg(F.count("*").alias("total"), E.ratio(100 * F.count_if(score >= 2), F.count("*"), 4).alias("percent_relevant"), F.round(F.avg(score), 6).alias("mean_score"), F.sum("lung").alias("lung"), F.sum("development").alias("development"))


@query("pmid_list_checked", "SELECT DISTINCT CAST(o_orderkey AS VARCHAR) pmid FROM orders")
def pmid_list_checked(spark, d):
    return R.ids_checked(table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("pmid")).distinct(), "pmid")


_ANSWER = """CASE p_partkey % 5 WHEN 0 THEN concat('<Record><Classification><Description>', p_brand, '</Description></Classification><Gene Symbol="X', p_size, '"/><Trait><Name>', p_type, '</Name></Trait></Record>')
  WHEN 1 THEN concat('{"uid": "', p_partkey, '", "title": "', p_name, '", "genes": [{"symbol": "J', p_size, '"}], "trait_set": []}') WHEN 2 THEN '<Record><Gene' WHEN 3 THEN '{"uid": ' END"""


@query("kb_record_any", """SELECT CAST(p_partkey AS VARCHAR) kb_id, CASE WHEN p_partkey % 5 = 1 THEN p_name ELSE 'Variant ' || p_partkey END "name", CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE 'Not provided' END significance,
  CASE p_partkey % 5 WHEN 0 THEN 'X' || p_size WHEN 1 THEN 'J' || p_size ELSE '' END genes, CASE p_partkey % 5 WHEN 0 THEN p_type ELSE '' END phenotypes, CASE p_partkey % 5 WHEN 0 THEN 'xml' WHEN 1 THEN 'json' ELSE 'stub' END source FROM part""")
def kb_record_any(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("kb_id"), F.expr(_ANSWER).alias("answer"))
    got = R.kb_by_id(p, p.where("answer IS NOT NULL"))
    return got.withColumns({c: F.array_join(c, ";") for c in ("genes", "phenotypes")})


@query("kb_ids_by_any", f"""WITH {KB_FLAT}, w AS (SELECT 'gene' how, upper(s_name) "value" FROM supplier UNION SELECT 'rs', 'RS' || p_size FROM part UNION SELECT 'notation', ' ' || p_name FROM part)
  SELECT DISTINCT how, "value", kb_id FROM w JOIN kbf ON (how = 'gene' AND lower(symbol) = lower("value")) OR (how = 'rs' AND CAST(size AS VARCHAR) = substr("value", 3)) OR (how = 'notation' AND "name" = trim("value"))""")
def kb_ids_by_any(spark, d):
    part, kb = table(spark, d, "part"), knowledge(spark, d).select("kb_id", "name", "genes")
    kb = kb.join(part.select(F.col("p_partkey").alias("kb_id"), F.concat(F.lit("rs"), F.col("p_size").cast("string")).alias("rs")), "kb_id")
    wanted = {"gene": table(spark, d, "supplier").select(F.upper("s_name").alias("value")), "rs": part.select(F.concat(F.lit("RS"), F.col("p_size").cast("string")).alias("value")), "notation": part.select(F.concat(F.lit(" "), "p_name").alias("value"))}
    return R.union_with({how: R.kb_ids(kb, w, how) for how, w in wanted.items()}, "how").select("how", "value", "kb_id")


@query("variant_details", """WITH l AS (SELECT l_partkey k, nullif(CAST(l_orderkey AS VARCHAR), '7') pmid, CASE WHEN l_linenumber % 3 = 0 THEN 'PMC' || l_suppkey END pmcid FROM lineitem)
  SELECT p_partkey variant_id, p_name "name", coalesce(string_agg(DISTINCT pmid, ';' ORDER BY pmid), '') pmids, coalesce(string_agg(DISTINCT pmcid, ';' ORDER BY pmcid), '') pmcids FROM part LEFT JOIN l ON k = p_partkey GROUP BY ALL""")
def variant_details(spark, d):
    links = table(spark, d, "lineitem").select(F.col("l_partkey").alias("variant_id"), F.nullif(F.col("l_orderkey").cast("string"), F.lit("7")).alias("pmid"), F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("PMC"), F.col("l_suppkey").cast("string"))).alias("pmcid"))
    got = R.publications_of(table(spark, d, "part").select(F.col("p_partkey").alias("variant_id"), F.col("p_name").alias("name")), links)
    return got.withColumns({c: F.array_join(c, ";") for c in ("pmids", "pmcids")})


@query("coordinate_tests", f"""WITH {NOTE}, t AS (SELECT doc_id, 'c.' || (doc_id + 1) || 'A>G' coordinate, 'FOX' || substr('ABCDE', CAST(doc_id % 3 AS INTEGER) + 1, 1) || '1' gene FROM note),
  c AS (SELECT t.doc_id, gene, array_to_string(list_filter(string_split("text", chr(10)), lambda z: contains(z, coordinate)), ' ') x FROM t JOIN note ON note.doc_id = t.doc_id + 1)
  SELECT t.doc_id test_id, c.doc_id IS NOT NULL "found", contains(lower(x), 'lung') AND contains(lower(x), lower(c.gene)) linked FROM t LEFT JOIN c ON c.doc_id = t.doc_id""")
def coordinate_tests(spark, d):
    """For each document a test that looks for its successor's coordinate in both, and asks for a tissue and a gene; the whole chain by the rule model."""
    texts = notated(spark, d).select(F.col("doc_id").alias("pmid"), "text")
    pmid = F.col("pmid")
    gene = F.concat(F.lit("FOX"), F.substr(F.lit("ABCDE"), (pmid % 3 + 1).cast("int"), F.lit(1)), F.lit("1"))
    tests = texts.select(
        pmid.alias("test_id"), F.array(pmid, pmid + 1).alias("pmids"), F.concat(F.lit("c."), (pmid + 1).cast("string"), F.lit("A>G")).alias("coordinate"), F.create_map(F.lit("tissue"), F.lit("lung"), F.lit("gene"), gene).alias("query")
    )
    terms = table(spark, d, "part").select(F.concat(F.lit("SO:"), F.col("p_partkey").cast("string")).alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return coordinate_chain.tested(tests, texts, terms)


@query("chunk_recursive")
def chunk_recursive(spark, d):
    """Every document in pieces of at most 2,000 code points that overlap by up to 200."""
    got = splitter.pieces(table(spark, d, "documents").select("doc_id", "text"), 2000, 200)
    return got.select("doc_id", "piece", F.length("text").alias("n_chars"), F.md5("text").alias("y"))


@query("entities_recognised")
def entities_recognised(spark, d):
    """Names of parts, and the first three words of each benchmark item, in whole documents."""
    item = F.concat_ws(" ", F.slice(F.split(F.trim("text"), r"\s+"), 1, 3))
    names = table(spark, d, "part").select(F.col("p_name").alias("name"), F.lit("part").alias("kind")).distinct().unionByName(table(spark, d, "benchmark").select(item.alias("name"), F.lit("item").alias("kind")))
    got = recogniser.recognised(notated(spark, d), names.unionByName(spark.range(1).select(F.lit("lung development").alias("name"), F.lit("process").alias("kind"))))
    return got.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end", "s.name", "s.kind")
