"""Queries of the record operators and the model chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import xml as XML
from paperloom.operators import cooccurrence, prompt_cache
from paperloom.operators import records as R
from paperloom.plans import chains
from paperloom.plans.adapters import ANN, KB_FLAT, annotations, knowledge, spread, table
from paperloom.plans.registry import query
from paperloom.sources import folders, readers, service
from paperloom.streaming import batches, cache_state, ingest

_PASSAGE = f"{ANN}, pa AS (SELECT *, pos % 2 passage_idx FROM ann)"


@query("cooccur_passages", f"""WITH {_PASSAGE} SELECT v.pmid, v.passage_idx, v.ann_id variant, e.ann_id entity, e.category FROM pa v LEFT JOIN pa e ON v.pmid = e.pmid AND v.passage_idx = e.passage_idx AND e.category <> 'variant' WHERE v.category = 'variant'""")
def cooccur_passages(spark, d):
    a = annotations(spark, d).withColumn("passage_idx", F.col("pos") % 2)
    return cooccurrence.all_pairs(a).select("pmid", "passage_idx", F.col("variant_ann_id").alias("variant"), F.col("entity_ann_id").alias("entity"), "category")


_VARIANT = """CASE event_id % 8 WHEN 0 THEN concat('NC_0000', 10 + user_id % 13, '.11:g.', event_id, 'A>G') WHEN 1 THEN concat('c.', user_id, '_', user_id + 3, 'A>T;CorrespondingGene:5979') WHEN 2 THEN concat('chrX:', event_id, '-', event_id + 9)
  WHEN 3 THEN 'rs#:2435357' WHEN 4 THEN concat('RS', user_id) WHEN 5 THEN 'c|SUB|A||G;CorrespondingGene:7068' WHEN 6 THEN concat('p|SUB|R|', user_id, '|W;CorrespondingGene:', CASE WHEN user_id % 2 = 0 THEN 54139 ELSE 1 END) END"""
_RS = ", ".join(f"('{k}', '{c}', {p})" for k, (c, p) in R.RS_POSITIONS.items())
_GENES = ", ".join(f"('{k}', '{c}', {p})" for k, (c, p) in R.GENE_STARTS.items())


@query("gene_coordinates", rf"""WITH m AS (SELECT event_id, {_VARIANT} x FROM events), g AS (SELECT * FROM (VALUES {_GENES}) t(k, c, p)), r AS (SELECT * FROM (VALUES {_RS}) t(k, c, p)),
  j AS (SELECT event_id, x, g.c gc, g.p gp, r.c rc, r.p rp FROM m LEFT JOIN g ON g.k = regexp_extract(x, 'CorrespondingGene:([0-9]+)', 1) LEFT JOIN r ON r.k = regexp_extract(x, '[rR][sS][#:]?([0-9]+)', 1))
  SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'chr' || regexp_extract(x, 'NC_0+([0-9]+)', 1) WHEN 1 THEN gc WHEN 2 THEN 'chrX' WHEN 3 THEN rc WHEN 4 THEN rc WHEN 5 THEN gc WHEN 6 THEN gc END chr,
  CAST(CASE event_id % 8 WHEN 0 THEN event_id WHEN 1 THEN gp + CAST(regexp_extract(x, 'c.([0-9]+)_', 1) AS BIGINT) WHEN 2 THEN event_id WHEN 3 THEN rp WHEN 4 THEN rp WHEN 5 THEN gp WHEN 6 THEN gp END AS BIGINT) "start",
  CAST(CASE event_id % 8 WHEN 0 THEN event_id WHEN 1 THEN gp + CAST(regexp_extract(x, '_([0-9]+)', 1) AS BIGINT) WHEN 2 THEN event_id + 9 WHEN 3 THEN rp WHEN 4 THEN rp WHEN 5 THEN gp WHEN 6 THEN gp END AS BIGINT) "end" FROM j""")
def gene_coordinates(spark, d):
    m = table(spark, d, "events").select("event_id", F.expr(_VARIANT).alias("x"))
    return R.with_coordinates(m, "x").select("event_id", "chr", "start", "end")


@query("entity_rows", """SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_type END gene, CASE WHEN event_id % 3 > 0 THEN CAST(user_id % 11 AS INTEGER) END gene_score, CAST(NULL AS VARCHAR) disease FROM events
  UNION ALL SELECT event_id, NULL, NULL, 'd' || user_id FROM events WHERE event_id % 3 = 2""")
def entity_rows(spark, d):
    one = lambda text, score: F.array(F.struct(text.alias("text"), F.lit("i").alias("id"), F.lit("why").alias("explanation"), score.alias("score")))
    none = F.array().cast("array<struct<text:string,id:string,explanation:string,score:int>>")
    e = table(spark, d, "events").select(
        "event_id", F.when(F.col("event_id") % 3 > 0, one(F.col("event_type"), (F.col("user_id") % 11).cast("int"))).otherwise(none).alias("gene"),
        F.when(F.col("event_id") % 3 == 2, one(F.concat(F.lit("d"), "user_id"), F.lit(None).cast("int"))).alias("disease"), *[none.alias(c) for c in ("tissue", "species", "chemical")],
    )
    return R.entity_rows(e, ["event_id"]).select("event_id", "gene", "gene_score", "disease")


@query("status_union", "SELECT event_id, 'valid' status FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'invalid' FROM events WHERE event_id % 3 = 1 UNION ALL SELECT event_id, 'error' FROM events WHERE event_id % 3 = 2")
def status_union(spark, d):
    e = table(spark, d, "events").select("event_id")
    return R.union_with({s: e.where(F.col("event_id") % 3 == i) for i, s in enumerate(("valid", "invalid", "error"))}, "status")


@query("model_union", "SELECT s_suppkey k, s_acctbal bal, CAST(NULL AS VARCHAR) segment, 'small' model FROM supplier UNION ALL SELECT c_custkey, NULL, c_mktsegment, 'large' FROM customer")
def model_union(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))
    return R.union_with({"small": s, "large": table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))}, "model")


@query("ann_filter_types", f"WITH {ANN} SELECT ann_id, \"type\" FROM ann WHERE lower(\"type\") IN ('gene', 'disease')")
def ann_filter_types(spark, d):
    return R.of_types(annotations(spark, d), ["GENE", "Disease"]).select("ann_id", "type")


_XML = """concat('<Record><Classification><Description>', CASE WHEN p_size % 4 = 0 THEN '' ELSE p_brand END, '</Description></Classification><Gene Symbol="', p_brand, '"/><Gene Symbol="G2"/><Trait><Name>', p_type, '</Name><XRef DB="OMIM" ID="', p_partkey, '"/></Trait><Trait><Name>other</Name><XRef DB="MeSH" ID="1"/></Trait>',
  CASE WHEN p_size % 2 = 0 THEN concat('<SequenceLocation Assembly="GRCh38" Chr="', p_size, '" start="', p_partkey, '" stop="', p_partkey + 5, '"/>') ELSE '' END, '</Record>')"""


@query("kb_xml_record", """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'Not provided' ELSE p_brand END significance, concat(p_brand, ';G2') genes, concat(p_type, '=', p_partkey) phenotypes,
  CASE WHEN p_size % 2 = 0 THEN concat('GRCh38:', p_size, ':', p_partkey, '-', p_partkey + 5) ELSE '' END places FROM part""")
def kb_xml_record(spark, d):
    r = R.kb_from_xml(spread(table(spark, d, "part"), "p_partkey").select("p_partkey", F.expr(_XML).alias("x")), "x")
    phenotypes = F.transform("phenotypes", lambda p: F.concat(p["name"], F.lit("="), p["omim"]))
    places = F.transform("places", lambda p: F.concat(p["assembly"], F.lit(":"), p["chr"], F.lit(":"), p["start"], F.lit("-"), p["stop"]))
    return r.select("p_partkey", "significance", F.array_join("genes", ";").alias("genes"), F.array_join(phenotypes, ";").alias("phenotypes"), F.array_join(places, ";").alias("places"))


_UNEVEN = """CASE p_partkey % 7 WHEN 0 THEN concat('<Record><Gene Symbol="', p_brand) WHEN 2 THEN ''
  WHEN 3 THEN concat('<Record><Classification><Description>', p_brand, '</Description></Classification><Gene Symbol="A"/><Gene/><Trait><Name>', p_type, '</Name><Name>again</Name><XRef DB="OMIM" ID="', p_partkey, '"/></Trait><Trait><Name>bare</Name></Trait><SequenceLocation Assembly="GRCh38" Chr="1"/><SequenceLocation Assembly="GRCh37" Chr="', p_size, '" start="5" stop="6"/></Record>')
  WHEN 4 THEN concat('<ReleaseSet><ClinVarSet><ReferenceClinVarAssertion><ClinicalSignificance><Description>', p_brand, '</Description></ClinicalSignificance><MeasureSet><Measure><MeasureRelationship><Symbol><ElementValue Type="Preferred">', p_brand, '</ElementValue></Symbol></MeasureRelationship><SequenceLocation Chr="X" start="', p_partkey, '"/></Measure><Measure><SequenceLocation Assembly="GRCh38" Chr="Y" stop="9"/></Measure></MeasureSet><TraitSet><Trait><Name><ElementValue Type="Preferred">', p_type, '</ElementValue></Name><XRef DB="MeSH" ID="7"/></Trait><Trait><XRef DB="OMIM" ID="', p_size, '"/></Trait></TraitSet></ReferenceClinVarAssertion></ClinVarSet></ReleaseSet>')
  WHEN 5 THEN concat('<Record><Trait><XRef DB="OMIM" ID="', p_partkey, '"/></Trait><Trait><Name>A &amp; B</Name><XRef DB="MeSH" ID="1"/><XRef DB="OMIM" ID="2"/></Trait><Trait/></Record>') WHEN 6 THEN '<Record/>' END"""


@query("kb_xml_uneven", """SELECT p_partkey, CASE WHEN p_partkey % 7 IN (3, 4) THEN p_brand ELSE 'Not provided' END significance, CASE p_partkey % 7 WHEN 3 THEN 'A' WHEN 4 THEN p_brand ELSE '' END genes,
  CASE p_partkey % 7 WHEN 3 THEN concat(p_type, '=', p_partkey, ';bare=-') WHEN 4 THEN concat(p_type, '=-;-=', p_size) WHEN 5 THEN concat('-=', p_partkey, ';A & B=2') ELSE '' END traits,
  CASE p_partkey % 7 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 2 ELSE 0 END n_phenotypes,
  CASE p_partkey % 7 WHEN 3 THEN concat('GRCh38:1:---;GRCh37:', p_size, ':5-6') WHEN 4 THEN concat('-:X:', p_partkey, '--;GRCh38:Y:--9') ELSE '' END places, p_partkey % 7 IN (0, 2) broken FROM part""")
def kb_xml_uneven(spark, d):
    r = R.kb_from_xml(spread(table(spark, d, "part"), "p_partkey").select("p_partkey", F.expr(_UNEVEN).alias("x")), "x")
    some = lambda c: F.coalesce(c, F.lit("-"))
    traits = F.transform("traits", lambda t: F.concat(some(t["name"]), F.lit("="), some(t["omim"])))
    places = F.transform("places", lambda p: F.concat(some(p["assembly"]), F.lit(":"), some(p["chr"]), F.lit(":"), some(p["start"]), F.lit("-"), some(p["stop"])))
    return r.select("p_partkey", "significance", F.array_join("genes", ";").alias("genes"), F.array_join(traits, ";").alias("traits"), F.size("phenotypes").alias("n_phenotypes"), F.array_join(places, ";").alias("places"), "broken")


_DETAILS = """CASE p_partkey % 5 WHEN 0 THEN '<r><Alleles>' WHEN 1 THEN concat('<r><Alleles><Name>', p_name, '</Name><VariantType>SNV</VariantType></Alleles><Gene><Symbol>', p_brand, '</Symbol></Gene><HGVS><Expression>c.', p_partkey, 'A&gt;G</Expression><Expression/></HGVS><HGVS><Expression>p.1</Expression></HGVS></r>')
  WHEN 2 THEN concat('<r><Alleles><n>', p_name, '</n></Alleles><Gene><FullName>', p_type, '</FullName></Gene><ClinicalSignificance><ReviewStatus>', p_type, '</ReviewStatus></ClinicalSignificance></r>')
  WHEN 3 THEN concat('<r><ClinicalSignificance><Description>', p_brand, '</Description><DateLastEvaluated>2020</DateLastEvaluated></ClinicalSignificance><ClinicalSignificance><ReviewStatus>late</ReviewStatus></ClinicalSignificance></r>') END"""


@query("xml_variant_details", """SELECT p_partkey, CASE WHEN p_partkey % 5 IN (1, 2) THEN p_name END "name", CASE WHEN p_partkey % 5 = 1 THEN 'SNV' END "type", CASE WHEN p_partkey % 5 = 1 THEN p_brand END gene_symbol, CASE WHEN p_partkey % 5 = 2 THEN p_type END gene_name,
  CASE WHEN p_partkey % 5 = 1 THEN concat('c.', p_partkey, 'A>G;p.1') ELSE '' END hgvs, CASE WHEN p_partkey % 5 = 3 THEN p_brand END classification, CASE WHEN p_partkey % 5 = 2 THEN p_type END review_status, CASE WHEN p_partkey % 5 = 3 THEN '2020' END last_evaluated FROM part""")
def xml_variant_details(spark, d):
    r = R.significance(R.variant_details(spread(table(spark, d, "part"), "p_partkey").select("p_partkey", F.expr(_DETAILS).alias("x")), "x"), "x")
    return r.withColumn("hgvs", F.array_join("hgvs", ";")).drop("x")


_TREE = "CASE p_partkey % 4 WHEN 0 THEN '<r><broken></r>' WHEN 1 THEN concat('<r><n>', p_name, '</n><n>', p_type, '</n><d a=\"1\"><e>', p_brand, '</e></d></r>') WHEN 2 THEN concat('<r xmlns:q=\"http://q\"><q:n b=\"2\">', p_name, '</q:n></r>') END"


@query("xml_tree", "SELECT p_partkey, CASE WHEN p_partkey % 4 IN (1, 2) THEN p_name END one, CASE WHEN p_partkey % 4 = 1 THEN p_type END two, CASE WHEN p_partkey % 4 = 1 THEN p_brand END deep, CASE WHEN p_partkey % 4 = 2 THEN '2' END attribute FROM part")
def xml_tree(spark, d):
    t = spread(table(spark, d, "part"), "p_partkey").select("p_partkey", F.expr(_TREE).alias("x")).withColumns({"t": XML.tree("x"), "a": XML.tree("x", attributes=True)})
    at = lambda c, path: F.try_variant_get(c, path, "string")
    first = F.when(F.col("p_partkey") % 4 == 1, at("t", "$.n[0]")).otherwise(at("t", "$.n"))
    return t.select("p_partkey", first.alias("one"), at("t", "$.n[1]").alias("two"), at("t", "$.d.e").alias("deep"), at("a", "$.n._b").alias("attribute"))


_GAPS = """CASE p_partkey % 5 WHEN 0 THEN '<A><Author><LastName>x' WHEN 1 THEN concat('<A><Author><CollectiveName>Group</CollectiveName></Author><Author><LastName>Solo</LastName></Author><Author><ForeName>F</ForeName><LastName>', p_brand, '</LastName></Author><Author><ForeName/><LastName>E</LastName></Author><Author><LastName>', p_type, '</LastName><ForeName>G</ForeName></Author><PubDate><Year>2001</Year></PubDate></A>')
  WHEN 2 THEN '<A/>' WHEN 3 THEN concat('<A><ArticleTitle>', p_name, ' <i>in</i> vivo</ArticleTitle><AbstractText/></A>') END"""


@query("xml_article_uneven", """SELECT p_partkey, CASE WHEN p_partkey % 5 = 3 THEN p_name ELSE 'N/A' END title, CASE WHEN p_partkey % 5 = 1 THEN concat('F ', p_brand, '; G ', p_type) ELSE 'N/A' END authors, CASE WHEN p_partkey % 5 = 1 THEN '2001' ELSE 'N/A' END date, 'N/A' abstract FROM part""")
def xml_article_uneven(spark, d):
    return R.article(spread(table(spark, d, "part"), "p_partkey").select("p_partkey", F.expr(_GAPS).alias("x")), "x").select("p_partkey", "title", "authors", "date", "abstract")


_PMC = """CASE p_partkey % 4 WHEN 0 THEN '<article><p>' WHEN 1 THEN concat('<article><article-title>', p_name, '</article-title><abstract><sec><p>', p_type, '<i>x</i> tail</p></sec><p><b>bold first</b> late</p></abstract><body><sec><p>', p_brand, '</p><p/></sec></body><p>outside</p></article>') WHEN 2 THEN concat('<article><body><p>', p_brand, ' <p>inner</p></p></body></article>') END"""


@query("xml_full_text", "SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN concat(p_name, chr(10), chr(10), p_type, chr(10), chr(10), p_brand) WHEN 2 THEN concat(p_brand, ' ', chr(10), chr(10), 'inner') ELSE '' END y FROM part")
def xml_full_text(spark, d):
    return spread(table(spark, d, "part"), "p_partkey").select("p_partkey", F.expr(_PMC).alias("x")).select("p_partkey", XML.full_text("x").alias("y"))


_KBJSON = """concat('{"uid": "', p_partkey, '", "title": "', p_name, '", "germline_classification": ', CASE WHEN p_size % 4 = 0 THEN 'null' ELSE concat('{"description": "', p_brand, '"}') END, ', "genes": [{"symbol": "', p_brand, '", "geneid": "7"}, {"symbol": "G2"}],
  "trait_set": [{"trait_name": "', p_type, '"}], "variation_set": [{"variation_loc": [{"assembly_name": "GRCh38", "chr": "', p_size, '", "start": "1", "stop": "2"}]}]}', CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ' ' END)"""


@query("kb_json_record", """SELECT p_partkey, CAST(p_partkey AS VARCHAR) kb_id, p_name "name", CASE WHEN p_size % 4 = 0 THEN 'Not provided' ELSE p_brand END significance, concat(p_brand, ';G2') genes, p_type phenotypes, CAST(p_size AS VARCHAR) chr FROM part""")
def kb_json_record(spark, d):
    r = R.kb_from_json(table(spark, d, "part").select("p_partkey", F.expr(_KBJSON).alias("x")), "x")
    return r.select("p_partkey", "kb_id", "name", "significance", F.array_join("genes", ";").alias("genes"), F.array_join("phenotypes", ";").alias("phenotypes"), F.get("places", F.lit(0))["chr"].alias("chr"))


_ARTICLE = """concat('<A><Journal><Title>', p_brand, '</Title><PubDate><Year>', 1990 + p_size, '</Year><Month>5</Month></PubDate></Journal>', CASE WHEN p_size % 3 = 0 THEN '' ELSE concat('<ArticleTitle>', p_name, '</ArticleTitle>') END,
  '<Abstract><AbstractText>', p_type, '</AbstractText><AbstractText>more</AbstractText></Abstract><Author><ForeName>A</ForeName><LastName>', p_brand, '</LastName></Author></A>')"""


@query("xml_article", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'N/A' ELSE p_name END title, concat('A ', p_brand) authors, p_brand journal, concat(1990 + p_size, '-5') date, concat(p_type, ' more') abstract,
  CASE WHEN p_size % 3 = 0 THEN concat(p_type, ' more') ELSE concat(p_name, ' ', p_type, ' more') END whole FROM part""")
def xml_article(spark, d):
    m = spread(table(spark, d, "part"), "p_partkey").select("p_partkey", F.expr(_ARTICLE).alias("x"))
    return R.article(m, "x").select("p_partkey", "title", "authors", "journal", "date", "abstract", R.abstract_text("x").alias("whole"))


_ENTRY = "CASE event_id % 4 WHEN 0 THEN '{broken' WHEN 1 THEN concat('{\"time\": ', 1000 + user_id, ', \"value\": \"', event_type, '\"}') WHEN 2 THEN concat('{\"time\": 5, \"value\": \"old\"}') END"


@query("cache_files", "SELECT event_id, CASE WHEN event_id % 4 IN (0, 3) THEN 'corrupt' WHEN event_id % 4 = 2 OR 1000 + user_id + 500 <= 1510 THEN 'expired' ELSE 'hit' END state, CASE WHEN event_id % 4 = 1 AND 1000 + user_id + 500 > 1510 THEN event_type END \"value\" FROM events")
def cache_files(spark, d):
    e = table(spark, d, "events").select("event_id", F.expr(_ENTRY).alias("entry"))
    return R.cache_entries(e, "entry", "STRING", 500, F.lit(1510.0)).select("event_id", "state", "value")


_STANZA = "concat('[Term]', chr(10), 'id: SO:', p_partkey, chr(10), 'name: ', p_name, chr(10), CASE WHEN p_size % 2 = 0 THEN concat('def: \"', p_type, '\" [x:1]', chr(10)) ELSE '' END)"


@query("obo_parse", "SELECT concat('SO:', p_partkey) id, p_name \"name\", CASE WHEN p_size % 2 = 0 THEN p_type END definition FROM part")
def obo_parse(spark, d):
    return readers.terms(table(spark, d, "part").select(F.expr(_STANZA).alias("value")))


_PAIRS = """p AS (SELECT event_id, event_type variant, 'e' || user_id % 5 entity, concat('seen ', CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END, ' with e1 and e', event_id % 7) passage FROM events)"""


@query("llm_chain", f"WITH {_PAIRS} SELECT event_id, variant, entity, 10 score FROM p WHERE contains(passage, variant) AND contains(passage, entity)")
def llm_chain(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", "event_type AS variant", "concat('e', user_id % 5) AS entity", "concat('seen ', CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END, ' with e1 and e', event_id % 7) AS passage")
    return chains.related(e, ["event_id"]).select("event_id", "variant", "entity", "score")


class _Silent(chains.PassageModel):
    def complete(self, prompt: str) -> str:
        raise AssertionError("a prompt of an earlier run was asked again")


_Silent.__name__ = "PassageModel"  # the same model to the cache


@query("llm_chain_cached", f"WITH {_PAIRS} SELECT event_id, variant, entity, 10 score FROM p WHERE contains(passage, variant) AND contains(passage, entity)")
def llm_chain_cached(spark, d):
    """The chain twice, with a compaction of the cache between; the second run's model fails if it is asked at all."""
    at = folders.fresh(spark, "prompts")
    e = table(spark, d, "events").selectExpr("event_id", "event_type AS variant", "concat('e', user_id % 5) AS entity", "concat('seen ', CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END, ' with e1 and e', event_id % 7) AS passage")
    chains.related(e, ["event_id"], cache=at)
    prompt_cache.compacted(spark, at)
    return chains.related(e, ["event_id"], _Silent, cache=at).select("event_id", "variant", "entity", "score")


@query("kb_ids_by_gene", f"WITH {KB_FLAT}, i AS (SELECT s_name symbol FROM supplier WHERE s_suppkey % 3 = 0) SELECT DISTINCT symbol, kb_id FROM kbf JOIN i USING (symbol)")
def kb_ids_by_gene(spark, d):
    wanted = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_name").alias("symbol")).distinct()
    return knowledge(spark, d).select("kb_id", F.explode("genes.symbol").alias("symbol")).distinct().join(wanted, "symbol", "left_semi").select("symbol", "kb_id")


@query("publication_by_id", "SELECT CAST(o_orderkey AS VARCHAR) pmid, o_orderpriority title FROM orders WHERE o_orderkey = 7")
def publication_by_id(spark, d):
    from paperloom.plans.adapters import publications

    return readers.publication(publications(spark, d), "7").select("pmid", "title")


def exports(ann):
    """pmid, doc: a document in the exchange format for each publication, with its annotations in one passage."""
    one = F.struct(F.col("ann_id").alias("id"), F.col("label").alias("text"), F.create_map(F.lit("type"), "type", F.lit("identifier"), "identifier").alias("infons"), F.array(F.struct(F.col("pos").cast("int").alias("offset"), F.lit(1).alias("length"))).alias("locations"))
    docs = ann.groupBy("pmid").agg(F.collect_list(one).alias("annotations"))  # a publication's own
    return docs.select("pmid", F.struct(F.col("pmid").alias("id"), F.array(F.struct(F.lit(0).alias("offset"), F.lit("t").alias("text"), "annotations")).alias("passages")).alias("doc"))


@query("stream_annotations", f"""WITH {ANN} SELECT pmid, CASE WHEN CAST(pmid AS BIGINT) % 97 > 0 THEN ann_id END ann_id, CASE WHEN CAST(pmid AS BIGINT) % 97 > 0 THEN "type" END "type",
  CASE WHEN CAST(pmid AS BIGINT) % 97 > 0 THEN CAST(pos AS INTEGER) END pos, CASE WHEN CAST(pmid AS BIGINT) % 97 > 0 THEN 'stored' WHEN CAST(pmid AS BIGINT) % 2 = 0 THEN 'no record' ELSE 'no known envelope' END state FROM ann
  QUALIFY CAST(pmid AS BIGINT) % 97 > 0 OR row_number() OVER (PARTITION BY pmid) = 1""")
def stream_annotations(spark, d):
    """Exports of all orders, some of them cut off or in an unknown form, written as files and brought in by a stream."""
    at = folders.fresh(spark, "ingest")
    bad = F.col("pmid").cast("long") % 97 == 0
    docs = exports(annotations(spark, d))
    line = F.when(~bad, F.to_json(F.struct(F.array("doc").alias("documents")))).when(F.col("pmid").cast("long") % 2 == 0, F.concat(F.lit('{"documents": [{"id": "'), "pmid", F.lit('", "pass'))).otherwise(F.to_json(F.struct(F.array("doc").alias("other"))))
    docs.select(line.alias("value")).write.option("compression", "gzip").text(f"{at}/source")  # repeated names and types, several times their size as they are
    ingest.ingest(spark, f"{at}/source", f"{at}/store", f"{at}/checkpoint", per_trigger=3)
    good = ingest.stored(spark, f"{at}/store", "annotations").select("pmid", "ann_id", "type", "pos", F.lit("stored").alias("state"))
    rejected = ingest.stored(spark, f"{at}/store", "rejected").select(F.regexp_extract("value", r'"id": ?"(\d+)"', 1).alias("pmid"), F.col("reason").alias("state"))
    return good.unionByName(rejected, allowMissingColumns=True)


@query("stream_ttl_cache", """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i FROM events),
  n AS (SELECT user_id, i, min(i) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS FOLLOWING AND UNBOUNDED FOLLOWING) nxt FROM e),
  c AS (SELECT user_id, CAST(1 AS BIGINT) i FROM e WHERE i = 1 UNION ALL SELECT n.user_id, n.nxt FROM c JOIN n ON c.user_id = n.user_id AND c.i = n.i WHERE n.nxt IS NOT NULL),
  m AS (SELECT e.*, max(c.i) OVER (PARTITION BY e.user_id ORDER BY e.i) held FROM e LEFT JOIN c ON e.user_id = c.user_id AND e.i = c.i)
  SELECT m.event_id, CASE WHEN m.i = m.held THEN 'miss' ELSE 'hit' END state, round(s.value, 6) "value" FROM m JOIN e s ON s.user_id = m.user_id AND s.i = m.held""")
def stream_ttl_cache(spark, d):
    at = folders.fresh(spark, "cache")
    requests = batches.events_stream(spark, f"{d.rstrip('/')}/events.parque[t]", per_trigger=1000).select(F.col("user_id").alias("key"), F.col("event_id").alias("number"), F.col("ts").alias("at"), "value")
    cache_state.started(spark, requests, f"{at}/answers", f"{at}/checkpoint", 86_400, "30 days").awaitTermination()
    return spark.read.schema(cache_state.ANSWER).parquet(f"{at}/answers").select(F.col("number").alias("event_id"), "state", F.round("value", 6).alias("value"))


@query("service_annotations", f"WITH {ANN} SELECT pmid, ann_id, \"type\", CAST(pos AS INTEGER) pos FROM ann WHERE \"type\" IN ('Gene', 'Disease')")
def service_annotations(spark, d):
    """Genes and diseases of all orders, asked of a service in requests of a hundred ids; the types are pushed down to it."""
    at = folders.fresh(spark, "service")
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("pmid"))
    buckets = service.buckets_for(ids.count())
    service.export(exports(annotations(spark, d)).select("pmid", F.to_json("doc").alias("value")), f"{at}/store", buckets)
    service.write_ids(ids, f"{at}/ids", buckets)
    service.register(spark)
    got = spark.read.format("publications").options(store=f"{at}/store", buckets=str(buckets), ids_path=f"{at}/ids").load()
    return got.where("type IN ('Gene', 'Disease')").select("pmid", "ann_id", "type", "pos")
