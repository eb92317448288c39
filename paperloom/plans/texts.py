"""Queries of the text, JSON and XML functions, over texts made from the tables' numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import llm_json as J
from paperloom.functions import text as T
from paperloom.functions import xml as X
from paperloom.functions.similarity import text_ratio, text_similar, text_similar_rules
from paperloom.operators import cache, similar
from paperloom.plans.adapters import NOTE, notated, table
from paperloom.plans.registry import query


def joined(c, sep="|"):
    return F.array_join(c, sep)


def _all(patterns, flags="") -> str:
    return " || ".join(f"regexp_extract_all(\"text\", '{flags}{p}')" for p in patterns)


def made(name: str, value: str, duck: str, source: str = "events", key: str = "event_id"):
    """A frame of (key, x) by a Spark expression, and the CTE of the same by DuckDB's."""
    return (lambda spark, d: table(spark, d, source).select(key, F.expr(value).alias("x"))), f"{name} AS (SELECT {key}, {duck} x FROM {source})"


def scalar(name: str, frame, cte: str, fn, sql: str, key: str = "event_id"):
    """Registers a query of one function over x."""
    query(name, f"WITH {cte} SELECT {key}, {sql} y FROM {cte.split(' AS')[0]}" if sql else None)(lambda spark, d: frame(spark, d).select(key, fn(F.col("x")).alias("y")))


@query("coord_regex", f"WITH {NOTE} SELECT doc_id, array_to_string(list_sort(list_distinct({_all(T.COORDINATES)})), '|') y FROM note")
def coord_regex(spark, d):
    return notated(spark, d).select("doc_id", joined(F.array_sort(T.coordinates(F.col("text")))).alias("y"))


@query("coord_regex_all", f"WITH {NOTE} SELECT doc_id, array_to_string({_all(T.COORDINATES)}, '|') y FROM note")
def coord_regex_all(spark, d):
    return notated(spark, d).select("doc_id", joined(T.found(F.col("text"), T.COORDINATES)).alias("y"))


@query("coord_combine", f"WITH {NOTE} SELECT doc_id, array_to_string(list_sort(list_distinct(({_all(T.COORDINATES)}) || ['c.1A>G', 'chr1:1-2'])), '|') y FROM note")
def coord_combine(spark, d):
    both = T.combined(T.coordinates(F.col("text")), F.array(F.lit("c.1A>G"), F.lit("chr1:1-2")))
    return notated(spark, d).select("doc_id", joined(F.array_sort(both)).alias("y"))


_f, _c = made("m", "CASE WHEN event_id % 5 = 0 THEN 'No coordinates found here' ELSE concat(' c.', event_id, 'A>G , ,chr', user_id, ':1-2') END", "CASE WHEN event_id % 5 = 0 THEN 'No coordinates found here' ELSE concat(' c.', event_id, 'A>G , ,chr', user_id, ':1-2') END")
scalar("parse_llm_coords", _f, _c, lambda x: joined(T.parse_coordinates(x)), "CASE WHEN contains(x, 'No coordinates found') THEN '' ELSE array_to_string(list_filter(list_transform(string_split(x, ','), lambda z: trim(z)), lambda z: z <> ''), '|') END")

_ANSWER = "CASE WHEN event_id % 6 = 0 THEN 'NONE' || chr(10) || 'x' ELSE concat('Coordinates:', chr(10), '- c.', event_id, 'A>G', chr(10), '3. p.Arg', user_id, 'Cys', chr(10), 'chr9:1-2', chr(10), '- c.', event_id, 'A>G') END"
_SOURCE = "concat('seen c.', event_id, 'A>G and p.Arg', user_id, 'Cys')"


@query("parse_llm_lines", f"""WITH m AS (SELECT event_id, {_ANSWER} x, {_SOURCE} s FROM events) SELECT event_id, CASE WHEN trim(string_split(x, chr(10))[1]) = 'NONE' THEN '' ELSE array_to_string(list_sort(list_distinct(list_filter(list_transform(
  list_filter(string_split(x, chr(10)), lambda z: NOT regexp_matches(lower(z), 'coordinate|publication')), lambda z: trim(regexp_replace(z, '^(?:- |(?:[1-9][0-9]?|100)\\. )', ''))), lambda z: z <> '' AND contains(s, z)))), '|') END y FROM m""")
def parse_llm_lines(spark, d):
    m = table(spark, d, "events").select("event_id", F.expr(_ANSWER).alias("x"), F.expr(_SOURCE).alias("s"))
    return m.select("event_id", joined(T.parse_lines(F.col("x"), F.col("s"))).alias("y"))


_LISTS = "CASE event_id % 5 WHEN 0 THEN concat('a', event_id, ', b c ,', ' 7') WHEN 1 THEN concat('1. v', event_id, chr(10), '2. w') WHEN 2 THEN concat('- v', event_id, chr(10), '* w') WHEN 3 THEN 'No variants found in the text' ELSE concat('v', event_id, chr(10), 'w', chr(10)) END"
_f, _c = made("m", _LISTS, _LISTS)
_num, _bul = r"\d+\.\s*([^,\n]+)", r"[-*]\s*([^,\n]+)"
scalar(
    "parse_variant_list", _f, _c, lambda x: joined(T.parse_variants(x)),
    f"""CASE WHEN trim(x) = '' OR contains(lower(x), 'no variant') THEN '' ELSE array_to_string(list_filter(list_transform(CASE WHEN contains(x, ',') THEN string_split(x, ',') WHEN regexp_matches(x, '{_num}') THEN regexp_extract_all(x, '{_num}', 1)
    WHEN regexp_matches(x, '{_bul}') THEN regexp_extract_all(x, '{_bul}', 1) ELSE string_split(x, chr(10)) END, lambda z: trim(z)), lambda z: z <> '' AND NOT regexp_matches(z, '^\\d+\\.?$')), '|') END""",
)

_YES = "CASE event_id % 3 WHEN 0 THEN concat('YES', chr(10), ' v', event_id, chr(10), 'why') WHEN 1 THEN concat('NO', chr(10), 'x', chr(10), 'y') ELSE 'YES' END"


@query("parse_yes_no", f"WITH m AS (SELECT event_id, string_split({_YES}, chr(10)) l FROM events) SELECT event_id, len(l) >= 3 AND starts_with(l[1], 'YES') \"found\", CASE WHEN len(l) >= 3 THEN trim(l[2]) ELSE '' END \"value\", CASE WHEN len(l) >= 3 THEN trim(l[3]) ELSE '' END reason FROM m")
def parse_yes_no(spark, d):
    return table(spark, d, "events").select("event_id", T.parse_yes_no(F.expr(_YES)).alias("p")).select("event_id", "p.found", "p.value", "p.reason")


_GENE = "CASE event_id % 4 WHEN 0 THEN concat(' tp', user_id, ' ') WHEN 1 THEN concat('GENE brca', user_id) WHEN 2 THEN concat('Protein abc', user_id) ELSE concat('GEN GENE x', user_id) END"
_f, _c = made("m", _GENE, _GENE)
_strip = lambda p, s: f"CASE WHEN starts_with({s}, '{p} ') THEN substr({s}, {len(p) + 2}) ELSE {s} END"
scalar("norm_gene", _f, _c, T.norm_gene, _strip("PROTEIN", f"({_strip('GENE', '(' + _strip('GEN', 'upper(trim(x))') + ')')})"))
_DIS = "CASE event_id % 3 WHEN 0 THEN concat('Breast  Cancer Disease ', user_id) WHEN 1 THEN concat('Lynch Syndrome', event_type) ELSE concat(' SYNDROME of ', event_type, ' Disease') END"
_f, _c = made("m", _DIS, _DIS)
scalar("norm_disease", _f, _c, T.norm_disease, r"trim(regexp_replace(regexp_replace(lower(x), '\b(?:disease|syndrome)\b', '', 'g'), '\s+', ' ', 'g'))")
_VT = "CASE event_id % 9 WHEN 0 THEN 'c.1A>G' WHEN 1 THEN 'c.1_2del' WHEN 2 THEN 'c.1_2insA' WHEN 3 THEN 'c.5dup' WHEN 4 THEN 'c.1_2delinsT' WHEN 5 THEN 'c.3inv' WHEN 6 THEN 'p.Arg123Cys' WHEN 7 THEN 'rs1042522' ELSE 'other' END"
_f, _c = made("m", _VT, _VT)
scalar("variant_type_hgvs", _f, _c, T.variant_type_hgvs, r"""CASE WHEN contains(x, '>') THEN 'SNV' WHEN contains(x, 'del') AND contains(x, 'ins') THEN 'Indel' WHEN contains(x, 'del') THEN 'Deletion' WHEN contains(x, 'ins') THEN 'Insertion' WHEN contains(x, 'dup') THEN 'Duplication'
  WHEN contains(x, 'inv') THEN 'Inversion' WHEN regexp_matches(x, 'p\.[A-Z][a-z]{2}\d+[A-Z][a-z]{2}') THEN 'Substitution' WHEN regexp_matches(x, '^rs\d+$') THEN 'SNP' ELSE 'Unknown' END""")
_f, _c = made("m", _VT, _VT)
scalar("norm_variant", _f, _c, T.norm_variant, "")

_VTEXT = "CASE event_id % 5 WHEN 0 THEN 'A Deletion' WHEN 1 THEN 'x' WHEN 2 THEN 'duplication' WHEN 3 THEN 't(9;22)' ELSE 'none' END"
_VID = "CASE user_id % 5 WHEN 0 THEN 'c|SUB|G||A' WHEN 1 THEN 'c|INS|3' WHEN 2 THEN 'a>delT' WHEN 3 THEN 'plain' ELSE 'c.1A>G' END"


@query("variant_type_id", f"""WITH m AS (SELECT event_id, {_VTEXT} t, {_VID} i FROM events) SELECT event_id, CASE WHEN contains(lower(t), 'deletion') OR contains(i, '>del') OR contains(i, 'DEL') THEN 'deletion' WHEN contains(lower(t), 'insertion') OR contains(i, '>ins') OR contains(i, 'INS') THEN 'insertion'
  WHEN contains(lower(t), 'duplication') OR contains(i, 'DUP') THEN 'duplication' WHEN contains(lower(t), 'translocation') OR contains(t, 't(') THEN 'translocation' WHEN contains(i, 'SUB') OR contains(i, '>') THEN 'substitution' ELSE 'unknown' END y FROM m""")
def variant_type_id(spark, d):
    return table(spark, d, "events").select("event_id", T.variant_type_id(F.expr(_VTEXT), F.expr(_VID)).alias("y"))


_POS = "CASE event_id % 4 WHEN 0 THEN concat('HGVS:NC_0000', 1 + user_id % 22, '.13:g.', event_id, 'G>A') WHEN 1 THEN concat('chr', 1 + user_id % 22, ':', event_id, '-', event_id + 7) WHEN 2 THEN concat('X:', event_id) ELSE concat('rs', event_id) END"


@query("variant_coords", rf"""WITH m AS (SELECT event_id, {_POS} x FROM events), h AS (SELECT event_id, x, regexp_extract(x, 'HGVS:([\w.:>_]+)', 1) h FROM m), k AS (SELECT *, regexp_extract(h, 'NC_0+(\d+)', 1) c, regexp_extract(h, '\.(\d+)[ACGT]>[ACGT]', 1) p, regexp_extract(x, '(?:chr)?(\d+|X|Y):(\d+)(?:-(\d+))?', 1) fc,
  regexp_extract(x, '(?:chr)?(\d+|X|Y):(\d+)(?:-(\d+))?', 2) fa, regexp_extract(x, '(?:chr)?(\d+|X|Y):(\d+)(?:-(\d+))?', 3) fb FROM h) SELECT event_id, CASE WHEN c <> '' AND p <> '' THEN 'chr' || c WHEN fa <> '' THEN 'chr' || fc END chr,
  CASE WHEN c <> '' AND p <> '' THEN TRY_CAST(p AS BIGINT) WHEN fa <> '' THEN TRY_CAST(fa AS BIGINT) END "start", CASE WHEN c <> '' AND p <> '' THEN TRY_CAST(p AS BIGINT) WHEN fa <> '' THEN TRY_CAST(coalesce(nullif(fb, ''), fa) AS BIGINT) END "end" FROM k""")
def variant_coords(spark, d):
    return table(spark, d, "events").select("event_id", T.position(F.expr(_POS)).alias("p")).select("event_id", "p.chr", "p.start", "p.end")


_f, _c = made("m", "CASE WHEN event_id % 3 = 0 THEN concat('tmVar:x;HGVS:c.', event_id, 'A>G;rs', user_id) ELSE 'none' END", "CASE WHEN event_id % 3 = 0 THEN concat('tmVar:x;HGVS:c.', event_id, 'A>G;rs', user_id) ELSE 'none' END")
scalar("hgvs_extract", _f, _c, T.hgvs, "nullif(regexp_extract(x, 'HGVS:([^;]+)', 1), '')")
_MODE = "CASE event_id % 4 WHEN 0 THEN 'An ENHANCER with loss of function' WHEN 1 THEN 'Loss of function' WHEN 2 THEN 'a gain of function' ELSE 'nothing' END"
_f, _c = made("m", _MODE, _MODE)
scalar("variant_mode", _f, _c, T.variant_mode, "CASE WHEN contains(lower(x), 'enhancer') THEN 'enhancer' WHEN contains(lower(x), 'loss of function') THEN 'loss-of-function' WHEN contains(lower(x), 'gain of function') THEN 'gain-of-function' END")
_RS = "CASE event_id % 3 WHEN 0 THEN concat('tmVar:rs', event_id, ';VariantGroup:', user_id) WHEN 1 THEN concat('chr1-', event_id) ELSE NULL END"
_f, _c = made("m", _RS, _RS)
scalar("rs_clean", _f, _c, T.rs_clean, r"coalesce(nullif(regexp_extract(x, 'rs\d+', 0), ''), x)")
_GT = "concat('AP-2alpha (', user_id, '); FOX', event_id % 9, ' (', event_id, '); x Y')"
_f, _c = made("m", _GT, _GT)
scalar("gene_tokens", _f, _c, lambda x: joined(T.gene_tokens(x)), r"array_to_string(list_filter(regexp_extract_all(x, '([A-Z0-9-]+)\s*(?:\(\d+\))?', 1), lambda g: length(g) >= 2 AND NOT regexp_matches(g, '^[0-9]+$')), '|')")
_DT = "concat('Breast Cancer (MESH:D', user_id, ');  ', event_type, ' MESH:D', event_id, '; ')"
_f, _c = made("m", _DT, _DT)
scalar("disease_tokens", _f, _c, lambda x: joined(T.disease_tokens(x)), r"array_to_string(list_filter(list_transform(regexp_split_to_array(x, ';\s*'), lambda z: lower(trim(regexp_replace(z, '\s*\(MESH:[^)]*\)|MESH:\S+', '', 'g')))), lambda z: z <> ''), '|')")
_PT = "concat(event_id, '; ', user_id, ',', event_id + 1, ';')"
_f, _c = made("m", _PT, _PT)
scalar("pmid_tokens", _f, _c, lambda x: joined(T.pmid_tokens(x)), r"array_to_string(list_filter(list_transform(regexp_split_to_array(x, '[;,]\s*'), lambda z: trim(z)), lambda z: z <> ''), '|')")
_PC = "CASE WHEN event_id % 3 = 0 THEN 'see text' ELSE concat(event_id, '; ', user_id, ' (A et al. 2001)') END"
_f, _c = made("m", _PC, _PC)
scalar("pmid_cell", _f, _c, lambda x: joined(T.pmid_cell(x)), "CASE WHEN regexp_matches(x, '^[0-9]') THEN array_to_string(list_filter(list_transform(string_split(string_split(x, '(')[1], ';'), lambda z: trim(z)), lambda z: z <> ''), '|') END")


def _hits(words) -> str:
    return "(" + " + ".join(f"CAST(contains(lower(\"text\"), '{w.lower()}') AS INTEGER)" for w in words) + ")"


def _variants(patterns) -> str:
    return f"list_sort(list_distinct({_all(patterns, '(?i)')}))"


_FOUND = f"list_sort(list_distinct(list_filter({_all(T.GENES)}, lambda g: upper(g) IN ({', '.join(repr(g) for g in T.KNOWN_GENES)}) OR contains(upper(g), 'FOX'))))"


@query("kw_score_simple", f"WITH {NOTE} SELECT doc_id, CAST({_hits(T.SIMPLE[0])} * 2 + {_hits(T.SIMPLE[1])} + {_hits(T.SIMPLE[2])} AS INTEGER) y FROM note")
def kw_score_simple(spark, d):
    return notated(spark, d).select("doc_id", T.score_simple(F.col("text")).alias("y"))


@query("kw_score_demo", f"WITH {NOTE} SELECT doc_id, CAST({_hits(T.DEMO[0])} * 3 + {_hits(T.DEMO[1])} + {_hits(T.DEMO[2])} * 2 + len({_variants(T.VARIANTS_DEMO)}) * 2 AS INTEGER) y FROM note")
def kw_score_demo(spark, d):
    return notated(spark, d).select("doc_id", T.score_demo(F.col("text")).alias("y"))


@query("kw_score_full", f"WITH {NOTE} SELECT doc_id, CAST({_hits(T.FULL[0])} * 3 + {_hits(T.FULL[1])} + {_hits(T.FULL[2])} * 2 + {_hits(T.FULL[3])} + len({_variants(T.VARIANTS_FULL)}) * 2 + len({_FOUND}) AS INTEGER) y FROM note")
def kw_score_full(spark, d):
    return notated(spark, d).select("doc_id", T.score_full(F.col("text")).alias("y"))


@query("kw_variants", f"WITH {NOTE} SELECT doc_id, array_to_string({_variants(T.VARIANTS_FULL)}, '|') y FROM note")
def kw_variants(spark, d):
    return notated(spark, d).select("doc_id", joined(T.variants(F.col("text"))).alias("y"))


@query("kw_genes", f"WITH {NOTE} SELECT doc_id, array_to_string({_FOUND}, '|') y FROM note")
def kw_genes(spark, d):
    return notated(spark, d).select("doc_id", joined(T.genes(F.col("text"))).alias("y"))


@query("chunk_fixed", "WITH k AS (SELECT doc_id, \"text\", unnest(range(CAST(ceil(length(\"text\") / 2500.0) AS BIGINT))) i FROM documents) SELECT doc_id, CAST(i AS INTEGER) i, md5(substr(\"text\", i * 2500 + 1, 2500)) y FROM k")
def chunk_fixed(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.fixed_chunks(F.col("text"), 2500)).alias("i", "c")).select("doc_id", "i", F.md5("c").alias("y"))


@query("chunk_overlap", r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array("text", '[ \n\t]+'), lambda z: z <> '') w FROM documents), k AS (SELECT doc_id, w, unnest(range(greatest(1, CAST(ceil((len(w) - 50) / 250.0) AS BIGINT)))) i FROM w)
  SELECT doc_id, CAST(i AS INTEGER) i, md5(array_to_string(w[i * 250 + 1 : i * 250 + 300], ' ')) y FROM k""")
def chunk_overlap(spark, d):
    w = F.filter(F.split("text", r"[ \n\t]+"), lambda x: x != "")
    return table(spark, d, "documents").select("doc_id", w.alias("w")).select("doc_id", F.posexplode(T.overlapping_chunks(F.col("w"), 300, 50)).alias("i", "c")).select("doc_id", "i", F.md5("c").alias("y"))


@query("pack_greedy")
def pack_greedy(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q")))), lambda x: x["q"]).alias("q"))
    return lines.select("l_suppkey", joined(T.packed(F.col("q"), 100), ",").alias("y"))


_WORDS = r"regexp_extract_all(\"text\", '[\p{L}\p{N}_]+')".replace('\\"', '"')


@query("context_window", f"WITH w AS (SELECT doc_id, {_WORDS} w FROM documents), p AS (SELECT doc_id, w, list_position(w, 'the') i FROM w) SELECT doc_id, CASE WHEN i > 0 THEN array_to_string(w[greatest(1, i - 5) : i + 5], ' ') ELSE 'Fragment not found' END y FROM p")
def context_window(spark, d):
    return table(spark, d, "documents").select("doc_id", T.context_window(F.col("text"), F.lit("the"), 5).alias("y"))


@query("word_count", f"SELECT doc_id, CAST(len({_WORDS}) AS INTEGER) y FROM documents")
def word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("y"))


@query("sentence_context", r"""WITH s AS (SELECT doc_id, list_transform(regexp_split_to_array("text", '\.\s+'), lambda z: trim(z)) s FROM documents), p AS (SELECT doc_id, s, list_position(list_transform(s, lambda z: contains(z, 'that')), true) i FROM s)
  SELECT doc_id, CASE WHEN i > 0 THEN array_to_string(s[greatest(1, i - 2) : i + 2], '. ') END y FROM p""")
def sentence_context(spark, d):
    return table(spark, d, "documents").select("doc_id", T.sentence_context(F.col("text"), F.lit("that"), 2).alias("y"))


_CITE = "CASE event_id % 3 WHEN 0 THEN concat('Smith', user_id, ' et al. (', 1990 + event_id % 30, ')') WHEN 1 THEN 'Personal note' ELSE concat('Lee et al. ', 1990 + event_id % 30) END"


@query("citation_query", rf"""WITH m AS (SELECT event_id, 'FOX-' || user_id g, {_CITE} x FROM events) SELECT event_id, array_to_string(list_filter([regexp_replace(g, '[^A-Za-z0-9]', '', 'g'), trim(regexp_extract(x, '^(.*?)\s+et al\.', 1)), regexp_extract(x, '(\d{{4}})\)?\s*$', 1)], lambda z: z <> ''), ' AND ') y FROM m""")
def citation_query(spark, d):
    return table(spark, d, "events").select("event_id", T.citation_query(F.concat(F.lit("FOX-"), "user_id"), F.expr(_CITE)).alias("y"))


@query("row_to_strings", "SELECT c_custkey, concat('c_custkey: ', c_custkey, '; c_name: ', c_name, '; segment: ', coalesce(CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END, 'None')) y FROM customer")
def row_to_strings(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).alias("segment"))
    return c.select("c_custkey", joined(T.row_strings(["c_custkey", "c_name", "segment"]), "; ").alias("y"))


@query("label_found", "WITH m AS (SELECT event_id, concat('p.p', CASE WHEN event_id % 2 = 0 THEN 'Arg' ELSE '' END, user_id) l, concat('has Arg', user_id) t FROM events) SELECT event_id, ltrim(l, 'p.') y, contains(t, ltrim(l, 'p.')) \"found\" FROM m")
def label_found(spark, d):
    m = table(spark, d, "events").select("event_id", F.expr("concat('p.p', CASE WHEN event_id % 2 = 0 THEN 'Arg' ELSE '' END, user_id)").alias("l"), F.expr("concat('has Arg', user_id)").alias("t"))
    return m.withColumn("y", T.stripped_label(F.col("l"))).select("event_id", "y", F.contains("t", F.col("y")).alias("found"))


@query("id_rewrite", "SELECT event_id, replace(concat('var@#rs', event_id, '#', user_id), '#', '%23') url, split_part(concat('var@rs', event_id, '##', user_id), '@', 2) id FROM events")
def id_rewrite(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.replace(F.expr("concat('var@#rs', event_id, '#', user_id)"), F.lit("#"), F.lit("%23")).alias("url"), F.split_part(F.expr("concat('var@rs', event_id, '##', user_id)"), F.lit("@"), F.lit(2)).alias("id"))


@query("reward", "SELECT event_id, CASE WHEN list_contains(['click', 'view'], event_type) = (value > 10) THEN 1 ELSE -1 END y FROM events")
def reward(spark, d):
    return table(spark, d, "events").select("event_id", T.reward(F.array(F.lit("click"), F.lit("view")), F.col("event_type"), F.col("value") > 10).alias("y"))


@query("dpo_pairs", "SELECT event_id, CASE WHEN value > 10 THEN event_type ELSE 'none' END chosen, CASE WHEN value > 10 THEN 'none' ELSE event_type END rejected FROM events")
def dpo_pairs(spark, d):
    found = F.col("value") > 10
    return table(spark, d, "events").select("event_id", F.when(found, F.col("event_type")).otherwise("none").alias("chosen"), F.when(found, "none").otherwise(F.col("event_type")).alias("rejected"))


_HGVS = r"^(?:[A-Z0-9]+:)?[cgmnpr]\.(?:[A-Z][a-z]{2})?[0-9]+(?:_[0-9]+)?(?:[ACGT]>[ACGT]|del|dup|ins[ACGT]+|[A-Z][a-z]{2})"
_f, _c = made("m", _VT, _VT)
scalar("hgvs_match", _f, _c, lambda x: x.rlike(_HGVS), f"regexp_matches(x, '{_HGVS}')")


@query("prompt_render", "SELECT event_id, concat('Variant: ', event_type, chr(10), 'Entities:', chr(10), '- u', user_id, chr(10), '- k', chr(10), 'Passage: ', props) y FROM events")
def prompt_render(spark, d):
    return table(spark, d, "events").select("event_id", T.prompt(F.col("event_type"), F.array(F.concat(F.lit("u"), "user_id"), F.lit("k")), F.col("props")).alias("y"))


@query("cache_key", "SELECT event_id, md5(concat_ws(':', event_type, user_id, props)) y FROM events")
def cache_key(spark, d):
    return table(spark, d, "events").select("event_id", cache.key_of("event_type", F.col("user_id").cast("string"), "props").alias("y"))


@query("ner_clean", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN concat(event_type, '|x', user_id) ELSE concat('x', user_id) END y FROM events")
def ner_clean(spark, d):
    tokens = F.array(F.concat(F.lit("##"), "event_type"), F.lit("skip"), F.concat(F.lit("▁x"), "user_id"))
    labels = F.array(F.when(F.col("event_id") % 2 == 0, "B-GENE").otherwise("O"), F.lit("O"), F.lit("I-GENE"))
    return table(spark, d, "events").select("event_id", tokens.alias("t"), labels.alias("l")).select("event_id", joined(T.label_tokens(F.col("t"), F.col("l"))).alias("y"))


def _names(spark, d):
    """All pairs of distinct names."""
    a = table(spark, d, "part").select(F.col("p_name").alias("a")).distinct()
    return a.crossJoin(a.select(F.col("a").alias("b")))  # every pair is a row of the result


for _n, _fn in (("text_ratio", text_ratio), ("text_similar", text_similar), ("text_similar_rules", text_similar_rules)):
    query(_n)(lambda spark, d, fn=_fn: _names(spark, d).select("a", "b", fn("a", "b").alias("y")))


def _all_names(spark, d):
    """Names of parts, their types and brands, nations and regions, as a and as b."""
    from functools import reduce

    of = lambda t, c: table(spark, d, t).select(F.col(c).alias("a"))
    a = reduce(lambda x, y: x.unionByName(y), [of("part", "p_name"), of("part", "p_type"), of("part", "p_brand"), of("nation", "n_name"), of("region", "r_name")])
    return a, a.withColumnRenamed("a", "b")


@query("similar_names")
def similar_names(spark, d):
    """All pairs of different spellings with their ratio, found by a join on rare characters."""
    return similar.similar(*_all_names(spark, d)).select("a", "b", F.round("ratio", 6).alias("ratio"))


@query("similar_names_by_rules")
def similar_names_by_rules(spark, d):
    return similar.similar_by_rules(*_all_names(spark, d))


_JSON = """concat('Answer: {"a": ', event_id, CASE WHEN event_id % 3 = 0 THEN ', }' ELSE ' }' END, ' done')"""
_f, _c = made("m", _JSON, _JSON)
scalar("json_slice", _f, _c, J.sliced, r"CASE WHEN regexp_extract(x, '(?s)(\{.*\})', 1) = '' THEN '{}' ELSE regexp_extract(x, '(?s)(\{.*\})', 1) END")
scalar("json_trailing_commas", _f, _c, J.no_trailing_commas, r"regexp_replace(x, ',(\s*[}\]])', '\1', 'g')")
_MISS = """concat('{"a": ', event_id, ' "b": "', event_type, '" "c": 1}')"""
_f, _c = made("m", _MISS, _MISS)
scalar("json_missing_commas", _f, _c, J.missing_commas, r"""regexp_replace(x, '(["}\d])\s+(")', '\1, \2', 'g')""")
_BARE = "concat('{a: ', event_id, ', b_1 : 2}')"
_f, _c = made("m", _BARE, _BARE)
scalar("json_quote_keys", _f, _c, J.quoted_keys, r"""regexp_replace(x, '([{,])\s*([a-zA-Z0-9_]+)\s*:', '\1 "\2":', 'g')""")
_QUO = """concat('{', chr(39), 'a', chr(39), ': "it', chr(39), 's ', event_id, '"}')"""
_f, _c = made("m", _QUO, _QUO)
scalar("json_quotes", _f, _c, J.double_quotes, """concat('{"a": "it', chr(39), 's ', event_id, '"}')""")
_BAD = """concat('Sure: {relationships: [{"entity_text": "', event_type, '" "relationship_score": ', user_id % 11, ', "has_relationship": true,}', CASE WHEN event_id % 5 = 0 THEN '' ELSE ']}' END)"""


@query("json_repair", f"WITH m AS (SELECT event_id FROM events) SELECT event_id, event_id % 5 <> 0 y FROM m")
def json_repair(spark, d):
    return table(spark, d, "events").select("event_id", J.valid(J.repaired(F.expr(_BAD))).alias("y"))


@query("json_relationships", "SELECT event_id, CAST(CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS INTEGER) n, CASE WHEN event_id % 5 <> 0 THEN event_type END entity, CASE WHEN event_id % 5 <> 0 THEN CAST(user_id % 11 AS INTEGER) END score FROM events")
def json_relationships(spark, d):
    r = table(spark, d, "events").select("event_id", J.relationships(F.expr(_BAD)).alias("r"))
    first = F.get("r", F.lit(0))
    return r.select("event_id", F.size("r").alias("n"), first["entity_text"].alias("entity"), first["relationship_score"].alias("score"))


@query("json_path", "SELECT event_id, CAST(props ->> '$.k' AS INTEGER) y FROM events")
def json_path(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("y"))


@query("html_title", r"SELECT page_id, regexp_extract(html, '(?s)<title(?:\s[^>]*)?>(.*?)</title>', 1) y FROM pages")
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", X.tag(F.col("html"), "title").alias("y"))


_ART = "concat('<a><Author><ForeName>F', p_partkey, '</ForeName><LastName>', p_brand, '</LastName></Author><Author><ForeName>G</ForeName><LastName>', p_type, '</LastName></Author><Year>', 1980 + p_partkey % 60, '</Year><body>x <b>', p_name, '</b> tail</body></a>')"


@query("xml_authors", "SELECT p_partkey, concat('F', p_partkey, ' ', p_brand, '; G ', p_type) y FROM part")
def xml_authors(spark, d):
    return table(spark, d, "part").withColumn("x", F.expr(_ART)).select("p_partkey", X.authors("x").alias("y"))


@query("xml_year_range", "SELECT p_partkey, CAST(CASE WHEN 1980 + p_partkey % 60 BETWEEN 1990 AND 2025 THEN 1980 + p_partkey % 60 END AS INTEGER) y FROM part")
def xml_year_range(spark, d):
    return table(spark, d, "part").select("p_partkey", X.year_between(F.expr(_ART)).alias("y"))


@query("xml_body_text", "SELECT p_partkey, concat('x ', p_name, ' tail') y FROM part")
def xml_body_text(spark, d):
    return table(spark, d, "part").withColumn("x", F.expr(_ART)).select("p_partkey", X.body_text("x").alias("y"))


@query("kb_xml_genes", "SELECT p_partkey, concat(p_brand, '; ', p_type) y FROM part")
def kb_xml_genes(spark, d):
    x = F.expr("concat('<r><Gene Symbol=\"', p_brand, '\"/><Gene Symbol=\"', p_type, '\"/></r>')")
    return table(spark, d, "part").withColumn("x", x).select("p_partkey", joined(F.xpath("x", F.lit("//Gene/@Symbol")), "; ").alias("y"))


@query("pub_context", "SELECT conv_id, max(\"text\") FILTER (WHERE role = 'user') title, max(\"text\") FILTER (WHERE role = 'assistant') abstract, count(*) n FROM conversations GROUP BY conv_id")
def pub_context(spark, d):
    by = lambda r: F.max(F.when(F.col("role") == r, F.col("text")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(by("user").alias("title"), by("assistant").alias("abstract"), F.count("*").alias("n"))


@query("fulltext_fallback", "SELECT d.doc_id, coalesce(nullif(CASE WHEN d.doc_id % 3 > 0 THEN d.\"text\" END, ''), nullif(b.\"text\", ''), '') y FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def fulltext_fallback(spark, d):
    docs, items = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", F.col("text").alias("abstract"))
    full = F.when(F.col("doc_id") % 3 > 0, F.col("text"))
    return docs.join(items, docs["doc_id"] == items["item_id"], "left").select("doc_id", F.coalesce(F.nullif(full, F.lit("")), F.nullif("abstract", F.lit("")), F.lit("")).alias("y"))


@query("model_from_file", "SELECT event_type, CASE WHEN contains(event_type, 'i') THEN 'mini' ELSE 'base' END model, count(*) n FROM events GROUP BY ALL")
def model_from_file(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.when(F.contains("event_type", F.lit("i")), "mini").otherwise("base").alias("model")).agg(F.count("*").alias("n"))
