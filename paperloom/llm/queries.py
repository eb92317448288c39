"""The corpus operators' queries: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import chat_format, decontaminate, filter_audit, html_text, language_model, mixing, ngram_join, oracles, pii, quality, secrets, sharding, spelling, url_filter
from paperloom.llm.common import table

#: Three racks of four shards in each of two regions.
SHARDS = sharding.Topology.uniform(2, 3, 4)
LEARNING = quality.Learning()
#: Language weights; domains and sources weigh the same. Four fifths of all tokens, up to two epochs of a source.
MIX = mixing.Plan(share=0.8, max_epochs=2, seed=17, weights={("lang", "en"): 6.0, ("lang", "de"): 1.5, ("lang", "fr"): 1.5, ("lang", "es"): 1.0})


def domain() -> Column:
    """The tables have no domain; sources are dealt to four by their number, those without one to the first."""
    number = F.coalesce(F.nullif(F.regexp_extract("source", "([0-9]{1,9})$", 1), F.lit("")).cast("int"), F.lit(0))
    return F.concat(F.lit("d"), F.pmod(number, F.lit(4)).cast("string"))


URL_RULES = [
    url_filter.Rule("block", "net", "/"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
]


def op1_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op3_block_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_disclosure_sanitiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.counts(pii.find(table(spark, sf_dir, "documents")))


def op6_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class")


def op7_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return got.select("doc_id", "n_words", "n_hit", "n_items", items, "contaminated", "n_near")


def op9_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.find(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.learn(docs, table(spark, sf_dir, "labels"), LEARNING)
    return quality.apply(docs, rules).select("doc_id", *quality.STATS, "base_failed", "kept", "rule")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, MIX, domain()).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def op10_weighted_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = sharding.shard(docs, SHARDS, seed=11)
    return got.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


CHAT = chat_format.Template()
#: A conversation of which every text is full of control strings.
TRICKY = [(-1, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))]


def op11_event_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    log = chat_format.logged(turns.unionByName(spark.createDataFrame(TRICKY, "conv_id long, turn long, role string, text string")))
    return chat_format.digests(chat_format.rendered(chat_format.messages(log), CHAT), CHAT)


#: Conditions under which a document fails the filters A to D; E is that it repeats the text of a smaller doc_id.
FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 3 * n_chars",
    "D": "n_symbols > 0",
}


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fails = {name: F.expr(rule) for name, rule in FILTERS.items()}
    counts = filter_audit.masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fails, duplicates="E")
    return filter_audit.audit(counts, "".join(FILTERS) + "E")


def op13_pigeonhole_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(table(spark, sf_dir, "documents"), least=5, count=3, ratio=2, slip=spelling.slipped)


QUERIES = {
    "op5_quality_rules": op5_quality_rules,
    "op1_url_trie": op1_url_trie,
    "op2_context_mixing": op2_context_mixing,
    "op3_block_tree": op3_block_tree,
    "op4_disclosure_sanitiser": op4_disclosure_sanitiser,
    "op6_signature_tree_join": op6_signature_tree_join,
    "op7_positional_index": op7_positional_index,
    "op9_randomness_battery": op9_randomness_battery,
    "op8_source_mixing": op8_source_mixing,
    "op10_weighted_hash_tree": op10_weighted_hash_tree,
    "op11_event_fold": op11_event_fold,
    "op12_filter_audit": op12_filter_audit,
    "op13_pigeonhole_variants": op13_pigeonhole_variants,
}

#: DuckDB SQL by query name. The others have parts that are learned or drawn, or that SQL lacks; tests hold those against brute force.
ORACLES = {
    "op1_url_trie": oracles.URL,
    "op7_positional_index": oracles.CONTAMINATION,
    "op11_event_fold": oracles.chat(CHAT.start, CHAT.end, CHAT.controls, "assistant", TRICKY),
    "op12_filter_audit": oracles.AUDIT,
    "op13_pigeonhole_variants": oracles.SPELLING,
    "op8_source_mixing": oracles.mixing(MIX.share, MIX.max_epochs, MIX.seed, {name: w for (level, name), w in MIX.weights.items()}),
}
