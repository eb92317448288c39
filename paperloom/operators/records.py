"""Record-level operators: scored relationships as rows, unions with origin, coordinates with lookups, knowledge-base records, expiring caches."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import xml as X

# Well-known variants by rs number (chromosome, position), and genes by id (chromosome, start).
RS_POSITIONS = {
    "642961": ("chr1", 209989270), "2435357": ("chr10", 43582014), "121918697": ("chr7", 91855888), "2596623": ("chr7", 91921468),
    "2596622": ("chr7", 91921595), "73346254": ("chr8", 37992287), "4498267": ("chr8", 37995632), "4431364": ("chr8", 37996942),
}
GENE_STARTS = {"54139": ("chr1", 209979239), "5979": ("chr10", 43077069), "7068": ("chr7", 91851332), "5626": ("chr8", 37991945)}
ENTITIES = ("gene", "disease", "tissue", "species", "chemical")


def lookup(spark: SparkSession, known: dict[str, tuple[str, int]]) -> DataFrame:
    """_key, _chr, _at: a table of known places, to be broadcast; it is as small as the code that holds it."""
    return spark.createDataFrame([(k, c, p) for k, (c, p) in known.items()], "_key string, _chr string, _at long")


def with_coordinates(df: DataFrame, variant: str, rs: DataFrame | None = None, genes: DataFrame | None = None) -> DataFrame:
    """Adds chr, start, end of a variant's identifier, null where nothing is known.

    In order: a genomic HGVS name, a coding range relative to its gene, a region, an rs number, and substitutions, which are
    placed at their gene's start. ``rs`` and ``genes`` are tables of known places like ``lookup``'s.
    """
    spark = df.sparkSession
    rs = lookup(spark, RS_POSITIONS) if rs is None else rs
    genes = lookup(spark, GENE_STARTS) if genes is None else genes
    part = lambda pattern, i: F.nullif(F.regexp_extract(variant, pattern, i), F.lit(""))
    place = lambda c, a, b: F.when(c.isNotNull() & a.isNotNull(), F.struct(c.alias("chr"), a.cast("long").alias("start"), b.cast("long").alias("end")))
    g = F.broadcast(genes.select(F.col("_key").alias("_gene"), F.col("_chr").alias("_gchr"), F.col("_at").alias("_gat")))
    r = F.broadcast(rs.select(F.col("_key").alias("_rs"), F.col("_chr").alias("_rchr"), F.col("_at").alias("_rat")))
    met = df.withColumn("_g", part(r"CorrespondingGene:(\d+)", 1)).withColumn("_r", part(r"[rR][sS][#:]?(\d+)", 1))
    met = met.join(g, F.col("_g") == F.col("_gene"), "left").join(r, F.col("_r") == F.col("_rs"), "left")
    genomic, coding, region = r"NC_0+(\d+)[\w.:>]*?[.](\d+)[ACGT]>[ACGT]", r"c\.(\d+)_(\d+)[ACGT]>[ACGT]", r"(?:chr)?(\d+|X|Y):(\d+)(?:-(\d+))?"
    found = F.coalesce(
        place(F.concat(F.lit("chr"), part(genomic, 1)), part(genomic, 2), part(genomic, 2)),
        place(F.col("_gchr"), F.col("_gat") + part(coding, 1).cast("long"), F.col("_gat") + part(coding, 2).cast("long")),
        place(F.concat(F.lit("chr"), part(region, 1)), part(region, 2), F.coalesce(part(region, 3), part(region, 2))),
        place(F.col("_rchr"), F.col("_rat"), F.col("_rat")),
        F.when(F.rlike(variant, F.lit(r"c\|SUB\|[ACGT]\|\|[ACGT]|p\|SUB\|[A-Z]\|\d+\|[A-Z]")), place(F.col("_gchr"), F.col("_gat"), F.col("_gat"))),
    )
    return met.withColumn("_found", found).select(*df.columns, "_found.chr", "_found.start", "_found.end")


def entity_rows(rels: DataFrame, base: list[str]) -> DataFrame:
    """One row for each entity of a relationship with only its own category's columns filled, and one with none for those without.

    ``rels``: the base columns and for each category an array of (text, id, explanation, score) under its name.
    """
    def told(kind: str) -> Column:
        return F.transform(
            F.coalesce(kind, F.array()),
            lambda e: F.struct(F.lit(kind).alias("kind"), e["text"].alias("text"), e["id"].alias("id"), e["explanation"].alias("explanation"), F.coalesce(e["score"], F.lit(0)).alias("score")),
        )

    each = F.concat(*[told(c) for c in ENTITIES])
    rows = rels.select(*base, F.explode_outer(each).alias("_e"))
    fill = lambda c, f: F.when(F.col("_e.kind") == c, F.col(f"_e.{f}"))
    return rows.select(*base, *[fill(c, f).alias(c if f == "text" else f"{c}_{f}") for c in ENTITIES for f in ("text", "id", "explanation", "score")])


def union_with(parts: dict[str, DataFrame], column: str) -> DataFrame:
    """All rows of all parts, with the part's name in ``column``; what a part lacks is null."""
    out = None
    for name, df in parts.items():
        df = df.withColumn(column, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def of_types(ann: DataFrame, types: list[str]) -> DataFrame:
    """Annotations of the types given, in any case."""
    return ann.where(F.lower("type").isin([t.lower() for t in types]))


# Element names of a knowledge-base record in XML, in its full form and in a short one.
_TRAITS = "ARRAY<STRUCT<Name: ARRAY<STRUCT<_VALUE: STRING, ElementValue: ARRAY<STRUCT<_VALUE: STRING>>>>, XRef: ARRAY<STRUCT<_DB: STRING, _ID: STRING>>>>"
_PLACES = "ARRAY<STRUCT<_Assembly: STRING, _Chr: STRING, _start: STRING, _stop: STRING>>"
_ASSERTION = (
    "STRUCT<ClinicalSignificance: STRUCT<Description: STRING>, "
    f"MeasureSet: STRUCT<Measure: ARRAY<STRUCT<MeasureRelationship: ARRAY<STRUCT<Symbol: STRUCT<ElementValue: STRUCT<_VALUE: STRING>>>>, SequenceLocation: {_PLACES}>>>, TraitSet: STRUCT<Trait: {_TRAITS}>>"
)
KB_XML = (
    f"Classification STRUCT<Description: STRING>, Gene ARRAY<STRUCT<_Symbol: STRING>>, Trait {_TRAITS}, SequenceLocation {_PLACES}, "
    f"ReferenceClinVarAssertion {_ASSERTION}, ClinVarSet STRUCT<ReferenceClinVarAssertion: {_ASSERTION}>"
)


def kb_from_xml(df: DataFrame, xml: str) -> DataFrame:
    """Adds significance, genes, traits (name, and OMIM number or null), phenotypes (the traits with an OMIM number), places (assembly,
    chromosome, start, stop) and ``broken`` of a record.

    A trait's name and number, and a place's parts, come out of one element, so a missing part is null and shifts nothing. A record
    that is no XML has ``broken``, no lists' entries and the default significance; a null one is no broken one.
    """
    r = F.col("_r")
    full = F.coalesce(r["ClinVarSet"]["ReferenceClinVarAssertion"], r["ReferenceClinVarAssertion"])
    measures = full["MeasureSet"]["Measure"]
    some = lambda *lists: F.filter(F.flatten(F.array(*[F.coalesce(x, F.array()) for x in lists])), lambda x: x.isNotNull())
    genes = some(F.transform(r["Gene"], lambda g: g["_Symbol"]), F.transform(F.flatten(F.transform(measures, lambda m: F.coalesce(m["MeasureRelationship"], F.array()))), lambda g: g["Symbol"]["ElementValue"]["_VALUE"]))
    name = lambda t: F.coalesce(F.get(t["Name"], F.lit(0))["_VALUE"], F.get(F.get(t["Name"], F.lit(0))["ElementValue"], F.lit(0))["_VALUE"])
    omim = lambda t: F.get(F.filter(t["XRef"], lambda x: x["_DB"] == "OMIM"), F.lit(0))["_ID"]
    traits = F.transform(some(r["Trait"], full["TraitSet"]["Trait"]), lambda t: F.struct(name(t).alias("name"), omim(t).alias("omim")))
    places = some(r["SequenceLocation"], F.flatten(F.transform(measures, lambda m: F.coalesce(m["SequenceLocation"], F.array()))))
    significance = F.coalesce(F.nullif(F.coalesce(r["Classification"]["Description"], full["ClinicalSignificance"]["Description"]), F.lit("")), F.lit("Not provided"))
    got = df.withColumn("_r", X.record(xml, KB_XML)).select(
        *[c for c in df.columns if c not in ("significance", "genes", "traits", "places", "broken", "phenotypes")], significance.alias("significance"), genes.alias("genes"),
        F.filter(traits, lambda t: t["name"].isNotNull() | t["omim"].isNotNull()).alias("traits"),
        F.transform(places, lambda p: F.struct(p["_Assembly"].alias("assembly"), p["_Chr"].alias("chr"), p["_start"].alias("start"), p["_stop"].alias("stop"))).alias("places"),
        (F.col(xml).isNotNull() & r.isNull()).alias("broken"),
    )
    return got.withColumn("phenotypes", F.filter("traits", lambda t: t["omim"].isNotNull()))


def significance(df: DataFrame, xml: str) -> DataFrame:
    """Adds classification, review_status and last_evaluated of a record, null where they are missing."""
    of = lambda name: X.first_text(xml, f"(//ClinicalSignificance)[1]/{name}")
    return df.withColumns({"classification": of("Description"), "review_status": of("ReviewStatus"), "last_evaluated": of("DateLastEvaluated")})


def variant_details(df: DataFrame, xml: str) -> DataFrame:
    """Adds name, type, gene_symbol, gene_name and hgvs (a list) of a record; null or empty where they are missing."""
    of = lambda path: X.first_text(xml, path)
    return df.withColumns({
        "name": F.coalesce(of("//Alleles/Name"), of("//Alleles/n")), "type": of("//VariantType"), "gene_symbol": of("//Gene/Symbol"), "gene_name": of("//Gene/FullName"),
        "hgvs": X.first_texts(xml, "//HGVS/Expression"),
    })


KB_JSON = (
    "STRUCT<uid: STRING, title: STRING, germline_classification: STRUCT<description: STRING>, genes: ARRAY<STRUCT<symbol: STRING, geneid: STRING>>, "
    "trait_set: ARRAY<STRUCT<trait_name: STRING>>, variation_set: ARRAY<STRUCT<variation_loc: ARRAY<STRUCT<assembly_name: STRING, chr: STRING, start: STRING, stop: STRING>>>>>"
)


def kb_from_json(df: DataFrame, text: str) -> DataFrame:
    """Adds kb_id, name, significance, genes, phenotypes and places of a record in JSON; all null or empty for a broken one."""
    r = F.from_json(text, KB_JSON)
    at = F.flatten(F.transform(F.coalesce(r["variation_set"], F.array()), lambda v: v["variation_loc"]))
    return df.select(
        "*", r["uid"].alias("kb_id"), r["title"].alias("name"), F.coalesce(r["germline_classification"]["description"], F.lit("Not provided")).alias("significance"),
        F.coalesce(F.transform(r["genes"], lambda g: g["symbol"]), F.array()).alias("genes"), F.coalesce(F.transform(r["trait_set"], lambda t: t["trait_name"]), F.array()).alias("phenotypes"),
        at.alias("places"),
    )


def article(df: DataFrame, xml: str) -> DataFrame:
    """Adds title, authors, journal, date and abstract of an article, each ``N/A`` where it is missing or the article is no XML."""
    some = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("N/A"))
    first = lambda path: F.coalesce(F.get(X.texts(xml, path), F.lit(0)), F.lit(""))
    return df.select(
        "*", some(first("//ArticleTitle/text()")).alias("title"), some(X.authors(xml)).alias("authors"), some(first("//Journal/Title/text()")).alias("journal"),
        some(F.concat_ws("-", X.texts(xml, "//PubDate/*/text()"))).alias("date"), some(F.array_join(X.texts(xml, "//AbstractText/text()"), " ")).alias("abstract"),
    )


def abstract_text(xml: str) -> Column:
    """Title and abstract, joined by a blank; empty if there is neither."""
    return F.trim(F.array_join(F.concat(X.texts(xml, "//ArticleTitle/text()"), X.texts(xml, "//AbstractText/text()")), " "))


def cache_entries(df: DataFrame, entry: str, schema: str, ttl: float, now: Column) -> DataFrame:
    """Cache files as rows: ``value`` of entries ``{"time": seconds, "value": ...}``, and ``state``: hit, expired or corrupt (a miss)."""
    got = F.from_json(entry, f"STRUCT<time: DOUBLE, value: {schema}>")
    broken = got["time"].isNull() | got["value"].isNull()
    state = F.when(broken, "corrupt").when(got["time"] + ttl <= now, "expired").otherwise("hit")
    return df.withColumn("state", state).withColumn("value", F.when(F.col("state") == "hit", got["value"]))


def retried(call: Callable, times: int = 3, wait: float = 1.0, growing: bool = False, sleep: Callable[[float], None] = time.sleep, on: tuple[type[Exception], ...] = (OSError,)):
    """``call()``, again after a failure of the kinds ``on`` (of the network and of files), ``times`` times in all; it waits as long each time, or
    longer each time with ``growing``. Other errors would come again, and go up at once."""
    for n in range(1, times + 1):
        try:
            return call()
        except on:
            if n == times:
                raise
            sleep(wait * n if growing else wait)


def ids_checked(ids: DataFrame, column: str) -> DataFrame:
    """The ids as they are; the job fails if there are none or one isn't a natural number."""
    wrong = F.concat(F.lit("no natural number: "), F.coalesce(column, F.lit("null")))
    checked = ids.withColumn(column, F.when(F.coalesce(F.col(column).rlike("^[0-9]+$"), F.lit(False)), F.col(column)).otherwise(F.raise_error(wrong)))
    if ids.isEmpty():
        raise ValueError("the list of ids is empty")
    return checked


def kb_by_id(ids: DataFrame, answers: DataFrame) -> DataFrame:
    """kb_id, name, significance, genes, phenotypes, source of each id: from its answer (kb_id, answer) read as XML, else as JSON, else a
    stub that names the id only. ``source`` is xml, json or stub."""
    as_xml = kb_from_xml(answers.select("kb_id", "answer"), "answer")
    read = as_xml.select(
        "kb_id", "answer", "broken", F.col("significance").alias("_xs"), F.col("genes").alias("_xg"), F.transform("traits", lambda t: t["name"]).alias("_xp"), F.from_json("answer", KB_JSON).alias("_j")
    )
    j = F.col("_j")
    is_xml, is_json = ~F.col("broken") & F.col("answer").isNotNull(), j.isNotNull() & j["uid"].isNotNull()
    met = ids.select("kb_id").distinct().join(read, "kb_id", "left")
    source = F.when(is_xml, "xml").when(is_json, "json").otherwise("stub")
    pick = lambda x, y, other: F.when(F.col("source") == "xml", x).when(F.col("source") == "json", y).otherwise(other)
    none = F.array().cast("array<string>")
    return met.withColumn("source", F.coalesce(source, F.lit("stub"))).select(
        "kb_id", F.coalesce(F.when(F.col("source") == "json", j["title"]), F.concat(F.lit("Variant "), "kb_id")).alias("name"),
        F.coalesce(pick(F.col("_xs"), j["germline_classification"]["description"], F.lit(None)), F.lit("Not provided")).alias("significance"),
        F.coalesce(pick(F.col("_xg"), F.transform(j["genes"], lambda g: g["symbol"]), none), none).alias("genes"),
        F.coalesce(pick(F.col("_xp"), F.transform(j["trait_set"], lambda t: t["trait_name"]), none), none).alias("phenotypes"), "source",
    )


def kb_ids(kb: DataFrame, wanted: DataFrame, by: str) -> DataFrame:
    """value, kb_id: ids of the records with a wanted ``value``, by ``gene`` (any of the record's, whatever its case), ``rs`` (with or without
    the letters before the number) or ``notation`` (the name without blanks around it)."""
    number = lambda c: F.regexp_replace(F.lower(F.trim(c)), "^rs", "")
    how = {
        "gene": (lambda: kb.select("kb_id", F.explode("genes.symbol").alias("_v")).withColumn("_v", F.lower("_v")), F.lower("value")),
        "rs": (lambda: kb.select("kb_id", number(F.col("rs")).alias("_v")), number(F.col("value"))),
        "notation": (lambda: kb.select("kb_id", F.trim("name").alias("_v")), F.trim("value")),
    }
    if by not in how:
        raise ValueError(f"unknown kind {by!r}; gene, rs and notation are known")
    known, value = how[by]
    asked = wanted.select("value").where("trim(value) <> ''").distinct().withColumn("_v", value)
    return asked.join(known().where("_v <> ''").distinct(), "_v").select("value", "kb_id").distinct()


def publications_of(variants: DataFrame, links: DataFrame) -> DataFrame:
    """The variants (variant_id and further columns) with ``pmids`` and ``pmcids``, sorted lists without the publications (variant_id, pmid, pmcid) that lack an id."""
    each = links.groupBy("variant_id").agg(*[F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in ("pmid", "pmcid")])
    none = F.array().cast("array<string>")
    return variants.join(each, "variant_id", "left").select(*variants.columns, *[F.coalesce(c, none).alias(c) for c in ("pmids", "pmcids")])
