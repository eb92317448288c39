"""Text functions of the evidence engine as Spark columns: coordinates, identifiers, names, model answers, scores, chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The coordinate patterns, in the order in which they are tried.
COORDINATES = (
    r"[cm]\.[0-9]+[ACGT]+>[ACGT]+",
    r"[cm]\.(?:-)?[0-9]+(?:_(?:-)?[0-9]+)?(?:del|ins|dup|inv|con)[ACGT]*",
    r"[cm]\.[0-9]+(?:_[0-9]+)?[ACGT]+>[ACGT]+",
    r"chr[0-9XYM]+:[0-9]+-[0-9]+",
    r"[gm]\.[0-9]+[ACGT]>[ACGT]",
    r"p\.[A-Z][a-z]{2}[0-9]+(?:[A-Z][a-z]{2})?[^\s\.,]*",
)
# Variant patterns (any case) and gene patterns of the keyword scorers.
VARIANTS_DEMO = (r"\b[cgpn]\.\d+[ATCG]>[ATCG]\b", r"\b[cgpn]\.\d+del[ATCG]*\b", r"\brs\d+\b", r"\b[0-9]+[qp][0-9.]+\b")
VARIANTS_FULL = (
    r"\b[cgpn]\.\d+[ATCG]>[ATCG]\b", r"\b[cgpn]\.\d+del[ATCG]*\b", r"\b[cgpn]\.\d+ins[ATCG]+\b", r"\b[cgpn]\.\d+_\d+del\b", r"\brs\d+\b", r"\b[0-9]+[qp][0-9.]+\b",
)
GENES = (r"\bFOXF[12]\b", r"\bFOX[A-Z][0-9]+\b", r"\b[A-Z]{2,8}[0-9]*\b")
KNOWN_GENES = ("FOXF1", "FOXF2", "TP53", "BRCA1", "BRCA2", "EGFR", "MYC")
# The keywords of the three scorers (genes, diseases, variants, development).
SIMPLE = (
    ("FOXF1", "FOXF2", "alveolar capillary dysplasia", "lung development", "pulmonary", "vascular", "enhancer", "regulatory", "deletion", "mutation", "haploinsufficiency", "embryonic"),
    ("disease", "syndrome", "dysplasia", "malformation", "defect", "abnormality", "disorder"),
    ("mutation", "deletion", "variant", "polymorphism", "SNP", "CNV", "indel", "substitution"),
)
DEMO = (
    ("FOXF1", "FOXF2", "forkhead box F1", "alveolar capillary dysplasia", "lung development", "pulmonary", "vascular", "enhancer"),
    ("disease", "syndrome", "dysplasia", "malformation", "disorder"),
    ("mutation", "deletion", "variant", "polymorphism", "CNV"),
)
FULL = (
    ("FOXF1", "FOXF2", "forkhead box F1", "forkhead box F2", "alveolar capillary dysplasia", "ACD", "lung development", "pulmonary", "vascular", "enhancer", "regulatory", "haploinsufficiency", "embryonic", "mesenchymal"),
    ("disease", "syndrome", "dysplasia", "malformation", "defect", "abnormality", "disorder", "phenotype", "pathology", "clinical"),
    ("mutation", "deletion", "variant", "polymorphism", "SNP", "CNV", "indel", "substitution", "frameshift", "nonsense", "missense", "splice", "genomic"),
    ("development", "embryogenesis", "differentiation", "morphogenesis", "organogenesis", "pattern"),
)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row: a lambda's variable isn't written out wherever it stands."""
    return F.element_at(F.transform(F.array(value), body), 1)


def found(c: Column, patterns: tuple[str, ...], flags: str = "") -> Column:
    """All matches, pattern by pattern, each in the order of the text."""
    c = F.coalesce(c, F.lit(""))
    return F.concat(*[F.regexp_extract_all(c, F.lit(flags + p), F.lit(0)) for p in patterns])


def coordinates(c: Column) -> Column:
    """Distinct coordinates in the order in which they were found."""
    return F.array_distinct(found(c, COORDINATES))


def combined(*lists: Column) -> Column:
    """The lists one behind the other, each value once."""
    return F.array_distinct(F.concat(*lists))


def _hits(low: Column, keywords: tuple[str, ...]) -> Column:
    return sum((F.contains(low, F.lit(k.lower())).cast("int") for k in keywords[1:]), F.contains(low, F.lit(keywords[0].lower())).cast("int"))


def hits(c: Column, *keywords: tuple[str, ...], weights: tuple[int, ...] = (1,)) -> Column:
    """How many of each group of keywords occur, in any case, by the group's weight. The text goes to lower case once."""
    return bind(F.lower(F.coalesce(c, F.lit(""))), lambda low: sum((_hits(low, k) * w for k, w in zip(keywords, weights, strict=True)), F.lit(0)))


def variants(c: Column, patterns: tuple[str, ...] = VARIANTS_FULL) -> Column:
    return F.array_sort(F.array_distinct(found(c, patterns, "(?i)")))


def genes(c: Column) -> Column:
    keep = lambda g: F.upper(g).isin(*KNOWN_GENES) | F.contains(F.upper(g), F.lit("FOX"))
    return F.array_sort(F.array_distinct(F.filter(found(c, GENES), keep)))


def score_simple(c: Column) -> Column:
    return hits(c, *SIMPLE, weights=(2, 1, 1))


def score_demo(c: Column) -> Column:
    return hits(c, *DEMO, weights=(3, 1, 2)) + F.size(variants(c, VARIANTS_DEMO)) * 2


def score_full(c: Column) -> Column:
    return hits(c, *FULL, weights=(3, 1, 2, 1)) + F.size(variants(c)) * 2 + F.size(genes(c))


def parse_coordinates(c: Column) -> Column:
    """A model's comma-separated answer; empty if it says that there are none."""
    none = F.array().cast("array<string>")
    parts = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(c.isNull() | F.contains(c, F.lit("No coordinates found")), none).otherwise(parts)


def parse_lines(answer: Column, text: Column) -> Column:
    """A model's answer by lines: headings go, bullets and numbers are stripped, and what the text doesn't have is dropped; sorted."""
    none = F.array().cast("array<string>")
    lines = F.filter(F.split(answer, "\n"), lambda x: ~F.lower(x).rlike("coordinate|publication"))
    stripped = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^(?:- |(?:[1-9][0-9]?|100)\. )", "")))
    kept = F.filter(stripped, lambda x: (x != "") & F.contains(text, x))
    return F.when(F.trim(F.split_part(answer, F.lit("\n"), F.lit(1))) == "NONE", none).otherwise(F.array_sort(F.array_distinct(kept)))


def parse_variants(c: Column) -> Column:
    """A model's list of variants: split at commas, else numbered, else bulleted, else by lines; bare numbers go."""
    none = F.array().cast("array<string>")
    group = lambda p: F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(1)), lambda x: F.trim(x))
    split = lambda by: F.transform(F.split(c, by), lambda x: F.trim(x))
    numbered, bulleted = r"\d+\.\s*([^,\n]+)", r"[-*]\s*([^,\n]+)"
    got = F.when(F.contains(c, F.lit(",")), split(",")).when(c.rlike(numbered), group(numbered)).when(c.rlike(bulleted), group(bulleted)).otherwise(split("\n"))
    empty = c.isNull() | (F.trim(c) == "") | F.contains(F.lower(c), F.lit("no variant"))
    return F.when(empty, none).otherwise(F.filter(got, lambda x: (x != "") & ~x.rlike(r"^\d+\.?$")))


def parse_yes_no(c: Column) -> Column:
    """(found, value, reason) of a three-line answer; fewer lines mean no."""
    lines = F.split(c, "\n")
    whole = F.size(lines) >= 3
    at = lambda i: F.when(whole, F.trim(F.get(lines, F.lit(i)))).otherwise(F.lit(""))
    return F.struct((whole & F.startswith(F.get(lines, F.lit(0)), F.lit("YES"))).alias("found"), at(1).alias("value"), at(2).alias("reason"))


def norm_gene(c: Column) -> Column:
    """Upper case without the words that come before a symbol, one after the other."""
    out = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    for prefix in ("GEN ", "GENE ", "PROTEIN ", "BIAŁKO "):
        out = F.when(F.startswith(out, F.lit(prefix)), F.substring(out, len(prefix) + 1, 1 << 30)).otherwise(out)
    return out


def norm_disease(c: Column) -> Column:
    out = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\b(?:disease|syndrome)\b", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def norm_variant(c: Column) -> Column:
    """Without a space behind the prefix; amino acids in title case in protein notation, else bases in lower case."""
    out = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\b([cgp])\.\s+", "$1.")
    amino = r"^(.*?p\.)([A-Za-z][a-z]{2})(\d+)([a-z]{3}|)(.*)$"
    part = lambda i: F.regexp_extract(out, amino, i)
    protein = F.concat(part(1), F.initcap(part(2)), part(3), part(4), part(5))
    base = r"^(.*?)([ACGT]>[ACGT])(.*)$"
    piece = lambda i: F.regexp_extract(out, base, i)
    bases = F.concat(piece(1), F.lower(piece(2)), piece(3))
    return F.when(F.contains(out, F.lit("p.")), F.when(out.rlike(amino), protein).otherwise(out)).when(out.rlike(base), bases).otherwise(out)


def variant_type_hgvs(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    has = lambda x: F.contains(c, F.lit(x))
    return (
        F.when(has(">"), "SNV").when(has("del") & has("ins"), "Indel").when(has("del"), "Deletion").when(has("ins"), "Insertion").when(has("dup"), "Duplication").when(has("inv"), "Inversion")
        .when(c.rlike(r"p\.[A-Z][a-z]{2}\d+[A-Z][a-z]{2}"), "Substitution").when(c.rlike(r"^rs\d+$"), "SNP").otherwise("Unknown")
    )


def variant_type_id(text: Column, ident: Column) -> Column:
    low = F.lower(text)
    has = lambda c, *xs: F.greatest(*[F.contains(c, F.lit(x)) for x in xs]) if len(xs) > 1 else F.contains(c, F.lit(xs[0]))
    return (
        F.when(has(low, "deletion") | has(ident, ">del", "DEL"), "deletion").when(has(low, "insertion") | has(ident, ">ins", "INS"), "insertion").when(has(low, "duplication") | has(ident, "DUP"), "duplication")
        .when(has(low, "translocation") | has(text, "t("), "translocation").when(has(ident, "SUB", ">"), "substitution").otherwise("unknown")
    )


def variant_class(c: Column) -> Column:
    has = lambda x: F.contains(c, F.lit(x))
    return F.when(has("delins"), "delins").when(has("del"), "del").when(has("dup"), "dup").when(has("ins"), "ins").when(has(">"), "sub").otherwise("other")


def position(c: Column) -> Column:
    """(chr, start, end) of an identifier in HGVS or chr:position form; nulls if it has neither. Identifiers that need a
    table (rsIDs, positions relative to a gene) are joined with one instead."""
    hgvs = F.regexp_extract(c, r"HGVS:([\w.:>_]+)", 1)
    chromosome = F.regexp_extract(hgvs, r"NC_0+(\d+)", 1)
    place = F.regexp_extract(hgvs, r"\.(\d+)[ACGT]>[ACGT]", 1)
    free = r"(?:chr)?(\d+|X|Y):(\d+)(?:-(\d+))?"
    a, b = F.regexp_extract(c, free, 2), F.regexp_extract(c, free, 3)
    number = lambda x: F.nullif(x, F.lit("")).try_cast("long")
    whole = (chromosome != "") & (place != "")
    ranged = c.rlike(free)
    pick = lambda x, y: F.when(whole, x).when(ranged, y)
    return F.struct(
        pick(F.concat(F.lit("chr"), chromosome), F.concat(F.lit("chr"), F.regexp_extract(c, free, 1))).alias("chr"), pick(number(place), number(a)).alias("start"),
        pick(number(place), F.coalesce(number(b), number(a))).alias("end"),
    )


def hgvs(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, "HGVS:([^;]+)", 1), F.lit(""))


def variant_mode(explanation: Column) -> Column:
    low = F.lower(F.coalesce(explanation, F.lit("")))
    return F.when(F.contains(low, F.lit("enhancer")), "enhancer").when(F.contains(low, F.lit("loss of function")), "loss-of-function").when(F.contains(low, F.lit("gain of function")), "gain-of-function")


def rs_clean(c: Column) -> Column:
    return F.coalesce(F.regexp_substr(c, F.lit(r"rs\d+")), c)


def gene_tokens(c: Column) -> Column:
    got = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([A-Z0-9-]+)\s*(?:\(\d+\))?"), F.lit(1))
    return F.filter(got, lambda g: (F.length(g) >= 2) & ~g.rlike("^[0-9]+$"))


def disease_tokens(c: Column) -> Column:
    clean = lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s*\(MESH:[^)]*\)|MESH:\S+", "")))
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r";\s*"), clean), lambda x: x != "")


def pmid_tokens(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[;,]\s*"), lambda x: F.trim(x)), lambda x: x != "")


def pmid_cell(c: Column) -> Column:
    """PMIDs of a curated cell: what stands before the first bracket, at semicolons; null unless the cell begins with a digit."""
    parts = F.filter(F.transform(F.split(F.split_part(c, F.lit("("), F.lit(1)), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(c.rlike("^[0-9]"), parts)


def fixed_chunks(c: Column, size: int) -> Column:
    """Pieces of ``size`` characters, the last one shorter; none of an empty text."""
    n = F.ceil(F.length(c) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(c, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def overlapping_chunks(words: Column, size: int, overlap: int) -> Column:
    """Pieces of ``size`` words, each beginning ``size - overlap`` words after the one before."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.size(words) - overlap) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(words, i * step + 1, F.lit(size)), " "))


def packed(lengths: Column, most: int) -> Column:
    """The group number of each length, packed in order into groups of ``most`` in all; a longer one has a group of its own."""
    start = F.struct(F.lit(0).alias("group"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        full = (acc["used"] > 0) & (acc["used"] + x > most)
        group = acc["group"] + full.cast("int")
        return F.struct(group.alias("group"), F.when(full, x).otherwise(acc["used"] + x).cast("int").alias("used"), F.concat(acc["out"], F.array(group)).alias("out"))

    return F.aggregate(lengths, start, step)["out"]


def context_window(c: Column, fragment: Column, each: int) -> Column:
    """``each`` words on both sides of the first word of a text that equals the fragment; a message if there is none."""
    words = F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    at = F.array_position(words, fragment)
    start = F.greatest(F.lit(1), at - each).cast("int")
    return F.when(at > 0, F.array_join(F.slice(words, start, (at + each - start + 1).cast("int")), " ")).otherwise(F.lit("Fragment not found"))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}_]+"))


def sentence_context(c: Column, word: Column, each: int) -> Column:
    """The first sentence with the word and ``each`` sentences on both sides; null if there is none."""
    s = F.transform(F.split(c, r"\.\s+"), lambda x: F.trim(x))
    hit = F.filter(F.transform(s, lambda x, i: F.when(F.contains(x, word), i + 1)), lambda x: x.isNotNull())
    at = F.get(hit, F.lit(0))
    start = F.greatest(F.lit(1), at - each)
    return F.when(F.size(hit) > 0, F.array_join(F.slice(s, start, at + each - start + 1), ". "))


def citation_query(gene: Column, citation: Column) -> Column:
    """gene, first author and year of a citation, joined for a search; parts that are missing are left out."""
    parts = F.array(F.regexp_replace(gene, "[^A-Za-z0-9]", ""), F.trim(F.regexp_extract(citation, r"^(.*?)\s+et al\.", 1)), F.regexp_extract(citation, r"(\d{4})\)?\s*$", 1))
    return F.array_join(F.filter(parts, lambda x: x != ""), " AND ")


def row_strings(df_columns: list[str]) -> Column:
    """``name: value`` for each column, with a word for null."""
    return F.array(*[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in df_columns])


def stripped_label(c: Column) -> Column:
    """Without any ``p`` and ``.`` at its beginning."""
    return F.ltrim(c, F.lit("p."))


def reward(lines: Column, value: Column, present: Column) -> Column:
    return F.when(F.array_contains(lines, value) == present, 1).otherwise(-1)


def label_tokens(tokens: Column, labels: Column) -> Column:
    """Tokens whose label begins or continues an entity, without word-piece marks."""
    both = F.filter(F.arrays_zip(tokens.alias("t"), labels.alias("l")), lambda x: x["l"].rlike("^[BI]-"))
    return F.transform(both, lambda x: F.translate(x["t"], "#▁", ""))


def prompt(variant: Column, entities: Column, passage: Column) -> Column:
    """A scorer's question: the variant, its entities line by line, and the passage."""
    return F.concat_ws("\n", F.concat(F.lit("Variant: "), variant), F.lit("Entities:"), F.array_join(F.transform(entities, lambda e: F.concat(F.lit("- "), e)), "\n"), F.concat(F.lit("Passage: "), passage))
