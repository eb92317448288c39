"""Personal data and what gives it away: patterns, and information-theoretic sanitisation.

Patterns find e-mail addresses, IP addresses, card and phone numbers; these are the protected entities. Terms can reveal an
entity too. For every entity the windows of text around its occurrences are gathered from the whole corpus; a term
in them discloses ``log2(P(entity | term) / P(entity)) / -log2 P(entity)`` of the entity's information, 1.0 if the
term occurs nowhere but beside it. ``P(entity | term)`` is the share of the term's occurrences in the corpus that
are in windows of the entity, and ``P(entity)`` the entity's occurrences for each character; both count every copy of a text.
A term needs ``Thresholds.support`` windows of different content; windows whose words have the same two least hashes count as
one, so copies and most near copies are no evidence.

Terms are words without the signs around them. In texts with the entity, a term that discloses ``Thresholds.generalise`` or more is
generalised: its more general forms are those of its words that share its first ``FORMS`` letters, and the longest form that
discloses less takes its place (a span of kind ``term``). Where all forms disclose as much, the term is removed (kind ``drop``).

Everything is Spark expressions. The Java patterns differ from the plain ones in the docstring of ``PATTERNS`` only by
possessive quantifiers and by starting at the run's first character, which spares quadratic time on long runs.

Cases: null text is empty; a null doc_id is a key like any other; repeated rows get equal results; texts are taken whole;
an empty table gives no rows; further columns of the input don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import ascii_lower, bind, scratch, written

#: ``term`` is to be generalised, ``drop`` to be removed.
KINDS = ("email", "ip", "card", "phone", "term", "drop")
# Fixed values of the base patterns: kind, what a text with a match surely has, pattern. In plain form:
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+       ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+                                      phone \+[0-9][\x20().0-9-]+[0-9]
PATTERNS = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){13}", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
IP_OK = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
KEY = ("doc_id", "_t")
#: Letters that the more general forms of a term keep.
FORMS = (4, 2)
#: Matches of a text whose places are found together.
CHUNK = 256
SPAN = "array<struct<start:int,k:int,end:int,value:string>>"


@dataclass(frozen=True)
class Thresholds:
    generalise: float = 0.95
    #: Windows of different content that a term must share with an entity.
    support: int = 2
    #: Characters of a window on each side.
    window: int = 80
    #: The candidate terms are broadcast up to this number and joined by shuffling beyond it.
    broadcast_terms: int = 500_000


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def term(i: Column) -> Column:
        x = F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + term(i)) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    n = F.length(_digits(v))
    if kind == "ip":
        return v.rlike(IP_OK)
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(_digits(v))).otherwise(F.lit(False))
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _located(text: Column, kind: str) -> Column:
    """Spans (start, k, end, value) of one kind's valid matches. What lies between matches tells where they are."""
    sign, pattern = PATTERNS[kind]
    k = KINDS.index(kind)

    none = F.array().cast(SPAN)
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["g"]
        b = a + F.length(x["v"])
        span = F.struct(a.alias("start"), F.lit(k).alias("k"), b.alias("end"), x["v"].alias("value"))
        return F.struct(b.alias("at"), F.when(_valid(kind, x["v"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def join(acc: Column, x: Column) -> Column:
        moved = F.transform(x["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["k"].alias("k"), (s["end"] + acc["at"]).alias("end"), s["value"].alias("value")))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], moved).alias("out"))

    def spans(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
        both = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, v: F.struct(g.alias("g"), v.alias("v")))
        # In chunks, as appending to one long array copies it each time.
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(found)), F.lit(CHUNK))
        return bind(both, lambda every: F.aggregate(F.transform(starts, lambda i: F.aggregate(F.slice(every, i, F.lit(CHUNK)), zero, step)), zero, join)["out"])

    quick = F.contains(text, F.lit(sign)) if kind == "email" else text.rlike(sign)
    return F.when(quick, bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)).otherwise(none)


def base(docs: DataFrame) -> DataFrame:
    """doc_id, _t (hash of the text), spans sorted by start and kind, and the text where there are spans; written, one scan."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind in PATTERNS:
        d = d.withColumn(f"_{kind}", _located(F.col("text"), kind))
    spans = F.sort_array(F.concat(*[f"_{k}" for k in PATTERNS]))
    d = d.select("doc_id", F.xxhash64("text").alias("_t"), "text", spans.alias("spans"))
    return written(d.withColumn("n_chars", F.length("text")).withColumn("text", F.when(F.size("spans") > 0, F.col("text"))), "pii-base", lasting=True)


def _plain(word: Column) -> Column:
    """A word without the signs around it."""
    return F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def _form(term: Column, n: int) -> Column:
    """The term's first letters and an asterisk; null where it has no more."""
    return F.when(F.length(term) > n, F.concat(F.substring(term, 1, n), F.lit("*")))


def _forms(term: Column) -> Column:
    return F.array_compact(F.array(term, *[_form(term, n) for n in FORMS]))


def _sketch(terms: Column) -> Column:
    """The least hash of the terms and the least one of the terms behind an asterisk: equal for windows in proportion to their likeness."""
    return F.array(F.array_min(F.transform(terms, lambda w: F.xxhash64(w))), F.array_min(F.transform(terms, lambda w: F.xxhash64(F.concat(F.lit("*"), w)))))


def windows(found: DataFrame, t: Thresholds) -> DataFrame:
    """entity (kind and value), terms (of one window, in order), copies."""
    at = found.where("size(spans) > 0").select("text", F.explode("spans").alias("s"))
    left = F.expr(f"substring(text, greatest(1, s.start - {t.window} + 1), least({t.window}, s.start))")
    right = F.expr(f"substring(text, s.end + 1, {t.window})")
    # The outer end of a window may cut a word; without its outer piece it holds whole words only.
    left = F.when(F.col("s.start") > t.window, F.regexp_replace(left, r"^[^\x20\x09-\x0D]+", "")).otherwise(left)
    right = F.regexp_replace(right, r"[^\x20\x09-\x0D]+$", "")
    words = F.split(ascii_lower(F.concat(left, F.lit(" "), right)), r"[\x20\x09-\x0D]+")
    terms = F.filter(F.transform(words, _plain), lambda w: w != "")
    at = at.select(F.concat_ws(":", F.col("s.k").cast("string"), F.lower("s.value")).alias("entity"), terms.alias("terms"))
    return at.groupBy("entity", "terms").agg(F.count("*").alias("copies"))


def disclosures(docs: DataFrame, found: DataFrame, t: Thresholds) -> DataFrame:
    """entity, form (a term or a more general form), disclosure, of all forms with enough support."""
    around = windows(found, t)
    around = written(around.withColumn("sketch", _sketch(F.col("terms"))), "pii-windows")
    each = around.select("entity", "copies", "sketch", F.explode("terms").alias("term"))
    each = each.select("entity", "copies", "sketch", F.explode(_forms(F.col("term"))).alias("form"))
    pairs = each.groupBy("entity", "form").agg(F.count_distinct("sketch").alias("n_windows"), F.sum("copies").alias("n_both"))
    pairs = written(pairs.where(F.col("n_windows") >= t.support), "pii-pairs")
    own = around.groupBy("entity").agg(F.sum("copies").alias("n_entity"))
    forms = pairs.select("form").distinct()
    n = forms.count()
    if not n:
        return pairs.select("entity", "form", F.lit(0.0).alias("disclosure"))
    forms = F.broadcast(forms) if n <= t.broadcast_terms else forms
    # Words are counted as they stand; only different ones get lower case, lose their signs and have forms.
    words = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = words.select("n", F.explode(_forms(_plain(ascii_lower("word")))).alias("form")).join(forms, "form").groupBy("form").agg(F.sum("n").alias("n_term"))
    total = found.agg(F.sum("n_chars")).first()[0]  # places where a window can be
    p = F.least(F.lit(1.0), F.col("n_both") / F.col("n_term"))
    rate = F.col("n_entity") / F.lit(float(max(total, 2)))
    scored = pairs.join(own, "entity").join(counts, "form").withColumn("disclosure", F.log2(p / rate) / -F.log2(rate))
    return written(scored.select("entity", "form", "disclosure"), "pii-disclosures")


def revealing(docs: DataFrame, found: DataFrame, t: Thresholds) -> DataFrame:
    """entity, term, disclosure, to: all terms at or over ``t.generalise`` and the form that takes their place, null if all disclose as much."""
    every = disclosures(docs, found, t)
    told = every.where((F.col("disclosure") >= t.generalise) & ~F.col("form").endswith("*")).withColumnRenamed("form", "term")
    to = []
    for n in FORMS:
        general = every.where(F.col("disclosure") < t.generalise).select("entity", F.col("form").alias(f"_{n}"), F.col("form").alias(f"_to{n}"))
        told = told.withColumn(f"_{n}", _form(F.col("term"), n)).join(general, ["entity", f"_{n}"], "left")
        to.append(f"_to{n}")
    return written(told.select("entity", "term", "disclosure", F.coalesce(*to).alias("to")), "pii-terms")


def term_spans(found: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, _t, terms: spans (start, k, end, value: what takes their place) of revealing terms in texts that hold the entity."""
    holders = found.where("size(spans) > 0").select(*KEY, F.explode("spans").alias("s"))
    holders = holders.select(*KEY, F.concat_ws(":", F.col("s.k").cast("string"), F.lower("s.value")).alias("entity")).distinct()
    # Of what several entities ask for a term, the most general form holds, and removal before all.
    rank = F.struct(F.col("to").isNull().alias("none"), (-F.length("to")).alias("n"), F.coalesce("to", F.lit("")).alias("to"))
    told = holders.join(terms, "entity").groupBy(*KEY, "term").agg(F.max(rank).alias("to"))
    told = told.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("term", "to.to"))).alias("wanted")).alias("t")
    # Keys only have come so far; now each text once, of repeated rows one.
    texts = found.where("size(spans) > 0").select(*KEY, "text").alias("f")
    held = texts.join(told, F.col("f.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("f._t") == F.col("t._t")))
    told = held.select("f.doc_id", "f._t", "text", "wanted").dropDuplicates(list(KEY))
    gaps = F.split("text", r"[^\x20\x09-\x0D]+", -1)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    each = told.select(*KEY, "wanted", F.posexplode(F.zip_with(F.slice(gaps, F.lit(1), F.size(words)), words, lambda g, w: F.struct(F.length(g).alias("g"), w.alias("w")))).alias("i", "x"))
    each = each.selectExpr(*KEY, "wanted", "x.w AS w", "CAST(sum(x.g + length(x.w)) OVER (PARTITION BY doc_id, _t ORDER BY i ROWS UNBOUNDED PRECEDING) AS int) AS e")
    each = each.withColumn("to", F.element_at("wanted", _plain(ascii_lower("w")))).where("to IS NOT NULL")
    # The word's signs stay.
    start = F.col("e") - F.length(F.regexp_replace("w", r"^[^\p{L}\p{N}]+", ""))
    end = F.col("e") - F.length("w") + F.length(F.regexp_replace("w", r"[^\p{L}\p{N}]+$", ""))
    k = F.when(F.col("to") == "", KINDS.index("drop")).otherwise(KINDS.index("term"))
    span = F.struct(start.cast("int").alias("start"), k.alias("k"), end.cast("int").alias("end"), F.col("to").alias("value"))
    return each.groupBy(*KEY).agg(F.array_distinct(F.sort_array(F.collect_list(span))).alias("terms"))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, _t, text (where anything was found), base (spans), spans (with terms)."""
    with scratch(docs.sparkSession):
        found = base(docs)
        terms = revealing(docs, found, t)
        more = written(term_spans(found, terms), "pii-spans", lasting=True).alias("m")
    f = found.alias("f")
    got = f.join(more, F.col("f.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("f._t") == F.col("m._t")), "left")
    # A term inside a base span is covered by it.
    fresh = F.filter(F.coalesce("m.terms", F.array()), lambda x: ~F.exists(F.col("f.spans"), lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"])))
    every = F.when(F.col("m.terms").isNull(), F.col("f.spans")).otherwise(F.sort_array(F.concat("f.spans", fresh)))
    return got.select("f.doc_id", "f._t", "f.text", F.col("f.spans").alias("base"), every.alias("spans"))


def sanitised() -> Column:
    """The text with every span replaced by its kind in brackets, ``term`` spans by their general form and ``drop`` spans by
    nothing; null where nothing was found. Over the columns of ``find``."""
    names = F.array(*[F.lit("" if k == "drop" else f"[{k.upper()}]") for k in KINDS])
    put = lambda s: F.when(s["k"] == KINDS.index("term"), s["value"]).otherwise(F.get(names, s["k"]))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
        F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), put(s))).alias("out"))
    )
    done = F.aggregate("spans", zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length(F.col("text")))))
    return F.when(F.size("spans") > 0, done)


def counts(found: DataFrame) -> DataFrame:
    """The digest: n_<kind>, base_sha256, spans, sanitised."""
    n = lambda k: F.size(F.filter("base", lambda s: s["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[n(k) for k in PATTERNS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), sanitised().alias("sanitised"))
