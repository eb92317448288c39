"""Scalar functions against their acceptance tables."""

import difflib

import pytest
from pyspark.sql import functions as F

from paperloom.functions import llm_json as J
from paperloom.functions import text as T
from paperloom.functions.similarity import text_ratio, text_similar, text_similar_rules


def check(spark, fn, cases):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, x string")
    got = {r["i"]: r["y"] for r in rows.select("i", fn(F.col("x")).alias("y")).collect()}
    assert [got[i] for i in range(len(cases))] == [b for _, b in cases]


CASES = {
    "norm_gene": [("tp53", "TP53"), (" BRCA1 ", "BRCA1"), ("GEN TP53", "TP53"), ("PROTEIN BRCA1", "BRCA1"), ("BIAŁKO TP53", "TP53"), ("", ""), (None, "")],
    "norm_disease": [("Breast Cancer Disease", "breast cancer"), ("Lynch Syndrome", "lynch"), ("  Multiple   Spaces  ", "multiple spaces"), ("", ""), (None, "")],
    "norm_variant": [("c. 123A>G", "c.123a>g"), ("p.arg123cys", "p.Arg123cys"), ("NM_000546.5:c.215C>G", "NM_000546.5:c.215c>g"), ("TP53 p.Pro72Arg", "TP53 p.Pro72Arg"), ("", ""), (None, "")],
    "variant_type_hgvs": [("c.1A>G", "SNV"), ("c.1del", "Deletion"), ("c.1_2insA", "Insertion"), ("c.1dup", "Duplication"), ("c.1delinsA", "Indel"), ("c.1inv", "Inversion"), ("p.Arg123Cys", "Substitution"), ("rs1042522", "SNP"), ("x", "Unknown"), ("", "Unknown"), (None, "Unknown")],
    "parse_variants": [("a, b, c", ["a", "b", "c"]), ("1. a\n2. b\n3. c", ["a", "b", "c"]), ("- a\n- b\n* c", ["a", "b", "c"]), ("", []), ("No variants found.", []), (None, [])],
    "parse_coordinates": [("c.1A>G, chr1:1-2", ["c.1A>G", "chr1:1-2"]), ("No coordinates found", []), (None, [])],
    "coordinates": [("p.Val600Glu and c.123A>G, c.123A>G at chr7:1-2", ["c.123A>G", "chr7:1-2", "p.Val600Glu"]), ("", []), (None, [])],
    "rs_clean": [("rs123", "rs123"), ("tmVar:rs9;VariantGroup:1", "rs9"), ("chr1-5", "chr1-5"), (None, None)],
    "gene_tokens": [("AP-2alpha (21418); TP53 (7157)", ["AP-2", "TP53"]), (None, [])],
    "disease_tokens": [("Cancer (MESH:D1); Flu MESH:D2", ["cancer", "flu"]), ("", [])],
    "pmid_cell": [("12; 34 (A et al. 2001)", ["12", "34"]), ("see 12", None), (None, None)],
    "stripped_label": [("p.Arg", "Arg"), ("pp..p", ""), ("x.p", "x.p")],
}


@pytest.mark.parametrize("name", CASES)
def test_table(spark, name):
    check(spark, getattr(T, name), CASES[name])


def test_json_repairs(spark):
    check(spark, J.no_trailing_commas, [('{"a": [1, 2, ], "b": 3, }', '{"a": [1, 2 ], "b": 3 }')])
    check(spark, J.missing_commas, [('{"a": 1 "b": 2}', '{"a": 1, "b": 2}')])
    check(spark, J.quoted_keys, [("{a: 1, b: 2}", '{ "a": 1, "b": 2}'.replace("{ ", "{ "))])
    check(spark, J.double_quotes, [("{'a': \"it's\"}", '{"a": "it\'s"}')])
    check(spark, J.sliced, [('x {"a": 1} y', '{"a": 1}'), ("none", "{}"), (None, "{}")])
    check(spark, J.fenced, [('a ```json\n{"a": 1}\n``` b', '{"a": 1}'), ("plain", "plain")])
    check(spark, lambda c: J.repaired(c, cumulative_empty=True), [("not json {", '{}'), ("{'a': 1,}", '{"a": 1}'), ("{a b c}", '{"relationships": []}')])
    check(spark, lambda c: F.size(J.relationships(c)), [('{"relationships": [{"entity_text": "x"}]}', 1), ("{}", 0), ("nonsense", 0), (None, 0)])


def test_similarity(spark):
    pairs = [("Cancer", "cancer"), ("gene mutation", "gene mutations"), ("breast cancer", "ovarian cancer"), ("diabetis", "diabetes"), ("", "x"), (None, "x"), ("a b c", "c b a"), ("alpha beta gamma", "beta alpha delta")]
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", text_ratio("a", "b").alias("r"), text_similar("a", "b").alias("s"), text_similar_rules("a", "b").alias("u")).collect()
    for r in rows:
        a, b = (r["a"] or "").lower(), (r["b"] or "").lower()
        assert r["r"] == pytest.approx(difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0)
    assert [r["s"] for r in rows] == [True, True, False, True, False, False, False, False]
    assert [r["u"] for r in rows] == [True, True, False, True, False, False, True, True]


def test_packing_equals_a_plain_fold(spark):
    import random

    rnd = random.Random(1)
    lists = [[rnd.randrange(1, 700) for _ in range(rnd.randrange(40))] for _ in range(30)]
    got = spark.createDataFrame([(x,) for x in lists], "q array<int>").select("q", T.packed(F.col("q"), 1000).alias("y")).collect()
    for r in got:
        group, used, want = 0, 0, []
        for x in r["q"]:
            if used and used + x > 1000:
                group, used = group + 1, 0
            used += x
            want.append(group)
        assert r["y"] == want


def test_yes_no_and_windows(spark):
    check(spark, lambda c: T.parse_yes_no(c)["value"], [("YES\nv\nwhy", "v"), ("YES", ""), ("NO\nx\ny", "x")])
    check(spark, lambda c: T.context_window(c, F.lit("mid"), 1), [("a b mid c d", "b mid c"), ("mid", "mid"), ("x", "Fragment not found")])
    check(spark, lambda c: T.fixed_chunks(c, 2), [("abcde", ["ab", "cd", "e"]), ("", [])])
