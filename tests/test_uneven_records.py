"""Records with missing, repeated and broken parts."""

from pyspark.sql import functions as F

from paperloom.functions import xml as X
from paperloom.operators import records
from paperloom.sources import readers


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "x string").select(column("x").alias("y")).first()["y"]


def test_parts_of_one_element_stay_together(spark):
    uneven = (
        '<Record><Trait><Name>A</Name><Name>A again</Name><XRef DB="OMIM" ID="1"/></Trait><Trait><Name>B</Name><XRef DB="OMIM" ID="2"/></Trait>'
        '<Trait><Name>C</Name></Trait><SequenceLocation Chr="1"/><SequenceLocation Chr="2" start="5" stop="6"/></Record>'
    )
    rows = [(1, uneven), (2, "<Record"), (3, None), (4, ""), (5, "<Record/>"), (6, "<Record><Trait>text</Trait></Record>"), (7, uneven)]
    df = spark.createDataFrame(rows, "id int, x string").withColumns({"places": F.lit(1), "broken": F.lit("old"), "_r": F.lit(2)})
    got = {r["id"]: r for r in records.kb_from_xml(df, "x").collect()}
    assert [tuple(t) for t in got[1]["traits"]] == [("A", "1"), ("B", "2"), ("C", None)]
    assert [tuple(t) for t in got[1]["phenotypes"]] == [("A", "1"), ("B", "2")]
    assert [tuple(p) for p in got[1]["places"]] == [(None, "1", None, None), (None, "2", "5", "6")]
    assert got[7]["traits"] == got[1]["traits"]
    assert {i: r["broken"] for i, r in got.items()} == {1: False, 2: True, 3: False, 4: True, 5: False, 6: False, 7: False}
    assert all(got[i]["significance"] == "Not provided" and got[i]["genes"] == [] and got[i]["traits"] == [] for i in (2, 3, 4, 5, 6))
    assert records.kb_from_xml(df.limit(0), "x").count() == 0


def test_authors_need_both_names(spark):
    text = (
        "<a><Author><CollectiveName>Group</CollectiveName></Author><Author><LastName>Solo</LastName></Author><Author><ForeName>F</ForeName><LastName>L</LastName></Author>"
        "<Author><ForeName/><LastName>E</LastName></Author><Author><LastName>M</LastName><ForeName>G</ForeName><ForeName>H</ForeName></Author></a>"
    )
    assert one(spark, X.authors, text) == "F L; G M"
    assert one(spark, X.authors, "<a><Author>") == "" and one(spark, X.authors, None) == ""
    assert one(spark, X.full_text, "<a><article-title>T</article-title><body><p><b>x</b>tail</p><p>one<i>two</i>three</p></body></a>") == "T\n\none"


def test_any_record_as_a_tree(spark):
    as_json = lambda x: F.to_json(X.tree(x))
    assert one(spark, as_json, "<Root><Child>Value</Child></Root>") == '{"Child":"Value"}'
    assert one(spark, as_json, "<Root><Child><Grandchild>Value</Grandchild></Child></Root>") == '{"Child":{"Grandchild":"Value"}}'
    assert one(spark, as_json, '<Root><Child attribute="value">Content</Child></Root>') == '{"Child":"Content"}'
    assert one(spark, as_json, '<Root xmlns:ns="http://example.com"><ns:Child>Value</ns:Child></Root>') == '{"Child":"Value"}'
    assert one(spark, as_json, "<Root><Child>Value1</Child><Child>Value2</Child></Root>") == '{"Child":["Value1","Value2"]}'
    assert one(spark, as_json, "Invalid XML") is None and one(spark, as_json, "") is None and one(spark, as_json, None) is None


def test_literals_keep_their_strings(spark, tmp_path):
    lines = [
        "{'t': 'None of it', 'ok': True, 'n': None}", "('a', 1)", "broken", "", "{'t': \"it's True\", 'ok': False, 'n': 3}", "{'t': 'a'", "[1, 2]", "{'t': 'x', 'more': ('p', 'q'), 'n': 4}",
        "__import__('os').getcwd()", "  {'t': 'blank', 'n': 5}", "{'t': b'bytes'}",
    ]
    (tmp_path / "l.txt").write_text("\n".join(lines))
    got = readers.literal_lines(spark, str(tmp_path / "l.txt"), "STRUCT<t: STRING, ok: BOOLEAN, n: INT, more: ARRAY<STRING>>", "G")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [("None of it", True, None, None, "G"), ("it's True", False, 3, None, "G"), ("x", None, 4, ["p", "q"], "G"), ("blank", None, 5, None, "G")], key=str
    )
