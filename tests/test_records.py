"""Readers, sinks and record operators on small files and frames."""

import json
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from paperloom.operators import cooccurrence, knowledge, records
from paperloom.plans import chains
from paperloom.sources import readers, writers


def test_entities_of_other_passages_stay_apart(spark, tmp_path):
    ann = lambda i, t, label: {"id": str(i), "text": label, "infons": {"type": t, "identifier": f"id{i}"}, "locations": [{"offset": i, "length": 1}]}
    passages = [[ann(1, "Mutation", "V1"), ann(2, "Gene", "G1")], [ann(3, "Gene", "G2")], [ann(4, "Mutation", "V2"), ann(5, "Disease", "D")]]
    doc = {"PubTator3": [{"id": "7", "infons": {}, "passages": [{"offset": 0, "infons": {}, "text": "x", "annotations": a} for a in passages]}]}
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=1))
    a = readers.annotations(readers.by_format(spark, str(tmp_path / "d.json"), "biocjson"))
    a = a.withColumn("category", F.when(F.col("type") == "Mutation", "variant").otherwise(F.lower("type")))
    got = sorted((r["passage_idx"], r["variant_label"], r["entity_label"]) for r in cooccurrence.all_pairs(a).collect())
    assert got == [(0, "V1", "G1"), (2, "V2", "D")]
    assert {(r["variant"], r["genes"], r["diseases"]) for r in cooccurrence.nested(a).collect()} == {("V1", "G1", ""), ("V2", "", "D")}
    with pytest.raises(ValueError):
        readers.by_format(spark, str(tmp_path), "xml")


def test_flat_publications_literals_and_lists(spark, tmp_path):
    (tmp_path / "p.txt").write_text("1|t|Title\n1|a|Some | abstract\n\n2|t|Other\n")
    got = {tuple(r) for r in readers.by_format(spark, str(tmp_path / "p.txt"), "pubtator").collect()}
    assert got == {("1", "Title", "Some | abstract"), ("2", "Other", None)}
    (tmp_path / "v.txt").write_text("{'rsid': 'rs1', 'n': 2, 'x': None}\nbroken\n{'rsid': \"rs2\", 'n': 3}\n")
    rows = readers.literal_lines(spark, str(tmp_path / "v.txt"), "STRUCT<rsid: STRING, n: INT>", "FOXF1").where("rsid IS NOT NULL")
    assert {tuple(r) for r in rows.collect()} == {("rs1", 2, "FOXF1"), ("rs2", 3, "FOXF1")}
    (tmp_path / "ids.txt").write_text(" 3 \n\n1\n3\n")
    assert {r[0] for r in readers.id_list(spark, str(tmp_path / "ids.txt")).collect()} == {"1", "3"}
    folder = tmp_path / "texts"
    folder.mkdir()
    (folder / "a.txt").write_text("one\ntwo")
    (folder / "b.md").write_text("no")
    assert [tuple(r) for r in readers.texts(spark, str(folder)).collect()] == [("a.txt", "one\ntwo")]


def test_sinks(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    rels = spark.createDataFrame(
        [(1, [("G", "g", "why", 7)], [("D", "d", "why", None)], [], [], []), (2, [], [], [], [], [])],
        "pmid int, " + ", ".join(f"{c} array<struct<text: string, id: string, explanation: string, score: int>>" for c in records.ENTITIES),
    )
    writers.entity_csv(rels, at("entities"), ["pmid"])
    got = {(r["pmid"], r["gene"], r["gene_score"], r["disease"], r["disease_score"]) for r in spark.read.csv(at("entities"), header=True).collect()}
    assert got == {("1", "G", "7", None, None), ("1", None, None, "D", "0"), ("2", None, None, None, None)}
    writers.union_csv([spark.range(1).toDF("b"), spark.range(1).toDF("a").withColumn("pmid", F.lit(9))], at("union"), ["pmid"])
    assert spark.read.csv(at("union"), header=True).columns == ["pmid", "a", "b"]
    for _ in range(2):
        writers.append_json(spark.range(2), at("appended"))
    assert spark.read.json(at("appended")).count() == 4
    writers.lines(spark.range(3), at("lines"), "id")
    assert {r[0] for r in spark.read.text(at("lines")).collect()} == {"0", "1", "2"}
    writers.sheets({"one": spark.range(1), "two": spark.range(2)}, at("sheets"))
    assert spark.read.csv(at("sheets/two"), header=True).count() == 2
    qa = spark.createDataFrame([("q", "a", 1), ("  ", "b", 2)], "question string, answer string, n int").withColumn("metadata", F.struct("n"))
    writers.chat_examples(qa, at("chat"))
    assert [json.loads(r[0])["messages"][1]["content"] for r in spark.read.text(at("chat")).collect()] == ["a"]
    writers.report(spark.createDataFrame([("valid",), ("valid",), ("error",)], "status string"), at("report"), "status")
    assert {(r["status"], r["n"]) for r in spark.read.json(at("report/statistics")).collect()} == {("valid", 2), ("error", 1)}


def test_similar_diseases_confirm_and_missing_variants_are_errors(spark):
    kb = spark.createDataFrame([(1, [("10", "FOXF1")], [("20", "Pulmonary hypertension")])], "kb_id int, genes array<struct<id: string, symbol: string>>, phenotypes array<struct<id: string, name: string>>")
    rows = [(1, "", "foxf1", "", "pulmonary hypertensions"), (1, "", "x", "20", "other"), (2, "", "x", "", "y"), (None, "", "x", "", "y"), (1, "", "x", "", "asthma")]
    rels = spark.createDataFrame(rows, "kb_id int, gene_id string, gene string, ph_id string, ph string")
    got = {(r["kb_id"], r["ph"]): (r["reason"], r["result"]) for r in knowledge.validated(rels, kb).collect()}
    assert got[1, "pulmonary hypertensions"] == ("gene and disease confirmed", "valid") and got[1, "other"] == ("disease confirmed", "valid")
    assert got[2, "y"] == ("variant not found", "invalid") and got[None, "y"] == ("no variant given", "error") and got[1, "asthma"] == ("nothing confirmed", "invalid")


def test_regions_of_all_widths_meet_once(spark):
    import random

    rnd = random.Random(4)
    span = lambda: (a := rnd.randrange(300_000), a + rnd.choice([0, 3, 70, 5000, 200_000]))
    regions, known = [(i, "1", *span()) for i in range(80)], [(i, "1", *span()) for i in range(80)]
    got = knowledge.overlaps(spark.createDataFrame(regions, "region_id int, chr string, start long, end long"), spark.createDataFrame(known, "kb_id int, chr string, start long, stop long"))
    assert sorted(map(tuple, got.collect())) == sorted((i, k) for i, _, a, b in regions for k, _, c, d in known if c <= b and d >= a)
    wide = spark.createDataFrame([(1, "1", 0, 250_000_000), (2, None, 1, 2), (3, "1", 9, 2)], "region_id int, chr string, start long, end long")
    rows = {r["region_id"]: (len(r["kb_ids"]), r["error"]) for r in knowledge.enriched(wide, spark.createDataFrame(known, "kb_id int, chr string, start long, stop long")).collect()}
    assert rows == {1: (80, None), 2: (0, "missing coordinates"), 3: (0, "start after end")}


def test_chain_from_coordinates_to_links(spark):
    texts = spark.createDataFrame([(1, "lung disease with c.123A>G in alpha beta"), (2, "nothing")], "doc_id long, text string")
    terms = spark.createDataFrame([("T1", "alpha beta lung"), ("T2", "quite different words"), ("T3", "gamma")], "id string, text string")
    got = chains.inferred(texts, terms, near=2)
    first = got.where("rank = 1").select("doc_id", "coordinate", "term_id").collect()
    assert [tuple(r) for r in first] == [(1, "c.123A>G", "T1")]
    held = chains.linked(got.withColumn("ok", F.col("term_id") == "T1"), ["doc_id"], "ok").first()
    assert (held["every"], held["first"]) == (False, 1)


def test_retries():
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("429")
        return "done"

    assert records.retried(call, 3, 2.0, True, waits.append) == "done" and waits == [2.0, 4.0]
    with pytest.raises(OSError):
        records.retried(lambda: (_ for _ in ()).throw(OSError()), 2, sleep=waits.append)


def test_nearest_in_blocks_equals_one_block(spark, monkeypatch):
    import random

    from paperloom.operators import vectors

    rnd = random.Random(6)
    rows = [(i, [rnd.random() for _ in range(4)]) for i in range(60)] + [(60, [0.0] * 4)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame(rows[:9], "query_id long, embedding array<double>")
    for metric in ("cosine", "l2"):
        one = sorted(map(tuple, vectors.nearest(v, q, 4, metric).collect()))
        assert len(one) == 36 and {(r[0], r[1]) for r in one if r[3] == 1} == {(i, i) for i in range(9)}
        monkeypatch.setattr(vectors, "MAX_QUERIES", 2)
        assert sorted(map(tuple, vectors.nearest(v, q, 4, metric).collect())) == one
        monkeypatch.setattr(vectors, "MAX_QUERIES", 10_000)


def test_similar_names_travel_with_no_list(spark):
    kb = spark.createDataFrame(
        [(1, [("7", "GENE")], [("1", "lung cancer")]), (2, [("8", None)], [("2", "Heart"), ("3", None)]), (3, [], [])],
        "kb_id long, genes array<struct<id:string,symbol:string>>, phenotypes array<struct<id:string,name:string>>",
    )
    rows = [(1, "", "gene", "", "Cancer lung"), (1, None, None, None, None), (2, "8", "x", "9", "heart"), (2, "", "x", "", "hearts"), (3, "7", "gene", "1", "heart"), (4, "7", "gene", "1", "heart"), (None, "7", "gene", "1", "heart"), (2, "", "x", "3", "")]
    rels = spark.createDataFrame(rows, "kb_id long, gene_id string, gene string, ph_id string, ph string")
    got = knowledge.validated(rels, kb)
    assert not re.search(r"Join .*\(ph#\d+ = _n#", got._jdf.queryExecution().optimizedPlan().toString())
    below = got._jdf.queryExecution().optimizedPlan().toString().split("_ratio(")[-1]
    assert "Aggregate [_n" in below  # names are made distinct before they are compared
    want = ["gene and disease confirmed", "nothing confirmed", "gene and disease confirmed", "disease confirmed", "nothing confirmed", "variant not found", "no variant given", "disease confirmed"]
    assert {tuple(r)[:6] for r in got.collect()} == {(*r, w) for r, w in zip(rows, want)}
    found = knowledge.similar_phenotypes(rels.select("kb_id", "ph"), kb.select("kb_id", "phenotypes"), "kb_id", "ph").collect()
    assert {tuple(r) for r in found} == {(1, "Cancer lung", True), (1, None, False), (2, "heart", True), (2, "hearts", True), (2, "", False), (3, "heart", False)}
    assert len(found) == 6


def test_a_disease_is_confirmed_by_id_or_similar_name(spark):
    from paperloom.plans import QUERIES

    kb = spark.createDataFrame([(1, [("7", "lung cancer"), (None, "ab")]), (2, [("", "abcdecdea"), ("8", None)]), (3, None)], "kb_id long, phenotypes array<struct<id:string,name:string>>")
    known, given = "abacbbca", "bbacbaba"  # matching blocks find fewer the other way round
    assert SequenceMatcher(None, known, given).ratio() >= 0.7 > SequenceMatcher(None, given, known).ratio()
    kb = kb.union(spark.createDataFrame([(4, [("9", known)])], kb.schema))
    rows = [(1, "7", "gout"), (1, "8", "gout"), (1, "", "cancer lung"), (1, None, None), (2, "", "gout"), (2, "8", None), (3, "7", "gout"), (4, "", given), (5, "7", "lung cancer"), (1, "7", "gout")]
    got = knowledge.similar_phenotypes(spark.createDataFrame(rows, "kb_id long, ph_id string, ph string"), kb, "kb_id", "ph", "ph_id")
    want = [(False, True), (False, False), (True, True), (False, False), (False, False), (False, True), (False, False), (True, True), None, (False, True)]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((*r, *w) for r, w in zip(rows, want) if w), key=key)

    sf = "/root/testdata/sf0.01"
    found = QUERIES["validate_disease"](spark, sf)
    parts = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey kb_id")
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_partkey + l_linenumber % 2 * 5 kb_id").join(parts, "kb_id").count()
    assert found.count() == lines and {"ph_id", "confirmed"} <= set(found.columns)  # repeated relationships stay


@pytest.mark.parametrize("name", ["xml_article", "xml_variant_details", "xml_full_text"])
def test_one_row_group_is_dealt_to_many_tasks(spark, tmp_path, name):
    from paperloom.plans import QUERIES

    part = spark.range(400).selectExpr("id AS p_partkey", "concat('n', id) AS p_name", "'SMALL' AS p_type", "'Brand#1' AS p_brand", "cast(id % 50 AS int) AS p_size")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES[name](spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert got.count() == 400
