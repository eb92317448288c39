"""The data source of a service: requests, filters, rates, retries."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from paperloom.sources import service


class Counted:
    """A service that knows even ids, fails its first call of a partition if told so, and leaves a file for each request."""

    def __init__(self, options):
        self.folder, self.fails = options["log"], int(options.get("fails", 0))

    def fetch(self, ids, types):
        if self.fails:
            self.fails -= 1
            raise ConnectionError("429")
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(json.dumps([list(ids), sorted(types) if types is not None else None]))
        return [
            {"id": i, "passages": [{"annotations": [{"id": f"{i}.{t}", "text": "x", "infons": {"type": t}, "locations": [{"offset": 4}]} for t in ("Gene", "Disease") if types is None or t in types]}, {}]}
            for i in ids if int(i) % 2 == 0
        ]


@pytest.fixture
def read(spark, tmp_path):
    service.register(spark)
    os.mkdir(tmp_path / "log")
    asked = lambda: [json.loads((tmp_path / "log" / n).read_text()) for n in os.listdir(tmp_path / "log")]

    def load(**options):
        return spark.read.format("publications").options(transport="tests.test_service:Counted", log=str(tmp_path / "log"), wait="0.01", **options).load()

    return load, asked


def test_requests_have_at_most_a_hundred_ids(read):
    load, asked = read
    rows = load(ids=",".join(map(str, [*range(250), 3, " 7 ", ""]))).collect()
    assert sorted(len(ids) for ids, _ in asked()) == [50, 100, 100]
    assert {(r["pmid"], r["type"], r["pos"], r["passage_idx"], r["identifier"]) for r in rows} == {(str(i), t, 4, 0, "") for i in range(0, 250, 2) for t in ("Gene", "Disease")}


def test_filters_reach_the_service(read, capsys):
    load, asked = read
    df = load(ids=",".join(map(str, range(250)))).where("pmid IN ('4', '6', '7') AND type = 'Gene' AND pos > 1")
    df.explain("formatted")
    plan = capsys.readouterr().out
    scan, kept = plan.split("BatchScan publications")[-1], plan.split("Filter")[-1]
    assert "pmid" in scan.split("PushedFilters")[1].split("]")[0] and "pos" in kept
    assert sorted(r["ann_id"] for r in df.collect()) == ["4.Gene", "6.Gene"]
    assert asked() == [[["4", "6", "7"], ["Gene"]]]
    assert load(ids="4").where("pmid = '4' AND pmid = '5'").count() == 0 and load(ids="").count() == 0
    assert len(asked()) == 1


def test_folders_of_ids(spark, read, tmp_path):
    load, asked = read
    path = f"file://{tmp_path}/ids"
    service.write_ids(spark.range(330).select(F.col("id").cast("string").alias("pmid")).unionByName(spark.sql("SELECT ' 9 ' pmid UNION ALL SELECT NULL UNION ALL SELECT ' '")), path)
    assert load(ids_path=path).select("pmid").distinct().count() == 165
    assert sorted(i for ids, _ in asked() for i in ids) == sorted(map(str, range(330))) and max(len(ids) for ids, _ in asked()) <= 100


def test_failures_are_tried_again(read):
    load, asked = read
    assert load(ids="2", fails="2").count() == 2 and len(asked()) == 1
    with pytest.raises(Exception, match="429"):
        load(ids="2", fails="3").collect()
    with pytest.raises(Exception, match="no publication id"):
        load(ids="2,x7").collect()


def test_a_bucket_holds_the_rate():
    now, waits = [0.0], []

    def sleep(s):
        waits.append(round(s, 3))
        now[0] += s

    bucket = service.Bucket(4, 2, lambda: now[0], sleep)
    for _ in range(5):
        bucket.take()
    assert waits == [0.25, 0.25, 0.25]
    now[0] += 10
    bucket.take(), bucket.take(), bucket.take()
    assert waits == [0.25] * 4


def test_exported_documents(spark, tmp_path):
    service.register(spark)
    docs = [(str(i), json.dumps({"id": str(i), "passages": [{"annotations": [{"id": f"a{i}", "text": "ü\nx", "infons": {"type": "Gene", "identifier": "7"}}]}]})) for i in range(40)]
    store = f"file://{tmp_path}/store"
    service.export(spark.createDataFrame(docs, "pmid string, value string"), store, 8)
    got = spark.read.format("publications").options(store=store, buckets="8", ids="3,39,40").load().collect()
    assert sorted(map(tuple, got)) == [("3", 0, "a3", "ü\nx", "Gene", "7", None), ("39", 0, "a39", "ü\nx", "Gene", "7", None)]


def test_a_bucket_does_not_grow_with_the_store(monkeypatch):
    from paperloom.sources import service

    assert [service.buckets_for(n) for n in (0, 1_000, 256_001)] == [64, 64, 65]
    assert all(n / service.buckets_for(n) <= service.A_BUCKET for n in (10**5, 10**6, 54 * 10**6))
