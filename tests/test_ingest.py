"""The ingest of exports: batches, restarts after a failure, records that can't be read."""

import json

import pytest
from pyspark.sql.utils import StreamingQueryException

from paperloom.sources import readers
from paperloom.streaming import ingest


def export(i, envelope="documents"):
    marks = [{"id": f"a{i}.{k}", "text": "x", "infons": {"type": "Gene"}, "locations": [{"offset": k, "length": 1}]} for k in range(i % 4)]
    return {envelope: [{"id": str(i), "infons": {}, "passages": [{"offset": 0, "infons": {}, "text": "t", "annotations": marks}, {"offset": 5, "infons": {}, "text": "u"}]}, {"id": f"{i}b"}]}


@pytest.fixture
def folder(tmp_path):
    source = tmp_path / "source"
    source.mkdir()
    for f in range(4):
        lines = [json.dumps(export(10 * f + i, readers.ENVELOPES[i % 2])) for i in range(5)]
        lines += ['{"documents": [{"id": "cut', json.dumps({"other": []}), "", "null", "[1]", '{"documents": []}'][: 2 * f]
        (source / f"e{f}.json").write_text("\n".join(lines))
    return source


def rows(spark, store, name, *columns):
    return sorted(map(tuple, ingest.stored(spark, store, name).select(*columns).collect()), key=str)


def test_restart_after_a_failure_loses_and_repeats_nothing(spark, tmp_path, folder, monkeypatch):
    source, store, checkpoint = str(folder), f"file://{tmp_path}/store", f"file://{tmp_path}/checkpoint"
    tables, calls = ingest.TABLES, []

    class Failing(tuple):
        def __iter__(self):  # the second batch fails after its first table is written
            calls.append(1)
            yield from self[:1]
            if len(calls) == 2:
                raise OSError("stopped")
            yield from self[1:]

    monkeypatch.setattr(ingest, "TABLES", Failing(tables))
    with pytest.raises(StreamingQueryException):
        ingest.ingest(spark, source, store, checkpoint, per_trigger=1)
    first = rows(spark, store, "annotations", "pmid", "ann_id", "batch")
    assert {r[2] for r in first} == {0}
    monkeypatch.setattr(ingest, "TABLES", tables)
    assert ingest.ingest(spark, source, store, checkpoint, per_trigger=1) == 3
    want = sorted((str(10 * f + i), f"a{10 * f + i}.{k}") for f in range(4) for i in range(5) for k in range((10 * f + i) % 4))
    assert rows(spark, store, "annotations", "pmid", "ann_id") == want
    assert rows(spark, store, "documents", "pmid") == sorted((f"{10 * f + i}{b}",) for f in range(4) for i in range(5) for b in ("", "b"))
    assert [r[0] for r in rows(spark, store, "rejected", "reason")] == ["no known envelope"] * 3 + ["no record"] * 6  # cut off, null, a list
    (folder / "late.json").write_text(json.dumps(export(7)))
    assert ingest.ingest(spark, source, store, checkpoint) == 1
    assert len(rows(spark, store, "annotations", "pmid")) == len(want) + 3
    again = {r["pmid"]: r["file"] for r in ingest.latest(ingest.stored(spark, store, "documents")).collect()}
    assert again["2"] == "e0.json" and len(again) == 42


def test_whole_files_and_empty_folders(spark, tmp_path):
    source = tmp_path / "source"
    source.mkdir()
    store = f"file://{tmp_path}/store"
    assert ingest.ingest(spark, str(source), store, f"file://{tmp_path}/c") == 0
    assert all(ingest.stored(spark, store, t).count() == 0 for t in ingest.TABLES)
    (source / "a.json").write_text(json.dumps(export(3), indent=2))
    (source / "b.json").write_text("{\n")
    ingest.ingest(spark, str(source), store, f"file://{tmp_path}/c", whole_files=True)
    assert rows(spark, store, "annotations", "pmid", "pos") == [("3", 0), ("3", 1), ("3", 2)]
    assert rows(spark, store, "rejected", "file", "reason") == [("b.json", "no record")]


def test_exports_of_the_query_are_compressed(spark, tmp_path, monkeypatch):
    from paperloom.plans import records

    monkeypatch.setattr(records.folders, "fresh", lambda spark, label: f"file://{tmp_path}/{label}")
    got = records.stream_annotations(spark, "/root/testdata/sf0.001")
    files = list((tmp_path / "ingest/source").glob("part-*"))
    assert files and all(f.suffix == ".gz" for f in files)
    assert {r["state"] for r in got.select("state").distinct().collect()} >= {"stored"}
