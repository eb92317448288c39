"""Annotated publications of a service as a Spark data source: requests of a limited size, at a limited rate, with retries.

``spark.read.format("publications")`` with ``ids`` (a comma-separated list) or ``ids_path`` (a folder of Parquet files with a column ``pmid``, as
``write_ids`` makes it) gives a row for each annotation. A list makes a partition for each request; a folder makes one for each of its files,
so the driver sees names of files only, however many ids there are. Filters on pmid and type are pushed down: ids that are not
asked for make no request, and the service is asked for the wanted types only.

A service is a ``Transport``, named by ``transport`` as ``module:factory``; the factory gets the options. ``Exported`` is one without a network, over
documents that ``export`` has written.

Options: ``size`` ids a request (100), ``rate`` requests a second and ``burst`` of each partition (none), ``times`` and ``wait`` of retries (3, 0.5 s).

Cases: ids are trimmed, blank and repeated ones are left out, in a list all and in a folder those of a file; an id that is no number fails the read; an id that the service
doesn't know gives no row, and so does a publication without annotations; no ids, no requests.
"""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Callable, Iterator, Sequence
from importlib import import_module
from typing import Protocol

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from paperloom.operators.records import retried

SCHEMA = "pmid string, passage_idx int, ann_id string, label string, type string, identifier string, pos int"
_ARROW = pa.schema([("pmid", pa.string()), ("passage_idx", pa.int32()), ("ann_id", pa.string()), ("label", pa.string()), ("type", pa.string()), ("identifier", pa.string()), ("pos", pa.int32())])


#: Documents in a bucket of an export, about.
A_BUCKET = 4_000


class Transport(Protocol):
    def fetch(self, ids: Sequence[str], types: frozenset[str] | None) -> list[dict]:
        """Documents of the ids that it knows, with annotations of the types only (all if None)."""


class Bucket:
    """A token bucket: ``rate`` tokens a second, ``burst`` at most; ``take`` waits for one."""

    def __init__(self, rate: float, burst: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.at = float(burst), clock()

    def take(self) -> None:
        now = self.clock()
        self.tokens = min(self.burst, self.tokens + (now - self.at) * self.rate)
        self.at = now
        if self.tokens < 1:
            self.sleep((1 - self.tokens) / self.rate)
            self.tokens, self.at = 1.0, self.clock()
        self.tokens -= 1


class Exported:
    """Reads documents that ``export`` wrote to ``store``, a file of a bucket at a time."""

    def __init__(self, options: dict[str, str]) -> None:
        self.files, self.root = pafs.FileSystem.from_uri(options["store"])
        self.buckets = int(options["buckets"])
        self.held: tuple[int, dict[str, dict]] = (-1, {})

    def bucket(self, number: int) -> dict[str, dict]:
        if self.held[0] != number:
            docs: dict[str, dict] = {}
            for f in self.files.get_file_info(pafs.FileSelector(f"{self.root}/bucket={number}", allow_not_found=True)):
                if f.base_name.startswith("part-"):
                    with self.files.open_input_stream(f.path) as lines:
                        docs |= {d["id"]: d for d in map(json.loads, lines.read().decode().splitlines())}
            self.held = (number, docs)
        return self.held[1]

    def fetch(self, ids: Sequence[str], types: frozenset[str] | None) -> list[dict]:
        found = [self.bucket(zlib.crc32(i.encode()) % self.buckets).get(i) for i in ids]
        wanted = lambda a: types is None or a.get("infons", {}).get("type") in types
        return [{**d, "passages": [{**p, "annotations": [a for a in p.get("annotations") or [] if wanted(a)]} for p in d.get("passages") or []]} for d in found if d]


def _bucket(buckets: int):
    return F.pmod(F.crc32(F.col("pmid").cast("string").cast("binary")), F.lit(buckets)).cast("int")


def buckets_for(documents: int) -> int:
    """So many buckets that each has about ``A_BUCKET`` documents; a reader holds one bucket at a time, whatever the store's size."""
    return max(64, -(-documents // A_BUCKET))


def export(docs: DataFrame, store: str, buckets: int = 64) -> None:
    """Documents (pmid, and the whole document as JSON in ``value``) by bucket of the id, for ``Exported``."""
    docs.select(_bucket(buckets).alias("bucket"), "value").repartition("bucket").write.partitionBy("bucket").text(store)


def write_ids(ids: DataFrame, path: str, buckets: int = 64) -> None:
    """The distinct ids of ``pmid``, neighbours of a bucket together; each file becomes a partition."""
    rows = ids.select(F.trim(F.col("pmid").cast("string")).alias("pmid")).where("pmid <> ''").distinct().withColumn("_b", _bucket(buckets))
    rows.repartition("_b").sortWithinPartitions("_b", "pmid").select("pmid").write.parquet(path)


class Share(InputPartition):
    """Ids of one request, or a file of ids."""

    def __init__(self, ids: tuple[str, ...] = (), file: str = "") -> None:
        self.ids, self.file = ids, file


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.size = int(options.get("size", 100))
        self.only: frozenset[str] | None = None
        self.types: frozenset[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = frozenset(f.value) if isinstance(f, In) else frozenset([f.value]) if isinstance(f, EqualTo) else None
            if values is None or f.attribute not in (("pmid",), ("type",)):
                yield f
            elif f.attribute == ("pmid",):
                self.only = values if self.only is None else self.only & values
            else:
                self.types = values if self.types is None else self.types & values

    def _kept(self, ids: Sequence[str]) -> list[str]:
        known = dict.fromkeys(x for i in ids if i and (x := i.strip()))
        wrong = next((i for i in known if not i.isdecimal()), None)
        if wrong is not None:
            raise ValueError(f"{wrong!r} is no publication id")
        return [i for i in known if self.only is None or i in self.only]

    def partitions(self) -> list[Share]:
        if "ids_path" in self.options:
            files, root = pafs.FileSystem.from_uri(self.options["ids_path"])
            names = sorted(f.path for f in files.get_file_info(pafs.FileSelector(root)) if f.base_name.startswith("part-"))
            return [Share(file=n) for n in names]
        ids = self._kept(self.options.get("ids", "").split(","))
        return [Share(tuple(ids[i : i + self.size])) for i in range(0, len(ids), self.size)]

    def _ids(self, share: Share) -> Iterator[list[str]]:
        """The ids of a share, a request at a time."""
        if not share.file:
            yield list(share.ids)
            return
        files, _ = pafs.FileSystem.from_uri(self.options["ids_path"])
        waiting: list[str] = []
        with files.open_input_file(share.file) as source:
            for batch in pq.ParquetFile(source).iter_batches(columns=["pmid"]):
                waiting += self._kept(batch.column(0).to_pylist())
                while len(waiting) >= self.size:
                    yield waiting[: self.size]
                    waiting = waiting[self.size :]
        if waiting:
            yield waiting

    def read(self, partition: Share | None) -> Iterator[pa.RecordBatch]:
        if partition is None or self.types == frozenset():  # no ids, or types that exclude each other
            return
        module, _, factory = self.options.get("transport", "paperloom.sources.service:Exported").partition(":")
        transport: Transport = getattr(import_module(module), factory)(self.options)
        rate = float(self.options.get("rate", 0))
        bucket = Bucket(rate, int(self.options.get("burst", 1))) if rate else None

        def asked(ids: list[str]) -> list[dict]:
            if bucket:
                bucket.take()
            return transport.fetch(ids, self.types)

        for ids in self._ids(partition):
            docs = retried(lambda ids=ids: asked(ids), int(self.options.get("times", 3)), float(self.options.get("wait", 0.5)))
            rows = [
                {
                    "pmid": d["id"], "passage_idx": k, "ann_id": a.get("id"), "label": a.get("text"), "type": (a.get("infons") or {}).get("type"),
                    "identifier": (a.get("infons") or {}).get("identifier") or "", "pos": next((x.get("offset") for x in a.get("locations") or []), None),
                }
                for d in docs for k, p in enumerate(d.get("passages") or []) for a in p.get("annotations") or []
            ]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class Publications(DataSource):
    @classmethod
    def name(cls) -> str:
        return "publications"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets its reader see filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(Publications)
