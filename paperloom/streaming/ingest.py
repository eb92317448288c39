"""Annotated documents as a stream: new export files go to a store batch by batch, and an ingest that was stopped goes on where it was.

A record is an export with its documents under one of the known envelopes. Its annotations and passages are stored; a record that is no
JSON, or has no known envelope, goes to a side table with its text and doesn't stop the ingest. Every table of the store is parted by the
number of the batch, and a batch that runs again after a failure replaces its own part, so no row is stored twice or lost.

Cases: an empty line is no record; a record without documents stores nothing; a document without passages, or a passage without
annotations, gives no annotation; repeated documents in different records are stored as they come (``latest`` keeps one); an empty folder gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.sources import folders, readers

TABLES = ("documents", "annotations", "rejected")
_RECORD = ", ".join(f"`{e}` {readers.DOCUMENT}" for e in readers.ENVELOPES)


def records(spark: SparkSession, path: str, per_trigger: int = 50, whole_files: bool = False) -> DataFrame:
    """file, value: the records of text files in a folder as they come, one a line, or one a file with ``whole_files``; at most ``per_trigger`` files a batch."""
    lines = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path, wholetext=whole_files)
    return lines.select(F.col("_metadata.file_name").alias("file"), "value").where(F.trim("value") != "")


def parted(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (file, pmid, infons, passages), and what can't be read (file, value, reason)."""
    got = F.from_json("value", f"{_RECORD}, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    read = lines.withColumn("r", got)
    docs = F.coalesce(*[F.col(f"r.{e}") for e in readers.ENVELOPES])
    reason = F.when(F.col("r._corrupt").isNotNull() | F.col("r").isNull(), "no record").when(docs.isNull(), "no known envelope")
    read = read.select("file", "value", docs.alias("docs"), reason.alias("reason"))
    each = read.where("reason IS NULL").select("file", F.explode("docs").alias("d")).where("d IS NOT NULL")
    return each.select("file", F.col("d.id").alias("pmid"), "d.infons", "d.passages"), read.where("reason IS NOT NULL").select("file", "value", "reason")


def started(spark: SparkSession, source: str, store: str, checkpoint: str, per_trigger: int = 50, whole_files: bool = False) -> StreamingQuery:
    """Starts to bring everything that is in ``source`` and not yet in ``store``, and ends with it."""

    def bring(batch: DataFrame, number: int) -> None:
        docs, rejected = parted(batch)
        passages = docs.select("file", "pmid", "infons", F.size(F.coalesce("passages", F.array())).alias("n_passages"))
        for name, df in zip(TABLES, (passages, readers.annotations(docs), rejected), strict=True):
            df.write.mode("overwrite").parquet(f"{store}/{name}/batch={number}")

    stream = records(spark, source, per_trigger, whole_files)
    return stream.writeStream.foreachBatch(bring).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(spark: SparkSession, source: str, store: str, checkpoint: str, per_trigger: int = 50, whole_files: bool = False) -> int:
    """Runs an ingest to its end; the number of batches it brought."""
    query = started(spark, source, store, checkpoint, per_trigger, whole_files)
    query.awaitTermination()
    return sum(1 for p in query.recentProgress if p["numInputRows"])


def stored(spark: SparkSession, store: str, name: str) -> DataFrame:
    """A table of the store, with the number of the batch."""
    empty = spark.createDataFrame([], "file string, value string")
    docs, rejected = parted(empty)
    schema = {"documents": docs.select("file", "pmid", "infons", F.lit(0).alias("n_passages")), "annotations": readers.annotations(docs), "rejected": rejected}[name].withColumn("batch", F.lit(0)).schema
    if not folders.exists(spark, f"{store}/{name}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{store}/{name}")


def latest(documents: DataFrame) -> DataFrame:
    """Of each document the row that came last; of one batch, the one of the greatest file name."""
    last = F.max_by(F.struct(*documents.columns), F.struct("batch", "file", "n_passages"))
    return documents.groupBy("pmid").agg(last.alias("d")).select("d.*")
