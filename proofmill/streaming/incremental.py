"""Incremental ingest: each micro-batch is diffed against the manifest and upserted into it.

Spark's file source remembers paths, so a file that changes under its old name needs a batch
ingest; a stream of document rows (path, text) has no such limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from proofmill.sources import manifest


def ingest_stream(docs: DataFrame, manifest_path: str, statuses_path: str, checkpoint: str) -> StreamingQuery:
    """Starts the stream; manifests are versions `v=<batch>` so that a replayed batch redoes its own.

    docs: a streaming DataFrame with source_path, content_hash, size_bytes, modified_time, last_ingested.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = latest(spark, manifest_path, number)
        manifest.diff(batch, known).write.mode("overwrite").parquet(f"{statuses_path}/v={number}")
        manifest.upsert(known, batch).write.mode("overwrite").parquet(f"{manifest_path}/v={number}")

    return docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark, manifest_path: str, before: int | None = None) -> DataFrame:
    """The newest manifest version (older than `before`), or an empty one."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(manifest_path)
    fs = at.getFileSystem(conf)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    versions = sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{manifest_path}/{n}/_SUCCESS")))
    versions = [v for v in versions if before is None or v < before]
    return spark.read.schema(manifest.ENTRY).parquet(f"{manifest_path}/v={versions[-1]}") if versions else spark.createDataFrame([], manifest.ENTRY)
