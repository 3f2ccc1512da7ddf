"""Ingest manifests: change detection, upsert, summary, JSON form."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = "source_path string, content_hash string, size_bytes long, modified_time string, last_ingested string"


def diff(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """docs with status new, unchanged or changed, by path and content hash."""
    known = manifest.select("source_path", F.col("content_hash").alias("_known"))
    status = F.when(F.col("_known").isNull(), F.lit("new")).when(F.col("_known") == F.col("content_hash"), F.lit("unchanged")).otherwise(F.lit("changed"))
    return docs.join(known, "source_path", "left").withColumn("status", status).drop("_known")


def upsert(manifest: DataFrame, docs: DataFrame) -> DataFrame:
    """The manifest after ingesting docs: every seen path is renewed, others stay.

    Of rows that share a path the one ingested last wins, then the one modified last, then by hash.
    """
    newest = F.max(F.struct("last_ingested", "modified_time", "content_hash", "size_bytes")).alias("n")
    names = ("content_hash", "size_bytes", "modified_time", "last_ingested")
    fresh = docs.groupBy("source_path").agg(newest).select("source_path", *[F.col(f"n.{c}").alias(c) for c in names])
    return manifest.join(fresh.select("source_path"), "source_path", "left_anti").select(*fresh.columns).unionByName(fresh)


def remove(manifest: DataFrame, paths: list[str]) -> DataFrame:
    return manifest.where(~F.col("source_path").isin(paths)) if paths else manifest


def summary(statuses: DataFrame) -> DataFrame:
    """One row of counts by status."""
    names = ("new", "changed", "unchanged", "skipped", "error")
    return statuses.agg(F.count(F.lit(1)).alias("total_files"), *[F.count_if(F.col("status") == n).alias(f"{n}_files") for n in names])


def to_json(manifest: DataFrame) -> str:
    """The manifest file's text; a manifest is collected because the file is one JSON object."""
    rows = [r.asDict() for r in manifest.orderBy("source_path").collect()]
    return json.dumps({"version": "1.0", "entries": rows}, indent=2, ensure_ascii=False)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a manifest file; a corrupt one raises."""
    schema = f"version string, entries array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>"
    whole = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = whole.collect()
    if len(rows) != 1 or rows[0]["entries"] is None:
        raise ValueError(f"corrupt manifest: {path}")
    entries = rows[0]["entries"]
    if any(e is None or e["source_path"] is None for e in entries):
        raise ValueError(f"corrupt manifest: {path}")
    return spark.createDataFrame([tuple(e) for e in entries], ENTRY)


def source_hashes(spark: SparkSession, text: str) -> tuple[DataFrame | None, str | None]:
    """(key -> content_hash table, None) from a source manifest's text, or (None, what is wrong).

    `entries` are keyed by source_path, else `documents` by document_id; the last of a key wins.
    """
    try:
        data = json.loads(text)
    except json.JSONDecodeError:
        return None, "not valid JSON"
    if not isinstance(data, dict):
        return None, "root is not an object"
    name, key = ("entries", "source_path") if "entries" in data else ("documents", "document_id")
    rows = data.get(name)
    if not isinstance(rows, list):
        return None, "no entries or documents list"
    pairs = []
    for k, row in enumerate(rows):
        if not isinstance(row, dict) or not row.get(key) or not row.get("content_hash"):
            return None, f"{name}[{k}] lacks {key} or content_hash"
        pairs.append((str(row[key]), str(row["content_hash"]), k))
    table = spark.createDataFrame(pairs, "key string, content_hash string, position int")
    last = Window.partitionBy("key").orderBy(F.desc("position"))
    return table.withColumn("_r", F.row_number().over(last)).where("_r = 1").select("key", "content_hash"), None
