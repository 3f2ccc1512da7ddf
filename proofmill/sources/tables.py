"""The data model's inputs from tables: documents, manifests, chunk corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.config import ChunkConfig
from proofmill.functions import ids
from proofmill.operators.chunk import chunk
from proofmill.operators.refine import clean_chunks


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer splits than that (one small file); else df itself."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def text_documents(rows: DataFrame, path, text: str = "text", metadata: dict | None = None) -> DataFrame:
    """Rows of any table as documents: `path` is a Column that names each."""
    body = F.coalesce(F.col(text), F.lit(""))
    meta = F.create_map(*[x for k, c in (metadata or {}).items() for x in (F.lit(k), c)]) if metadata else F.create_map().cast("map<string,string>")
    named = rows.select(path.alias("source_path"), body.alias("raw_text"), meta.alias("metadata"))
    hashed = named.withColumn("content_hash", ids.sha(F.col("raw_text")))
    return hashed.select(
        ids.document_id(F.col("source_path"), F.col("content_hash")).alias("document_id"), "source_path", ids.source_type(F.col("source_path")).alias("source_type"),
        "content_hash", F.octet_length("raw_text").cast("long").alias("size_bytes"), "raw_text", "metadata",
    )


def table_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `documents` table under synthesized paths."""
    rows = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    suffix = F.when(F.col("doc_id") % 2 == 0, F.lit(".md")).otherwise(F.lit(".txt"))
    path = F.concat(F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), suffix)
    return text_documents(rows, path, metadata={"lang": F.col("lang"), "source": F.col("source")})


def corpus(docs: DataFrame, config: ChunkConfig | None = None) -> DataFrame:
    """Candidate rows: chunked and refined documents, ready for retrieval."""
    refined = clean_chunks(chunk(docs, config))
    return refined.select("document_id", "chunk_id", "chunk_index", "source_path", "source_type", "raw_text", "cleaned_text", "raw_text_hash", "cleaned_text_hash", "metadata")
