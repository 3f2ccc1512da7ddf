"""A corpus that is kept up to date: only documents that are new or changed are worked on again.

The manifest decides (by path and content hash) what a run has to do; chunks, refined texts,
roll-ups and term counts of those documents replace the old ones by path in versioned stores, those
of documents that are gone are deleted, and everything else stays as it was written. A run that
stops half way is finished by the next one: the manifest is written last.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.config import ChunkConfig
from proofmill.functions import text
from proofmill.operators import refine
from proofmill.operators.chunk import chunk
from proofmill.sources import manifest
from proofmill.sources.store import ChunkStore

KEY = "source_path"


@dataclass
class Run:
    """What a run did: its statuses (source_path, status) and how many documents it worked on."""

    statuses: DataFrame
    recomputed: int
    removed: int


class IncrementalCorpus:
    """Versioned tables of a corpus below one folder."""

    def __init__(self, spark: SparkSession, path: str, config: ChunkConfig | None = None, shards: int = 16):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config
        store = lambda name: ChunkStore(spark, f"{self.path}/{name}", shards, KEY)
        self.manifest, self.chunks, self.rollups, self.terms = map(store, ("manifest", "chunks", "rollups", "terms"))

    def _known(self) -> DataFrame:
        names = [c.split()[0] for c in manifest.ENTRY.split(", ")]
        return self.manifest.read().select(*names) if self.manifest.version() else self.spark.createDataFrame([], manifest.ENTRY)

    def ingest(self, docs: DataFrame, modified_time: str = "", last_ingested: str = "") -> Run:
        """Brings the corpus to `docs`: all documents (document_id, source_path, content_hash, size_bytes, raw_text, ...)."""
        known, number = self._known(), self.manifest.version() + 1
        statuses = manifest.diff(docs, known)
        at = f"{self.path}/work/{uuid.uuid4().hex}"  # written once: what follows reads these documents alone
        statuses.where("status <> 'unchanged'").write.parquet(at)
        work = self.spark.read.schema(statuses.schema).parquet(at)
        gone = known.select(KEY).join(docs.select(KEY), KEY, "left_anti")
        removed, recomputed = gone.count(), work.count()
        if recomputed:
            paths = work.select("document_id", KEY)
            refined = refine.refine_chunks(chunk(work.drop("status"), self.config)).withColumn("run", F.lit(number))
            self.chunks.replace(refined, paths)
            own = self.chunks.read().where(F.col("run") == number)
            self.rollups.replace(refine.document_rollup(own).join(paths, "document_id").withColumn("run", F.lit(number)), paths)
            tokens = own.select(KEY, F.explode(text.tokens(F.col("cleaned_text"))).alias("token"))
            self.terms.replace(tokens.groupBy(KEY, "token").agg(F.count(F.lit(1)).alias("n")), paths)
        if removed:
            for store in (self.chunks, self.rollups, self.terms):
                store.delete_documents(gone)
        named = work.select(KEY, "content_hash", "size_bytes", F.lit(modified_time).alias("modified_time"), F.lit(last_ingested).alias("last_ingested"))
        self.manifest.replace(named, work.select(KEY).unionByName(gone))
        return Run(statuses.select(KEY, "status"), recomputed, removed)

    def document_frequencies(self) -> DataFrame:
        """token, documents, n over the whole corpus, from the stored counts."""
        return self.terms.read().groupBy("token").agg(F.countDistinct(KEY).alias("documents"), F.sum("n").alias("n"))
