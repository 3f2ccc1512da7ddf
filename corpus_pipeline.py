"""The corpus pipeline: each stage is one operator of proofmill.llm, over all its predecessor kept.

language -> near_dedup -> decontaminate -> mix return the columns of `documents`; tokens returns
doc_id, start, n_tokens, ids_crc32 of the written shards. The mix repeats documents, so doc_id
repeats in the last two stages.

Defined cases, by stage: language drops null texts and texts without a letter, keeps a row without
doc_id and every repeated row; near_dedup keeps one row of rows that repeat a doc_id and text, and
of near copies the smallest doc_id (rows without one the first by text); decontaminate keeps null
and empty texts; mix draws by source and doc_id, null source and null doc_id too, so rows that share
both share their draw; tokens orders null doc_id first, then doc_id and text. Very long texts are
read whole in each. Ties go as each operator's module says. An empty table passes through every
stage; columns beside those of `documents`, also of working names, are kept until tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proofmill.llm import decontam, langid, minhash, mixing, tokenbin


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected (no letter, or a score or a strength below its calibrated bound)."""
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (5-word shingles, similarity 0.8) stays."""
    return minhash.drop_near(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's repetition rate says."""
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes, writes the shards, reads them back."""
    return tokenbin.token_output(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

#: No SQL: trained language scores, near-duplicate components and the tokenizer are outside it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written as Parquet and reread."""
    from proofmill.llm.common import Workspace

    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = space.save(stage(spark, docs, sf_dir), name)
    return docs
