"""Deterministic inputs that exercise every branch: noisy texts, altered texts, notes with faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.config import Branding
from proofmill.functions import ids
from proofmill.operators import notes
from proofmill.sources.tables import spread, table_documents

FAULTS = 13


def noisy(text: Column) -> Column:
    wide = F.replace(F.replace(text, F.lit(", "), F.lit(",    ")), F.lit(". "), F.lit(".\n\n\n\n"))
    return F.concat(F.lit("  "), wide, F.lit("  "))


def tables_in(text: Column, doc_id: Column) -> Column:
    """Every third document gets a table, a key/value line and code in front."""
    return F.when(doc_id % 3 == 0, F.concat(F.lit("| a  |  b |\nkey:   1,  2\n    code  here\n"), noisy(text))).otherwise(noisy(text))


def altered(text: Column, doc_id: Column) -> Column:
    """A would-be model answer: unchanged, with a new word, a new number, without a number, cut, or empty."""
    k = doc_id % 6
    return (
        F.when(k == 0, text)
        .when(k == 1, F.concat(text, F.lit(" zzunheard newword")))
        .when(k == 2, F.concat(text, F.lit(" 987654321")))
        .when(k == 3, F.regexp_replace(text, "[0-9]", ""))
        .when(k == 4, F.substr(text, F.lit(1), F.floor(F.length(text) / 2).cast("int")))
        .otherwise(F.lit(""))
    )


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def source_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One note per document: two cited chunks under one label, a second label, an unsupported claim on every fifth."""
    rows = raw_documents(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("h"), "lang")
    d = F.col("doc_id").cast("string")
    none = F.lit("")
    doc, chunk = F.concat(F.lit("doc_"), d), lambda k: F.concat(F.lit("chunk_doc_"), d, F.lit(f"_{k}"))
    ref = lambda label, k, path="": F.struct(F.lit(label).alias("label"), doc.alias("document_id"), chunk(k).alias("chunk_id"), (F.lit(path) if isinstance(path, str) else path).alias("source_path"), F.col("h").alias("source_raw_hash"), none.alias("raw_text_hash"), none.alias("evidence_text_hash"), F.when(F.lit(k) == 1, F.lit("first line\n\nlast line")).otherwise(none).alias("excerpt"))
    claim = lambda said, refs, bare=False: F.struct(F.concat(F.lit(said), d).alias("statement"), refs.cast(f"array<{notes.REF}>").alias("evidence_refs"), F.lit(bare).alias("unsupported"))
    supported = F.array(claim("First statement of ", F.array(ref("E1", 0))), claim("Second statement of ", F.array(ref("E1", 1), ref("E2", 2), ref("E1", 0))))
    claims = F.when(F.col("doc_id") % 5 == 0, F.concat(supported, F.array(claim("Open question of ", F.array().cast(f"array<{notes.REF}>"), True)))).otherwise(supported)
    path = F.concat(F.lit("src/"), F.col("lang"), F.lit("/"), d, F.lit(".md"))
    note_id = F.concat(F.lit("note_"), d)
    lit = lambda v: F.lit(v).cast("string")
    meta = F.struct(
        note_id.alias("note_id"), lit("compiled_knowledge_wiki_note").alias("note_type"), lit("proposal").alias("status"), lit("2024-01-02T03:04:05+00:00").alias("generated_at"),
        lit("proofmill").alias("generated_by"), lit("0.1.0").alias("generator_version"), lit("wiki-export-v1").alias("schema_version"), lit("raw_text_authoritative").alias("source_policy"),
        lit("validated").alias("validation_status"), F.when(F.col("doc_id") % 2 == 0, F.lit("high")).alias("confidence"), F.lit(3).alias("evidence_count"),
        F.array(F.struct(doc.alias("document_id"), path.alias("source_path"), F.col("h").alias("source_raw_hash"), none.alias("content_hash"))).alias("source_documents"),
        F.array(F.struct(doc.alias("document_id"), chunk(0).alias("chunk_id"), none.alias("source_raw_hash"), F.col("h").alias("raw_text_hash"), none.alias("cleaned_text_hash"), none.alias("evidence_text_hash"))).alias("source_chunks"),
    )
    title = F.concat(F.lit('Doc "'), d, F.lit('": '), F.col("lang"))
    extra = F.array(ref("ignored", 0, path))
    return rows.select("doc_id", note_id.alias("note_id"), title.alias("title"), F.when(F.col("doc_id") % 7 == 0, F.lit("A summary.")).otherwise(none).alias("summary"), claims.alias("claims"), extra.cast(f"array<{notes.REF}>").alias("source_evidence"), meta.alias("metadata"))


def faulty_files(spark: SparkSession, sf_dir: str, brand: Branding = Branding()) -> DataFrame:  # noqa: B008  frozen
    """doc_id, file_path, content: rendered notes, each 13th with one of twelve faults, each 17th with a shared note id."""
    rows = notes.render(source_notes(spark, sf_dir), brand).withColumn("c", F.col("markdown"))
    swap = lambda a, b: F.replace(F.col("c"), F.lit(a), F.lit(b))
    k = F.col("doc_id") % FAULTS
    made = {
        1: F.concat(F.lit("Plain text.\n"), F.regexp_replace("c", r"(?s)^---.*?\n---\n", "")), 2: F.lit('---\nnote_id: "x"\nno closing line'),
        3: swap('note_type: "compiled_knowledge_wiki_note"', 'note_type: "diary"'), 4: swap('status: "proposal"', 'status: "lost"'),
        5: swap('validation_status: "validated"', 'validation_status: "validation_required"'), 6: swap("evidence_count: 3", "evidence_count: 9"),
        7: F.regexp_replace("c", r"(- First statement of [0-9]+) \[E1\]", "$1"), 8: swap("[E1-2, E2, E1]", "[E1-2, E7, E1]"),
        9: swap(f"## {brand.metadata_heading}", "## Something Else"), 10: swap("### E2", "### E1"), 11: F.regexp_replace("c", r"(### E2\n\n)- \*\*Document\*\*: [^\n]*\n", "$1"),
        12: swap('source_policy: "raw_text_authoritative"', 'source_policy: "any"'),
    }
    content = F.col("c")
    for n, changed in made.items():
        content = F.when(k == n, changed).otherwise(content)
    shared = F.when((F.col("doc_id") % 17 == 0) & (k == 0), F.regexp_replace(content, 'note_id: "note_[0-9]+"', 'note_id: "note_shared"')).otherwise(content)
    return rows.select("doc_id", F.concat(F.lit("wiki/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".md")).alias("file_path"), shared.alias("content"))


def previous_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an earlier run knew: nine of ten documents, one of ten under another hash."""
    docs = table_documents(spark, sf_dir).withColumn("n", F.regexp_extract("source_path", "doc_([0-9]+)", 1).cast("long"))
    changed = F.when(F.col("n") % 10 == 1, ids.sha(F.col("content_hash"))).otherwise(F.col("content_hash"))
    return docs.where("n % 10 != 0").select("source_path", changed.alias("content_hash"), "size_bytes", F.lit("2024-01-01T00:00:00+00:00").alias("modified_time"), F.lit("2024-01-01T00:00:00+00:00").alias("last_ingested"))
