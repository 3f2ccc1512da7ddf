"""Queries over the driver's tables, one per operator of the survey, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.config import ChunkConfig, ContextPolicy, EvidenceBudget, MetadataFilter, RetrievalRequest, SelectionPolicy
from proofmill.functions import ids, text
from proofmill.operators import health, notes, pack, refine, retrieve, vault
from proofmill.operators.chunk import chunk
from proofmill.plans import fixtures, oracle
from proofmill.sources import manifest
from proofmill.sources.tables import corpus, table_documents, text_documents

QUERY, OTHER = "the heat of ention, and the 2 eses", "leur dans le monde entier la"
BUDGET = EvidenceBudget(max_items=9, max_raw_chars=6000, max_cleaned_chars=5600, max_context_chars=9000)
S = SparkSession
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _corpus(spark: S, sf_dir: str) -> DataFrame:
    return corpus(table_documents(spark, sf_dir))


def _request(q: str = QUERY, **more) -> RetrievalRequest:
    return RetrievalRequest(q, top_k=20, retrieval_run_id="run_1", **more)


def _results(spark: S, sf_dir: str) -> DataFrame:
    return retrieve.local(retrieve.retrieve(_corpus(spark, sf_dir), _request()))


def _round(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


@query
def document_ids(spark: S, sf_dir: str) -> DataFrame:
    return table_documents(spark, sf_dir).select("document_id", "source_path", "source_type", "content_hash", "size_bytes")


@query
def manifest_diff(spark: S, sf_dir: str) -> DataFrame:
    return manifest.diff(table_documents(spark, sf_dir), fixtures.previous_manifest(spark, sf_dir)).select("document_id", "source_path", "status")


@query
def ingest_summary(spark: S, sf_dir: str) -> DataFrame:
    return manifest.summary(manifest_diff(spark, sf_dir))


@query
def manifest_upsert(spark: S, sf_dir: str) -> DataFrame:
    """Every document ingested again, beside entries of files that are no longer there."""
    known = fixtures.previous_manifest(spark, sf_dir)
    known = known.unionByName(known.withColumn("source_path", F.concat(F.lit("removed/"), "source_path")))
    now = table_documents(spark, sf_dir).withColumns({"modified_time": F.lit("now"), "last_ingested": F.lit("now")})
    return manifest.upsert(known, now).select("source_path", "content_hash", "size_bytes", "last_ingested")


@query
def content_duplicates(spark: S, sf_dir: str) -> DataFrame:
    rows = table_documents(spark, sf_dir).select(F.lit("run").alias("retrieval_run_id"), F.col("content_hash").alias("query_hash"), "document_id", F.col("content_hash").alias("raw_text_hash"), F.col("document_id").alias("rank"))
    marked = pack.deduplicate(rows, SelectionPolicy(deduplicate_by="raw_text_hash"))
    return marked.select("document_id", "raw_text_hash", F.col("reason").isNull().alias("kept"))


@query
def chunks_default(spark: S, sf_dir: str) -> DataFrame:
    return chunk(table_documents(spark, sf_dir)).select("chunk_id", "document_id", "chunk_index", "start_offset", "end_offset", "raw_text_hash")


@query
def chunks_overlap(spark: S, sf_dir: str) -> DataFrame:
    return chunk(table_documents(spark, sf_dir), ChunkConfig(400, 60)).select("chunk_id", "document_id", "chunk_index", "start_offset", "end_offset", "raw_text_hash")


@query
def chunks_hard(spark: S, sf_dir: str) -> DataFrame:
    rows = chunk(table_documents(spark, sf_dir), ChunkConfig(1000, 0, False))
    return rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("end_offset").alias("length"), F.min(F.length("raw_text")).alias("least"))


@query
def chunk_stats(spark: S, sf_dir: str) -> DataFrame:
    return refine.document_rollup(refine.refine_chunks(chunk(table_documents(spark, sf_dir)))).select(
        "document_id", "total_chunks", "total_raw_chars", "total_cleaned_chars", F.size("warnings").alias("n_warnings"), "refinement_method"
    )


@query
def chunk_integrity(spark: S, sf_dir: str) -> DataFrame:
    docs = table_documents(spark, sf_dir)
    rows = chunk(docs.withColumn("whole", F.col("raw_text")))
    cut = F.substr("whole", F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))
    good = (ids.sha(F.col("raw_text")) == F.col("raw_text_hash")) & (cut == F.col("raw_text")) & (F.length("raw_text") <= 1000)
    return rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(good).alias("good"))


@query
def refine_noisy(spark: S, sf_dir: str) -> DataFrame:
    rows = fixtures.raw_documents(spark, sf_dir).select("doc_id", fixtures.tables_in(F.col("text"), F.col("doc_id")).alias("raw"))
    cleaned = refine.refine(F.col("raw"))
    return rows.withColumn("c", cleaned).select("doc_id", F.sha2("c", 256).alias("cleaned_hash"), F.length("c").alias("cleaned_length"))


@query
def protected_lines(spark: S, sf_dir: str) -> DataFrame:
    lines = fixtures.raw_documents(spark, sf_dir).select("doc_id", F.explode(F.split(fixtures.tables_in(F.col("text"), F.col("doc_id")), "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(refine.protected(F.col("line"))).alias("protected_lines"), F.count(F.lit(1)).alias("lines"))


def _altered(spark: S, sf_dir: str) -> DataFrame:
    """Every document; a null text is an empty one."""
    body = F.coalesce(F.col("text"), F.lit(""))
    return fixtures.raw_documents(spark, sf_dir).select("doc_id", body.alias("raw"), fixtures.altered(body, F.col("doc_id")).alias("cleaned"))


@query
def safeguard(spark: S, sf_dir: str) -> DataFrame:
    rows = _altered(spark, sf_dir).withColumn("f", refine.check_facts(F.col("raw"), F.col("cleaned")))
    return rows.select("doc_id", F.array_join("f.added_words", ",").alias("added_words"), F.array_join("f.added_numbers", ",").alias("added_numbers"), F.round("f.length_expansion", 6).alias("length_expansion"), "f.empty_cleaned", "f.excessive_changes")


@query
def guardrail_results(spark: S, sf_dir: str) -> DataFrame:
    rows = _altered(spark, sf_dir).withColumn("g", refine.guardrails(F.col("raw"), F.col("cleaned")))
    kinds = F.transform("g.violations", lambda v: F.regexp_extract(v, "^([a-z_]+)", 1))
    return rows.select("doc_id", "g.passed", F.array_join(kinds, ",").alias("violations"))


@query
def critical_tokens(spark: S, sf_dir: str) -> DataFrame:
    rows = _altered(spark, sf_dir).withColumn("t", F.array_sort(text.critical_set(F.col("raw"))))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query
def model_replies(spark: S, sf_dir: str) -> DataFrame:
    k = F.col("conv_id") % 5
    body = F.to_json(F.struct(F.col("text").alias("cleaned_text")))
    reply = F.when(k == 0, body).when(k == 1, F.lit("{broken")).when(k == 2, F.lit("[1]")).when(k == 3, F.lit('{"other": 1}')).otherwise(F.lit('{"cleaned_text": 7}'))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select("conv_id", "turn", refine.json_problem(reply).alias("problem"))


@query
def tokenize_stats(spark: S, sf_dir: str) -> DataFrame:
    rows = table_documents(spark, sf_dir).withColumn("t", text.tokens(F.col("raw_text")))
    return rows.select("document_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.size(F.filter("t", lambda x: x == "the")).alias("n_the"))


@query
def term_counts(spark: S, sf_dir: str) -> DataFrame:
    rows = table_documents(spark, sf_dir).select(F.explode(text.tokens(F.col("raw_text"))).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query
def keyword_topk(spark: S, sf_dir: str) -> DataFrame:
    found = retrieve.keyword_lists(_corpus(spark, sf_dir), _request(), ("raw_only", "cleaned_only", "dual_context"), 20)
    return found.select("policy", "chunk_id", *_round("keyword_score"), F.array_join("matched_fields", ",").alias("matched"))


@query
def vector_topk(spark: S, sf_dir: str) -> DataFrame:
    return retrieve.vector_hits(_corpus(spark, sf_dir), _request(), "raw_only", 20).select("chunk_id", *_round("vector_score"), "retrieval_source", "score_policy")


@query
def hybrid_topk(spark: S, sf_dir: str) -> DataFrame:
    found = retrieve.retrieve(_corpus(spark, sf_dir), _request(), alphas=(0.0, 0.5, 1.0))
    return found.select("alpha", "rank", "chunk_id", *_round("keyword_score", "vector_score", "hybrid_score"), "total_candidates")


@query
def hybrid_filtered(spark: S, sf_dir: str) -> DataFrame:
    chosen = MetadataFilter(source_type="md", key_value={"lang": "fr"})
    found = retrieve.retrieve(_corpus(spark, sf_dir), _request(OTHER, filters=chosen, text_policy="raw_only"))
    return found.select("rank", "chunk_id", *_round("hybrid_score"), F.array_join("applied_filters", ", ").alias("applied_filters"))


@query
def retrieval_trace(spark: S, sf_dir: str) -> DataFrame:
    found = _results(spark, sf_dir)
    return found.select("rank", "document_id", "chunk_id", "source_path", "raw_text_hash", "retrieval_source", F.array_join("source_retrievers", ",").alias("source_retrievers"), F.array_join("matched_fields", ",").alias("matched_fields"), "score_policy", "query_hash", "retrieval_run_id")


@query
def batch_retrieval(spark: S, sf_dir: str) -> DataFrame:
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieve.retrieve_batch(_corpus(spark, sf_dir), asked, top_k=5).select("query_id", "rank", "chunk_id", *_round("keyword_score", "vector_score", "hybrid_score"))


@query
def embedding_topk(spark: S, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    first = [float(x) for x in vectors.where("vec_id = 0").first()["embedding"]]
    return retrieve.embedding_hits(vectors, first, 20).select("vec_id", *_round("score"))


@query
def retrieval_quality(spark: S, sf_dir: str) -> DataFrame:
    """Recall, precision and reciprocal rank of the batch, where a document that holds the item is relevant."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("item"))
    docs = table_documents(spark, sf_dir).select("document_id", "raw_text")
    relevant = retrieve.holding(docs, items)
    asked = items.select("query_id", F.col("item").alias("query"))
    found = retrieve.retrieve_batch(_corpus(spark, sf_dir), asked, top_k=5, alpha=0.0)
    return retrieve.quality(found, relevant, 5).select("query_id", *_round("recall", "precision", "reciprocal_rank"))


@query
def pack_dedupe(spark: S, sf_dir: str) -> DataFrame:
    found, out = _results(spark, sf_dir), None
    for key in ("document_chunk", "raw_text_hash"):
        twice = found.unionByName(found.withColumn("rank", F.col("rank") + 20)) if key == "document_chunk" else found
        one = pack.deduplicate(twice, SelectionPolicy(deduplicate_by=key)).select(F.lit(key).alias("dedupe_key"), "rank", "chunk_id", "reason", "detail")
        out = one if out is None else out.unionByName(one)
    return out


@query
def pack_max_items(spark: S, sf_dir: str) -> DataFrame:
    return pack.select_items(_results(spark, sf_dir), budget=EvidenceBudget(max_items=7)).select("rank", "chunk_id", "reason", "item_no")


@query
def pack_budget(spark: S, sf_dir: str) -> DataFrame:
    return pack.select_items(_results(spark, sf_dir), budget=BUDGET).select("rank", "chunk_id", "reason", "item_no")


@query
def pack_exclusions(spark: S, sf_dir: str) -> DataFrame:
    rows = pack.select_items(_results(spark, sf_dir), SelectionPolicy(deduplicate_by="raw_text_hash"), BUDGET)
    return pack.exclusions(rows).groupBy("reason", "budget_field").agg(F.count(F.lit(1)).alias("n"), F.min("exclusion_no").alias("first_no"))


@query
def pack_context(spark: S, sf_dir: str) -> DataFrame:
    built, out = _results(spark, sf_dir), None
    for budget, context in ((BUDGET, ContextPolicy()), (None, ContextPolicy(include_cleaned_text=False))):
        one = pack.build_pack(built, None, budget, context).select("pack_id", F.sha2("context", 256).alias("context_hash"), F.length("context").alias("context_chars"), "total_input_results", "total_selected_items", "total_excluded_items")
        out = one if out is None else out.unionByName(one)
    return out


@query
def pack_json(spark: S, sf_dir: str) -> DataFrame:
    packs = pack.build_pack(_results(spark, sf_dir), None, BUDGET)
    again = pack.from_json(pack.to_json(packs), packs.schema)
    return again.select("pack_id", F.sha2("context", 256).alias("context_hash"), F.size("items").alias("items"), F.size("exclusions").alias("excluded"))


@query
def slugs(spark: S, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    title = F.concat(F.lit("  "), F.col("p_name"), F.lit(": "), F.col("p_brand"), F.lit("!"))
    return rows.select("p_partkey", text.slug(title).alias("slug"), ids.note_filename(title, F.concat(F.lit("Note "), F.col("p_partkey").cast("string"))).alias("file_name"))


@query
def note_render(spark: S, sf_dir: str) -> DataFrame:
    done = notes.render(fixtures.source_notes(spark, sf_dir))
    return done.select("note_id", "file_name", F.length("markdown").alias("chars"), F.sha2("markdown", 256).alias("markdown_hash"))


@query
def note_export(spark: S, sf_dir: str) -> DataFrame:
    rows = fixtures.source_notes(spark, sf_dir)
    meta = F.col("metadata").withField("validation_status", F.when(F.col("doc_id") % 3 == 1, F.lit("draft")).otherwise(F.lit("validated"))).withField("note_id", F.when(F.col("doc_id") % 4 == 2, F.lit("other")).otherwise(F.col("metadata.note_id")))
    return notes.export_plan(rows.withColumn("metadata", meta)).select("note_id", "rejection_reason")


@query
def lint_issues(spark: S, sf_dir: str) -> DataFrame:
    return health.lint(fixtures.faulty_files(spark, sf_dir)).select("file_path", "code", "severity")


@query
def lint_report(spark: S, sf_dir: str) -> DataFrame:
    files = fixtures.faulty_files(spark, sf_dir)
    return health.report(files, health.lint(files))


@query
def citation_unresolved(spark: S, sf_dir: str) -> DataFrame:
    found = health.lint(fixtures.faulty_files(spark, sf_dir))
    return found.where("code in ('citation_unresolved', 'evidence_count_mismatch')").select("file_path", "code", "message")


@query
def duplicate_note_id(spark: S, sf_dir: str) -> DataFrame:
    return health.cross_issues(health.parse(fixtures.faulty_files(spark, sf_dir))).where("code = 'duplicate_note_id'").select("file_path", "message")


@query
def source_drift(spark: S, sf_dir: str) -> DataFrame:
    known = fixtures.raw_documents(spark, sf_dir).where("doc_id % 4 != 0").select(
        F.concat(F.lit("src/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("key"), F.sha2(F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.lit("x")).otherwise(F.lit(""))), 256).alias("content_hash")
    )
    return health.drift_issues(health.parse(fixtures.faulty_files(spark, sf_dir)), known).groupBy("code", "file_path").agg(F.count(F.lit(1)).alias("n"))


def _plan(spark: S, sf_dir: str) -> DataFrame:
    files = fixtures.faulty_files(spark, sf_dir)
    moved = files.withColumn("file_path", F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("wiki/Sub/NOTE"), F.col("doc_id") % 22, F.lit(".md"))).otherwise(F.col("file_path")))
    there = files.where("doc_id % 19 = 0").select(F.regexp_replace("file_path", "^wiki/", "Vault/Notes/").alias("relative_destination"))
    # paths repeat in Sub: their documents' numbers tell them apart
    unique = moved.withColumn("file_path", F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("wiki/s"), F.col("doc_id").cast("string"), F.lit("/NOTE"), (F.col("doc_id") % 22).cast("string"), F.lit(".md"))).otherwise(F.col("file_path")))
    return vault.plan(unique, there, vault.VaultConfig(allow_unhealthy=True), "wiki")


@query
def vault_plan(spark: S, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).select("relative_source", "relative_destination", "rejected", "collision", "skipped")


@query
def index_by_type(spark: S, sf_dir: str) -> DataFrame:
    return vault.grouped_links(_plan(spark, sf_dir), "note_type").select("group", F.size("lines").alias("n"))


@query
def index_by_source(spark: S, sf_dir: str) -> DataFrame:
    return vault.grouped_links(_plan(spark, sf_dir), "source").select("group", F.size("lines").alias("n"), F.array_join("lines", "\n").alias("lines"))


@query
def conversation_chunks(spark: S, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    docs = text_documents(rows, F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(".txt")))
    return chunk(docs, ChunkConfig(300)).select("source_path", "chunk_id", "start_offset", "end_offset", "raw_text_hash")


@query
def page_sources(spark: S, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, F.lit(".MD")).when(F.col("page_id") % 3 == 1, F.lit(".html")).otherwise(F.lit(".markdown")))
    docs = text_documents(rows, path, "html")
    return docs.select("document_id", "source_path", "source_type", ids.supported_file(F.col("source_path")).alias("supported"), "size_bytes")


ORACLE = {name: sql for name, sql in oracle.SQL.items() if name in QUERIES}
