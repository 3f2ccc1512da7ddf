"""Queries over files, settings, models and streams: what the table queries do not reach, with twins.

The files are written from the driver's tables into a scratch folder first, so a twin computes
what they must yield from the tables alone.
"""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.config import Branding, MetadataFilter, Settings
from proofmill.functions import ids, text
from proofmill.operators import health, notes, refine, retrieve, vault
from proofmill.operators.chunk import chunk
from proofmill.plans import fixtures, oracle
from proofmill.sources import files, manifest, scratch
from proofmill.sources.store import ChunkStore
from proofmill.sources.tables import corpus, table_documents, text_documents
from proofmill.streaming import incremental

S = SparkSession
QUERIES: dict = {}
FOLDERS = ("notes", "env", "data", "lancedb", ".hidden", "build", "deep/er", "node_modules", "")
SUFFIXES = (".md", ".txt", ".MARKDOWN", ".pdf")


def query(f):
    QUERIES[f.__name__] = f
    return f


def _tree(spark: S, sf_dir: str) -> str:
    """A file for each nation: over ignored, hidden and plain folders, some not UTF-8."""
    root = scratch.folder(spark, "tree")
    for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").collect():
        k = r["n_nationkey"]
        at = Path(root, FOLDERS[k % 9], f"{'_' if k % 5 == 0 else ''}f{k}{SUFFIXES[k % 4]}")
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes((r["n_name"] or "").encode() + (b"\xff" if k % 6 == 5 else b""))
    return root


def _below(root: str, column: str = "source_path"):
    """The path below the written folder; such paths are given whole or relative to the working directory."""
    shown = files.normalize(root)
    return F.substr(F.col(column), F.lit(len(shown) + 2))


@query
def file_listing(spark: S, sf_dir: str) -> DataFrame:
    root = _tree(spark, sf_dir)
    rows = [(files.normalize(p, root), d) for p, d in files.list_files(root)]
    return spark.createDataFrame(rows, "path string, disposition string")


@query
def file_ingest(spark: S, sf_dir: str) -> DataFrame:
    """Against a manifest file that knows the even nations, every third of them under another hash."""
    root = _tree(spark, sf_dir)
    named = F.concat(F.lit(files.normalize(root) + "/"), F.element_at(F.array(*[F.lit(f + "/" if f else "") for f in FOLDERS]), (F.col("n_nationkey") % 9 + 1).cast("int")), F.when(F.col("n_nationkey") % 5 == 0, "_").otherwise(""), F.lit("f"), F.col("n_nationkey").cast("string"), F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("n_nationkey") % 4 + 1).cast("int")))
    known = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey % 2 = 0")
    entries = known.select(named.alias("source_path"), F.sha2(F.concat("n_name", F.when(F.col("n_nationkey") % 3 == 0, F.lit("x")).otherwise(F.lit(""))), 256).alias("content_hash"), F.lit(1).cast("long").alias("size_bytes"), F.lit("t").alias("modified_time"), F.lit("t").alias("last_ingested"))
    at = Path(root + "-manifest.json")
    at.write_text(manifest.to_json(entries), encoding="utf-8")
    done = files.ingest(spark, root, manifest.load(spark, at.as_uri()))
    good = F.col("status") != "error"
    return done.select(_below(root).alias("path"), "status", "source_type", F.when(good, F.col("content_hash")).alias("content_hash"), "size_bytes", F.col("document_id").isNotNull().alias("has_id"))


@query
def note_scan(spark: S, sf_dir: str) -> DataFrame:
    root = _tree(spark, sf_dir)
    found = vault.note_files(spark, root, [f"{root}/deep"])
    return found.select(F.substr("file_path", F.lit(len(str(Path(root).resolve())) + 2)).alias("path"), F.sha2("content", 256).alias("content_hash"))


@query
def manifest_file(spark: S, sf_dir: str) -> DataFrame:
    at = Path(scratch.folder(spark, "manifest"))
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(manifest.to_json(fixtures.previous_manifest(spark, sf_dir)), encoding="utf-8")
    return manifest.load(spark, at.as_uri())


@query
def manifest_last_wins(spark: S, sf_dir: str) -> DataFrame:
    """Each document ingested three times in one run."""
    docs = table_documents(spark, sf_dir).select("source_path", "content_hash", "size_bytes", F.explode(F.array(F.lit(2), F.lit(3), F.lit(1))).alias("n"))
    runs = docs.select("source_path", F.sha2(F.concat("content_hash", F.col("n").cast("string")), 256).alias("content_hash"), "size_bytes", F.lit("m").alias("modified_time"), F.concat(F.lit("2024-01-0"), F.col("n").cast("string")).alias("last_ingested"))
    return manifest.upsert(fixtures.previous_manifest(spark, sf_dir), runs)


@query
def source_manifest(spark: S, sf_dir: str) -> DataFrame:
    """A source manifest that names each nation's region, so that the last nation of a region wins."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()
    entries = [{"source_path": f"region/{r['n_regionkey']}", "content_hash": f"h{r['n_nationkey']}"} for r in rows]
    return manifest.source_hashes(spark, json.dumps({"entries": entries}))[0]


@query
def summary_json(spark: S, sf_dir: str) -> DataFrame:
    counts = manifest.summary(manifest.diff(table_documents(spark, sf_dir), fixtures.previous_manifest(spark, sf_dir)))
    return counts.select(F.to_json(F.struct(*counts.columns)).alias("json"))


@query
def settings_env(spark: S, sf_dir: str) -> DataFrame:
    """What is wrong with an environment for every supplier, with faults of each kind among them."""
    k = F.col("s_suppkey")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        k.cast("long").alias("supplier"), (k % 4 * 150).cast("string").alias("CHUNK_SIZE"), F.when(k % 5 == 0, "many").otherwise("100").alias("CHUNK_OVERLAP"),
        F.when(k % 3 == 0, "loud").otherwise("debug").alias("LOG_LEVEL"), F.when(k % 7 == 0, "Other").otherwise("OpenAI").alias("MODEL_PROVIDER"),
        (k % 4 / F.lit(2)).cast("string").alias("HYBRID_ALPHA"), (k % 6 - 1).cast("string").alias("TOP_K"),
    )

    def run(frames):
        for frame in frames:
            said = [Settings.from_env("X_", {f"X_{n}": v for n, v in r.items() if n != "supplier"}).validate() for r in frame.to_dict("records")]
            yield frame[["supplier"]].assign(problems=[len(p) for p in said], said=["; ".join(p) for p in said])

    return rows.mapInPandas(run, "supplier long, problems long, said string")


@query
def request_checks(spark: S, sf_dir: str) -> DataFrame:
    """A request for every benchmark item, each kind of fault among them."""
    k = F.col("item_id")
    query = F.when(k % 5 == 0, F.lit(" \t\n")).when(k % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("text"))
    policy = F.get(F.array(F.lit(None).cast("string"), F.lit("raw_only"), F.lit("all"), F.lit("dual_context")), (k % 4).cast("int"))
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(k.alias("request"), query.alias("query"), (k % 4 - 1).alias("top_k"), ((k % 7 - 1) / F.lit(4)).alias("alpha"), policy.alias("text_policy"))
    return retrieve.request_problems(asked).select("request", F.size("problems").alias("problems"), F.array_join("problems", "; ").alias("said"))


@query
def filter_values(spark: S, sf_dir: str) -> DataFrame:
    """The flat and the listed form of a filter for every part."""

    def run(frames):
        for frame in frames:
            out = []
            for k, brand in zip(frame["part"], frame["brand"], strict=True):
                chosen = MetadataFilter(source_type="md", document_id=f"d{k}" if k % 3 == 0 else None, key_value={"lang": brand} | ({"source_type": "txt"} if k % 2 == 0 else {}))
                out += [(k, "flat", *kv) for kv in chosen.flat().items()] + [(k, "item", *x.split("=", 1)) for x in chosen.describe()]
            yield type(frame)(out, columns=["part", "kind", "key", "value"])

    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("part"), F.col("p_brand").alias("brand"))
    return rows.mapInPandas(run, "part long, kind string, key string, value string")


@query
def filter_fields(spark: S, sf_dir: str) -> DataFrame:
    """The chunks of one document by its path, and of another by its id."""
    docs = table_documents(spark, sf_dir)
    first, last = docs.agg(F.min("source_path"), F.max("document_id")).first()
    rows = corpus(docs)
    one, two = (retrieve.apply_filter(rows, f) for f in (MetadataFilter(source_path=first), MetadataFilter(document_id=last)))
    return one.select(F.lit("path").alias("by"), "chunk_id").unionByName(two.select(F.lit("id").alias("by"), "chunk_id"))


@query
def prompts(spark: S, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select("conv_id", "turn", F.sha2(refine.prompt(F.coalesce("text", F.lit("")), "v1"), 256).alias("prompt_hash"))


@query
def iso_times(spark: S, sf_dir: str) -> DataFrame:
    day, k = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 4
    said = F.when(k == 0, day).when(k == 1, F.concat(day, F.lit("T23:30:00+02:00"))).when(k == 2, F.concat(day, F.lit("T23:30:00.250000-02:00"))).otherwise(F.concat(day, F.lit("T10:00:00Z")))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", notes.iso_utc(said).alias("at"))


@query
def lint_rare(spark: S, sf_dir: str) -> DataFrame:
    rows = notes.render(fixtures.source_notes(spark, sf_dir))
    k, c = F.col("doc_id") % 4, F.col("markdown")
    content = (
        F.when(k == 0, F.replace(c, F.lit('\nstatus: "proposal"'), F.lit("")))
        .when(k == 1, F.replace(c, F.lit('\nschema_version: "wiki-export-v1"'), F.lit('\nschema_version: "v0"')))
        .when(k == 2, F.regexp_replace(c, r"(### E2\n\n[^\n]*\n)- \*\*Chunk\*\*: [^\n]*\n", "$1"))
        .otherwise(c)
    )
    found = health.lint(rows.select(F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("file_path"), content.alias("content")))
    wrong = health.unrecognized(spark, "sources.json", manifest.source_hashes(spark, "[1]")[1])
    return found.unionByName(wrong).select("file_path", "code", "severity")


@query
def health_file(spark: S, sf_dir: str) -> DataFrame:
    """The written report's issues with their positions."""
    at = scratch.shared(spark, "report")
    health.write_report(health.linted(fixtures.faulty_files(spark, sf_dir)), "wiki", at)
    head, issues = health.read_report(spark, at)
    return issues.crossJoin(F.broadcast(head)).select("position", "file_path", "code", "error_count")


@query
def evidence_counts(spark: S, sf_dir: str) -> DataFrame:
    plan = vault.plan(fixtures.faulty_files(spark, sf_dir), None, vault.VaultConfig(allow_unhealthy=True), "wiki")
    return plan.select("relative_source", "evidence_count", F.array_join("source_document_ids", ",").alias("sources"))


def _hashed(batches):
    """The path and SHA-256 of each file named in the first column."""
    import hashlib

    import pyarrow as pa

    for batch in batches:
        digests = []
        for p in batch.column(0).to_pylist():
            with open(p, "rb") as f:
                digests.append(hashlib.file_digest(f, "sha256").hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string())], names=["path", "content"])


@query
def vault_files(spark: S, sf_dir: str) -> DataFrame:
    """Every file of a vault that is written from exported notes, and the manifest's number of notes."""
    root, target = scratch.folder(spark, "notes"), scratch.folder(spark, "vault")
    notes.write_files(fixtures.source_notes(spark, sf_dir), root)
    plan = vault.plan(vault.note_files(spark, root), None, vault.VaultConfig(), str(Path(root).resolve()))
    done = vault.apply(plan, target, root)
    if not done["success"]:
        raise RuntimeError("; ".join(done["errors"]))
    found = files.below(spark, target, lambda e: not e.name.startswith(files.WRITING))
    name = F.substr("path", F.lit(len(target) + 2))
    hashed = files.dealt(found.where(~F.endswith("path", F.lit(".json"))), "path").mapInArrow(_hashed, "path string, content string").select(name.alias("path"), "content")
    ledgers = found.where(F.endswith("path", F.lit(".json"))).select("path", name.alias("name")).collect()  # the manifest
    for r in ledgers:
        lines = spark.read.text(f"file://{r['path']}").agg(F.max(F.regexp_extract("value", r'^  "total_notes": ([0-9]+),$', 1)).alias("content"))
        hashed = hashed.unionByName(lines.select(F.lit(r["name"]).alias("path"), "content"))
    return hashed


@query
def chunk_store(spark: S, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    pieces = chunk(text_documents(rows, F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(".txt"))))
    store = ChunkStore(spark, scratch.folder(spark, "store"), 8)
    store.store(pieces)
    first, last = pieces.agg(F.min("document_id"), F.max("document_id")).first()
    store.delete_document(first)
    got = store.get(last, f"chunk_{last}_0").select("document_id", F.lit("got").alias("how"), "raw_text_hash")
    return store.read().select("document_id", F.lit("kept").alias("how"), "raw_text_hash").unionByName(got)


class PlannedModel:
    """Returns a prompt's text if its length divides by three, else breaks its reply or fails."""

    def __call__(self, prompts):
        for p in prompts:
            raw = p[p.index("\n---\n") + 5 : p.rindex("\n---\n")]
            if len(raw) % 3 == 2:
                raise ValueError("failed")
            yield json.dumps({"cleaned_text": raw}) if len(raw) % 3 == 0 else "{broken"


class AbsentModel(PlannedModel):
    def available(self) -> bool:
        return False


@query
def model_rollup(spark: S, sf_dir: str) -> DataFrame:
    pieces, out = chunk(table_documents(spark, sf_dir)), None
    for name, model in (("planned", PlannedModel()), ("absent", AbsentModel())):
        rolled = refine.document_rollup(refine.refine_with_model(pieces, model, "m"))
        one = rolled.select(F.lit(name).alias("model"), "document_id", "model_attempts", "model_accepts", "model_fallbacks", "refinement_method", "model_name", "fallback_reason")
        out = one if out is None else out.unionByName(one)
    return out


@query
def refinement_json(spark: S, sf_dir: str) -> DataFrame:
    docs = table_documents(spark, sf_dir).repartition("document_id")  # before they are cut, so that texts move once and chunks not at all
    rows = refine.result_json(refine.refine_chunks(chunk(docs)))
    known = "total_chunks string, chunks array<struct<chunk_id:string,raw_text_hash:string>>, metadata struct<refinement_method:string>, total_raw_chars string"
    read = text.staged(rows, r=F.from_json("json", known))  # a JSON text is read once for all columns
    chunks = F.col("r.chunks")
    return read.select(
        "document_id", F.col("r.total_chunks").alias("chunks"), F.get(chunks, F.lit(0))["raw_text_hash"].alias("first_hash"), F.try_element_at(chunks, F.lit(-1))["chunk_id"].alias("last_chunk"),
        F.col("r.metadata.refinement_method").alias("method"), F.col("r.total_raw_chars").alias("chars"),
    )


@query
def stream_ingest(spark: S, sf_dir: str) -> DataFrame:
    """The documents as a stream, against a manifest of an earlier run."""
    at = scratch.folder(spark, "stream")
    fixtures.previous_manifest(spark, sf_dir).write.parquet(f"{at}/manifest/v=-1")
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents*.parquet")
    suffix = F.when(F.col("doc_id") % 2 == 0, F.lit(".md")).otherwise(F.lit(".txt"))
    docs = text_documents(rows, F.concat(F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), suffix))
    stamped = docs.withColumns({"modified_time": F.lit("m"), "last_ingested": F.lit("now")})
    incremental.ingest_stream(stamped.select("document_id", "source_path", "content_hash", "size_bytes", "modified_time", "last_ingested"), f"{at}/manifest", f"{at}/statuses", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/statuses").select("document_id", "source_path", "status")


# --- twins ---
_FILES = """files AS (
  SELECT n_nationkey AS k, n_name, (['notes/', 'env/', 'data/', 'lancedb/', '.hidden/', 'build/', 'deep/er/', 'node_modules/', ''])[n_nationkey % 9 + 1] AS folder,
    (CASE WHEN n_nationkey % 5 = 0 THEN '_' ELSE '' END) || 'f' || n_nationkey || (['.md', '.txt', '.MARKDOWN', '.pdf'])[n_nationkey % 4 + 1] AS name FROM nation
), listed AS (SELECT *, folder || name AS path FROM files WHERE folder NOT IN ('data/', 'lancedb/', '.hidden/', 'node_modules/'))"""
_PROMPT = "'Normalize white space and formatting of the text between the rules and keep all content.' || chr(10) || 'Keep every fact, number, name, date and id as it is; add, drop, summarize and translate nothing.' || chr(10) || 'Prompt version: v1' || chr(10) || '---' || chr(10) || coalesce(text, '') || chr(10) || '---' || chr(10) || 'Answer with one JSON object: {\"cleaned_text\": \"...\"}'"
_BRAND = Branding()


def _page(title: str, heading: str, about: str, body: str) -> str:
    return f"sha256(concat_ws(chr(10), '---', 'title: \"{title}\"', 'type: \"vault_index\"', '---', '', '# {heading}', '', '{about}', '', {body}, '{_BRAND.marker}'))"


_LINK = "'- [[' || file_name || '|' || title || ']]'"
ORACLE = {
    "file_listing": f"WITH {_FILES} SELECT path, CASE WHEN k % 4 = 3 THEN 'skipped' ELSE 'ingest' END AS disposition FROM listed",
    "file_ingest": f"""WITH {_FILES} SELECT path, CASE WHEN k % 4 = 3 THEN 'skipped' WHEN k % 6 = 5 THEN 'error' WHEN k % 2 = 1 THEN 'new' WHEN k % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS status,
      CASE WHEN k % 4 = 3 THEN NULL WHEN k % 4 = 1 THEN 'txt' ELSE 'md' END AS source_type, CASE WHEN k % 4 <> 3 AND k % 6 <> 5 THEN sha256(n_name) END AS content_hash,
      CASE WHEN k % 4 <> 3 THEN octet_length(encode(n_name)) + (k % 6 = 5)::INT END::BIGINT AS size_bytes, k % 4 <> 3 AND k % 6 <> 5 AS has_id FROM listed""",
    "note_scan": f"WITH {_FILES} SELECT folder || name AS path, sha256(n_name) AS content_hash FROM files WHERE k % 4 = 0 AND folder NOT IN ('.hidden/', 'deep/er/')",
    "manifest_file": f"WITH {oracle.DOCS} SELECT source_path, CASE WHEN doc_id % 10 = 1 THEN sha256(content_hash) ELSE content_hash END AS content_hash, size_bytes, '2024-01-01T00:00:00+00:00' AS modified_time, '2024-01-01T00:00:00+00:00' AS last_ingested FROM docs WHERE doc_id % 10 <> 0",
    "manifest_last_wins": f"WITH {oracle.DOCS} SELECT source_path, sha256(content_hash || '3') AS content_hash, size_bytes, 'm' AS modified_time, '2024-01-03' AS last_ingested FROM docs",
    "source_manifest": "SELECT 'region/' || n_regionkey AS key, 'h' || max(n_nationkey) AS content_hash FROM nation GROUP BY n_regionkey",
    "summary_json": "SELECT '{\"total_files\":' || count(*) || ',\"new_files\":' || count(*) FILTER (WHERE doc_id % 10 = 0) || ',\"changed_files\":' || count(*) FILTER (WHERE doc_id % 10 = 1) || ',\"unchanged_files\":' || count(*) FILTER (WHERE doc_id % 10 > 1) || ',\"skipped_files\":0,\"error_files\":0}' AS json FROM documents",
    "settings_env": """WITH k AS (SELECT s_suppkey AS k, (s_suppkey % 4 * 150)::INT AS size, CASE WHEN s_suppkey % 5 = 0 THEN 200 ELSE 100 END AS overlap, (s_suppkey % 4 / 2.0)::DOUBLE AS alpha, (s_suppkey % 6 - 1)::INT AS top FROM supplier)
      SELECT k::BIGINT AS supplier, len(p)::BIGINT AS problems, array_to_string(p, '; ') AS said FROM (SELECT k, list_filter([CASE WHEN k % 5 = 0 THEN 'Invalid integer for X_CHUNK_OVERLAP' END, CASE WHEN k % 3 = 0 THEN 'Invalid log_level: LOUD' END,
        CASE WHEN k % 7 = 0 THEN 'Invalid model_provider: other' END, CASE WHEN size < 1 THEN 'chunk_size must be positive: ' || size END, CASE WHEN overlap >= size THEN 'chunk_overlap must be less than chunk_size' END,
        CASE WHEN top < 1 THEN 'top_k must be positive: ' || top END, CASE WHEN alpha > 1 THEN 'hybrid_alpha must be between 0 and 1: ' || alpha END], lambda x: x IS NOT NULL) AS p FROM k)""",
    "request_checks": """SELECT item_id AS request, len(p)::INT AS problems, array_to_string(p, '; ') AS said FROM (SELECT item_id, list_filter([
      CASE WHEN item_id % 5 = 0 OR item_id % 11 = 0 OR trim(text, ' ' || chr(9) || chr(10)) = '' THEN 'query must not be empty' END, CASE WHEN item_id % 4 < 2 THEN 'top_k must be >= 1' END,
      CASE WHEN item_id % 7 = 0 OR item_id % 7 > 5 THEN 'alpha must be between 0.0 and 1.0' END, CASE WHEN item_id % 4 = 2 THEN 'unknown text_policy: all' END], lambda x: x IS NOT NULL) AS p FROM benchmark)""",
    "filter_values": """WITH p AS (SELECT p_partkey::BIGINT AS part, p_brand AS brand FROM part)
      SELECT part, 'flat' AS kind, 'document_id' AS key, 'd' || part AS value FROM p WHERE part % 3 = 0 UNION ALL SELECT part, 'flat', 'source_type', CASE WHEN part % 2 = 0 THEN 'txt' ELSE 'md' END FROM p UNION ALL SELECT part, 'flat', 'lang', brand FROM p
      UNION ALL SELECT part, 'item', 'document_id', 'd' || part FROM p WHERE part % 3 = 0 UNION ALL SELECT part, 'item', 'source_type', 'md' FROM p UNION ALL SELECT part, 'item', 'lang', brand FROM p UNION ALL SELECT part, 'item', 'source_type', 'txt' FROM p WHERE part % 2 = 0""",
    "filter_fields": f"WITH RECURSIVE {oracle.DOCS}, {oracle.chunks()} SELECT 'path' AS by, chunk_id FROM chunks WHERE path = (SELECT min(source_path) FROM docs) UNION ALL SELECT 'id', chunk_id FROM chunks WHERE document_id = (SELECT max(document_id) FROM docs)",
    "prompts": f"SELECT conv_id, turn, sha256({_PROMPT}) AS prompt_hash FROM conversations",
    "iso_times": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate::DATE, '%Y-%m-%d') || 'T00:00:00+00:00' WHEN 1 THEN strftime(o_orderdate::DATE, '%Y-%m-%d') || 'T21:30:00+00:00' WHEN 2 THEN strftime(o_orderdate::DATE + 1, '%Y-%m-%d') || 'T01:30:00.250000+00:00' ELSE strftime(o_orderdate::DATE, '%Y-%m-%d') || 'T10:00:00+00:00' END AS \"at\" FROM orders",
    "lint_rare": "SELECT 'n' || doc_id AS file_path, CASE doc_id % 4 WHEN 0 THEN 'missing_required_field' WHEN 1 THEN 'invalid_schema_version' ELSE 'evidence_missing_chunk_id' END AS code, 'error' AS severity FROM documents WHERE doc_id % 4 <> 3 UNION ALL SELECT 'sources.json', 'source_manifest_unrecognized', 'error'",
    "health_file": f"WITH {oracle.ISSUES} SELECT row_number() OVER (ORDER BY file_path, code) - 1 AS position, file_path, code, count(*) FILTER (WHERE severity = 'error') OVER () AS error_count FROM issues",
    "evidence_counts": "SELECT lpad(doc_id::VARCHAR, 9, '0') || '.md' AS relative_source, CASE WHEN doc_id % 13 IN (1, 2) THEN 0 WHEN doc_id % 13 = 6 THEN 9 ELSE 3 END AS evidence_count, CASE WHEN doc_id % 13 = 2 THEN '' ELSE 'doc_' || doc_id END AS sources FROM documents",
    "vault_files": f"""WITH {oracle.RENDERED}, named AS (SELECT *, 'doc-' || doc_id || '-' || lang || '--id-' || {oracle.HEX.format(c="note_id")} || '.md' AS file_name, 'Doc "' || doc_id || '": ' || lang AS title FROM rendered WHERE doc_id % 5 <> 0),
      lines AS (SELECT string_agg({_LINK}, chr(10) ORDER BY title, file_name) AS l, string_agg('## doc_' || doc_id || chr(10) || chr(10) || {_LINK} || chr(10), chr(10) ORDER BY 'doc_' || doc_id) AS s, count(*) AS n FROM named)
      SELECT '{_BRAND.vault_dir}/Notes/' || file_name AS path, sha256(markdown) AS content FROM named
      UNION ALL SELECT '{_BRAND.vault_dir}/Index/Home.md', {_page(_BRAND.home_title, _BRAND.home_title, "Auto-generated vault index. Do not edit manually.", "'## Notes', '', l, ''")} FROM lines
      UNION ALL SELECT '{_BRAND.vault_dir}/Index/By-Type.md', {_page("Notes by Type", "Notes by Type", "Auto-generated index grouped by note type.", "'## compiled_knowledge_wiki_note', '', l, ''")} FROM lines
      UNION ALL SELECT '{_BRAND.vault_dir}/Index/By-Source.md', {_page("Notes by Source", "Notes by Source", "Auto-generated index grouped by source document.", "s")} FROM lines
      UNION ALL SELECT '{_BRAND.manifest_name}', n::VARCHAR FROM lines""",
    "chunk_store": f"""WITH RECURSIVE docs AS (SELECT 'doc_' || substr(sha256(source_path), 1, 12) || '_' || substr(sha256(raw_text), 1, 12) AS document_id, * FROM (SELECT 'conv/' || conv_id || '/' || turn || '.txt' AS source_path, coalesce(text, '') AS raw_text FROM conversations)), {oracle.chunks()}
      SELECT document_id, 'kept' AS how, raw_text_hash FROM chunks WHERE document_id <> (SELECT min(document_id) FROM chunks) UNION ALL SELECT document_id, 'got', raw_text_hash FROM chunks WHERE document_id = (SELECT max(document_id) FROM chunks) AND chunk_index = 0""",
    "model_rollup": f"""WITH RECURSIVE {oracle.DOCS}, {oracle.chunks()}, c AS (SELECT document_id, count(*) AS n, count(*) FILTER (WHERE length(piece) % 3 = 0) AS good FROM chunks GROUP BY document_id)
      SELECT 'planned' AS model, document_id, n AS model_attempts, good AS model_accepts, n - good AS model_fallbacks, CASE WHEN n = good THEN 'model_based' ELSE 'rule_based' END AS refinement_method, CASE WHEN n = good THEN 'm' END AS model_name,
        CASE WHEN n > good THEN 'partial_fallback: ' || (n - good) || '/' || n || ' chunks' END AS fallback_reason FROM c
      UNION ALL SELECT 'absent', document_id, 0, 0, 0, 'rule_based', NULL, 'adapter_unavailable' FROM c""",
    "refinement_json": f"""WITH RECURSIVE {oracle.DOCS}, {oracle.chunks()} SELECT document_id, count(*)::VARCHAR AS chunks, max(CASE WHEN chunk_index = 0 THEN raw_text_hash END) AS first_hash, 'chunk_' || document_id || '_' || max(chunk_index) AS last_chunk, 'rule_based' AS method, max(end_offset)::VARCHAR AS chars FROM chunks GROUP BY document_id""",
    "stream_ingest": oracle.SQL["manifest_diff"],
}
