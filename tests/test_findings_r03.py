"""One small case for each finding of the third round that was mended."""

import json
import re

from pyspark.sql import functions as F

from proofmill.config import RetrievalRequest
from proofmill.functions import text
from proofmill.operators import health, refine, retrieve
from proofmill.operators.chunk import chunk
from proofmill.plans import catalogue, file_catalogue
from proofmill.sources.tables import table_documents


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_refinement_json_moves_each_text_once(spark, sf_dir):
    """documents are dealt before they are cut; no chunk moves, nothing is refined twice or joined."""
    plan = plan_of(file_catalogue.refinement_json(spark, sf_dir))
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert plan.count("Scan parquet") == 1


def test_result_json_of_repeated_documents_and_none(spark, sf_dir):
    """a document that is there twice is one result with the chunks of both, an empty one has none."""
    docs = table_documents(spark, sf_dir).where(F.length("raw_text") > 1500).orderBy("document_id").limit(2)
    empty = docs.withColumns({"document_id": F.lit("empty"), "raw_text": F.lit("")})
    rows = refine.result_json(refine.refine_chunks(chunk(docs.unionByName(docs).unionByName(empty)))).collect()
    assert len(rows) == 2
    once = {r["document_id"]: r["n"] for r in chunk(docs).groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    for r in rows:
        found = json.loads(r["json"])
        assert found["total_chunks"] == len(found["chunks"]) == 2 * once[r["document_id"]]
        assert [c["chunk_index"] for c in found["chunks"]] == sorted(c["chunk_index"] for c in found["chunks"])


def test_keyword_topk_reads_the_corpus_once(spark, sf_dir):
    """F16: one pass for the three policies."""
    assert plan_of(catalogue.keyword_topk(spark, sf_dir)).count("Scan parquet") == 1


def test_keyword_lists_equal_the_single_lists(spark):
    """F16: also where refinement changes a text inside, drops or joins nothing, and for null, unknown policies and no tokens."""
    texts = ["the  heat of\n\n\n\n the Heat2 2", " heat ", "x_the-2THE", "the", "", None, "| a  | the 2 |\nheat   of   x", "İention of THE", "nothing here"]
    docs = spark.createDataFrame([(f"d{k}", f"c{k}", 0, f"p{k}.md", "md", t) for k, t in enumerate(texts)], "document_id string, chunk_id string, chunk_index int, source_path string, source_type string, raw_text string")
    rows = refine.clean_chunks(docs).withColumns({"cleaned_text": F.when(F.col("chunk_id") == "c1", F.lit("the heat of it")).otherwise(F.col("cleaned_text")), "raw_text_hash": F.lit(""), "metadata": F.create_map().cast("map<string,string>")})
    policies = ("raw_only", "cleaned_only", "dual_context", "other")
    for query in ("the heat of ention, and the 2 eses", "i", "?!"):
        request = RetrievalRequest(query)
        found = {(r["policy"], r["chunk_id"], r["keyword_score"], tuple(r["matched_fields"])) for r in retrieve.keyword_lists(rows, request, policies, 4).collect()}
        single = {(p, r["chunk_id"], r["keyword_score"], tuple(r["matched_fields"])) for p in policies for r in retrieve.keyword_hits(rows, request, p, 4).collect()}
        assert found == single


def test_health_file_collects_no_issues(spark, sf_dir):
    """the issues stay on the executors and every position is one of theirs; files are not linted again."""
    found = file_catalogue.health_file(spark, sf_dir)
    plan = plan_of(found)
    assert "Scan json" in plan and "Scan parquet" not in plan and "Scan ExistingRDD" not in plan and "LocalTableScan" not in plan


def test_written_report_equals_the_json(spark, tmp_path):
    """counts and order are those of the one-text report, over several parts, with and without issues."""
    none = [(f"b{k}.md", "plain") for k in range(40)] + [("a.md", '---\nnote_id: "x"\nno end'), ("c.md", "---\nnote_type: diary\n---\n")]
    for name, rows in (("some", none), ("empty", [])):
        files = spark.createDataFrame(rows, "file_path string, content string").repartition(3)
        want = json.loads(health.report_json(files, health.lint(files), "w"))
        at = (tmp_path / name).as_uri()
        health.write_report(health.linted(files), "w", at)
        head, issues = health.read_report(spark, at)
        listed = [r.asDict() for r in issues.orderBy("position").collect()]
        assert [r.pop("position") for r in listed] == list(range(len(want["issues"])))
        assert {**head.first().asDict(), "issues": listed} == want


def test_strip_takes_the_white_space_of_the_class(spark):
    """trimming by a list of characters is trimming by SPACE."""
    assert set(text.SPACES) == {c for c in map(chr, range(0x110000)) if re.fullmatch(text.SPACE, c)}
    said = ["", " ", text.SPACES, f"{text.SPACES}a{text.SPACES}b​{text.SPACES}", "​a᠎", "é　", "\n# x\r\n", None]
    rows = spark.createDataFrame(list(enumerate(said)), "k int, c string").select("k", text.strip(F.col("c")).alias("both"), text.rstrip(F.col("c")).alias("end")).orderBy("k").collect()
    assert [r["both"] for r in rows] == [s and re.sub(f"^{text.SPACE}+|{text.SPACE}+\\Z", "", s) for s in said]
    assert [r["end"] for r in rows] == [s and re.sub(f"{text.SPACE}+\\Z", "", s) for s in said]
