"""Literal cases and small independent specifications."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from proofmill.config import ChunkConfig, ContextPolicy, EvidenceBudget, MetadataFilter, RetrievalRequest, SelectionPolicy, Settings
from proofmill.functions import ids, text
from proofmill.operators import health, notes, pack, refine, retrieve, vault
from proofmill.operators.chunk import chunk


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def spans(raw, size, overlap, search=True):
    """The chunk rule, position by position."""
    out, pos = [], 0
    while pos < len(raw):
        end = min(pos + size, len(raw))
        if end < len(raw) and search:
            near = range(end - 1, max(1, end - 50), -1)
            cut = next((i for i in near if raw[i] == "\n"), None)
            if cut is None:
                cut = next((i for i in near if raw[i - 1] in ".!?" and raw[i] in " \n"), end)
            end = cut if cut > pos + overlap else end
        out.append((pos, end))
        if end == len(raw):
            break
        pos = max(0, end - overlap)
    return out


TEXTS = ["", "x", "Hello world", "a" * 10 + "\n" + "b" * 95 + ". " + "c" * 200, "é😀\n" * 90, "Word. " * 120, "no cut " * 30 + "\n\n" + "t" * 60, "a\n" * 40]


@pytest.mark.parametrize(("size", "overlap", "search"), [(10, 3, True), (5, 0, True), (60, 0, True), (100, 20, True), (51, 0, True), (100, 0, False), (7, 2, False), (1, 0, True), (120, 100, True)])
def test_chunks_follow_the_rule(spark, size, overlap, search):
    docs = spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(TEXTS)], "document_id string, raw_text string")
    got = {}
    for r in chunk(docs, ChunkConfig(size, overlap, search)).orderBy("document_id", "chunk_index").collect():
        got.setdefault(r["document_id"], []).append((r["start_offset"], r["end_offset"]))
        assert r["raw_text"] == TEXTS[int(r["document_id"][1:])][r["start_offset"] : r["end_offset"]]
        assert r["raw_text_hash"] == hashlib.sha256(r["raw_text"].encode()).hexdigest()
    assert got == {f"d{k}": spans(t, size, overlap, search) for k, t in enumerate(TEXTS) if t}


@pytest.mark.parametrize("bad", [(0, 0), (-1, 0), (5, -1), (5, 5), (5, 6)])
def test_bad_chunk_parameters(bad):
    with pytest.raises(ValueError):
        ChunkConfig(*bad)


def test_refine_of_even_texts_equals_the_line_by_line_way(spark):
    """Most texts only lose blanks at their ends; what decides that must not let an uneven one pass."""
    import random

    rng = random.Random(3)
    bits = [" ", "\n", "a", "b1", "c.", "\n\n", "  ", "\t", "|", "---", "===", ":", "=", "\r\n", "\x0b", "\x1f", "\x85", "\u2003", "\u2028", "    "]
    made = ["".join(rng.choice(bits[: 5 + k % 16]) for _ in range(k % 12)) for k in range(3000)]
    rows = spark.createDataFrame([(t,) for t in made], "t string").select("t", refine.refine(F.col("t")).alias("c"), refine._refine_lines(F.col("t")).alias("l"), refine.uneven(F.col("t")).alias("uneven")).collect()
    assert all(r["c"] == r["l"] for r in rows) and 0 < sum(r["uneven"] for r in rows) < len(rows)


@pytest.mark.parametrize(
    ("raw", "cleaned"),
    [
        ("", ""), ("  Hello   world  ", "Hello world"), ("server.port:  8080", "server.port:  8080"), ("x =  1", "x =  1"), ("| a  | b  |", "| a  | b  |"),
        ("a\n\n\n\nb", "a\n\nb"), ("a\n \n \nb", "a\n\n\nb"), ("   \n\t ", ""), ("\n    code  x\nplain  y  \n", "    code  x\nplain y"), ("--- a  b", "--- a  b"), ("a:  \nb", "a:\nb"),
        ("\u00a0wide\u2003\u2003gap\x1c", "wide gap"),
    ],
)
def test_refine_literals(spark, raw, cleaned):
    assert one(spark, refine.refine(F.lit(raw))) == cleaned


def test_facts_and_guardrails(spark):
    facts = one(spark, refine.check_facts(F.lit("cat 12 sat"), F.lit("cat is newword ab 13")))
    assert (facts["added_words"], facts["added_numbers"]) == (["newword"], ["13"])
    assert one(spark, refine.check_facts(F.lit("abc"), F.lit("")))["empty_cleaned"]
    assert one(spark, refine.check_facts(F.lit(""), F.lit("new 1")))["added_words"] == []
    g = lambda a, b: one(spark, refine.guardrails(F.lit(a), F.lit(b)))
    assert g("keep 2024-01-02 and v1.2.3", "keep 2024-01-02 and v1.2.3")["passed"]
    assert g("x", "")["violations"] == ["empty_cleaned_from_nonempty_raw"]
    assert g("abcdef 7 ghij", "abcdef ghij")["violations"] == ["critical_token_loss: ['7'] (100.0% loss)"]
    assert g("0123456789" * 3, "")["cleaned_text"] is None
    assert g("word " * 20, "word")["violations"][0].startswith("excessive_compression: ")


def test_model_path_accepts_rejects_and_falls_back(spark):
    docs = spark.createDataFrame([("d", "Alpha  beta 12.")], "document_id string, raw_text string")

    def good(prompts):
        for _ in prompts:
            yield json.dumps({"cleaned_text": "Alpha beta 12."})

    def bad(prompts):
        for _ in prompts:
            yield json.dumps({"cleaned_text": "Alpha beta 12. Invented sentence 99."})

    def broken(prompts):
        raise RuntimeError("down")

    rows = {n: refine.refine_with_model(chunk(docs), m, "m1").first() for n, m in (("good", good), ("bad", bad), ("broken", broken), ("none", None))}
    assert rows["good"]["refinement"]["refinement_method"] == "model_based" and rows["good"]["refinement"]["model_name"] == "m1"
    assert rows["bad"]["refinement"]["fallback_reason"] == "guardrail_violation" and rows["bad"]["cleaned_text"] == "Alpha beta 12."
    assert rows["broken"]["refinement"]["fallback_reason"].startswith("model_error")
    assert rows["none"]["refinement"]["fallback_reason"] == "adapter_unavailable"
    mixed = refine.document_rollup(refine.refine_with_model(chunk(docs), bad, "m1")).first()
    assert (mixed["refinement_method"], mixed["fallback_reason"]) == ("rule_based", "partial_fallback: 1/1 chunks")
    assert refine.document_rollup(refine.refine_with_model(chunk(docs), None)).first()["fallback_reason"] == "adapter_unavailable"
    assert one(spark, refine.strip_fence(F.lit('```json\n{"cleaned_text": "x"}\n```'))) == '{"cleaned_text": "x"}'
    rolled = refine.document_rollup(refine.refine_with_model(chunk(docs), good, "m1")).first()
    assert (rolled["refinement_method"], rolled["model_accepts"]) == ("model_based", 1)


CORPUS = "document_id string, chunk_id string, chunk_index int, source_path string, source_type string, raw_text string, cleaned_text string, raw_text_hash string, cleaned_text_hash string, metadata map<string,string>"


def candidates(spark, texts):
    rows = [(f"doc_{k}", f"chunk_doc_{k}_0", 0, f"p{k}", "md" if k % 2 else "txt", t, t, f"h{t[:3]}", None, {"lang": "en" if k % 3 else "fr"}) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, CORPUS)


def keyword_value(query, words):
    total = 0.0
    for q in query:
        f = words.count(q)
        total += f * 1.5 / (f + 0.5) if f else 0.0
    return min(1.0, total / (1 + len(words) * 0.001))


def test_retrieval_scores_order_and_filters(spark):
    texts = ["red fox runs", "fox", "blue sky", "fox fox red", "Red, red; FOX!"]
    rows = candidates(spark, texts)
    found = {r["document_id"]: r for r in retrieve.retrieve(rows, RetrievalRequest("red fox red", top_k=5, alpha=0.3, text_policy="raw_only")).collect()}
    for k, t in enumerate(texts):
        words = "".join(c if c.isalnum() else " " for c in t.lower()).split()
        kw = keyword_value(["red", "fox", "red"], words)
        vec = int(hashlib.sha256(f"red fox red:chunk_doc_{k}_0".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF
        assert found[f"doc_{k}"]["keyword_score"] == pytest.approx(kw)
        assert found[f"doc_{k}"]["vector_score"] == pytest.approx(vec)
        assert found[f"doc_{k}"]["hybrid_score"] == pytest.approx(0.3 * vec + 0.7 * kw)
    assert found["doc_2"]["retrieval_source"] == "vector_placeholder" and found["doc_0"]["retrieval_source"] == "hybrid"
    assert sorted(r["rank"] for r in found.values()) == [1, 2, 3, 4, 5]
    only = retrieve.retrieve(rows, RetrievalRequest("fox", filters=MetadataFilter(source_type="md", key_value={"lang": "en"}))).collect()
    assert {r["document_id"] for r in only} == {"doc_1"} and only[0]["applied_filters"] == ["source_type=md", "lang=en"]
    assert {r["keyword_score"] for r in retrieve.retrieve(rows, RetrievalRequest("?!", alpha=0.0)).collect()} == {0.0}
    for bad in (RetrievalRequest(" "), RetrievalRequest("q", top_k=0), RetrievalRequest("q", alpha=1.5)):
        with pytest.raises(ValueError):
            retrieve.retrieve(rows, bad)


def test_plans_stay_native_and_top_k(spark):
    rows = candidates(spark, ["a b", "b c"])
    plan = retrieve.keyword_hits(rows, RetrievalRequest("b"), "raw_only", 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan


@pytest.mark.parametrize("block", [5000, 1])
def test_batch_equals_single(spark, monkeypatch, block):
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", block)
    rows = candidates(spark, ["red fox runs", "fox", "blue sky", "fox fox red", "sky red"])
    asked = spark.createDataFrame([(1, "red fox red"), (2, "sky"), (3, "none of these")], "query_id long, query string")
    batch = retrieve.retrieve_batch(rows, asked, top_k=2, policy="raw_only").orderBy("query_id", "rank").collect()
    for number, q in ((1, "red fox red"), (2, "sky"), (3, "none of these")):
        single = retrieve.retrieve(rows, RetrievalRequest(q, top_k=2, text_policy="raw_only")).orderBy("rank").collect()
        assert [r["chunk_id"] for r in batch if r["query_id"] == number] == [r["chunk_id"] for r in single]


def test_pack_budget_skips_whole_items(spark):
    rows = candidates(spark, ["fox " * n for n in (5, 50, 3, 2)])
    found = retrieve.retrieve(rows, RetrievalRequest("fox", top_k=4, retrieval_run_id="r"))
    chosen = pack.select_items(found, budget=EvidenceBudget(max_raw_chars=45)).orderBy("rank").collect()
    used = 0
    for r in chosen:
        fits = used + len(r["raw_text"]) <= 45
        assert (r["reason"] is None) == fits and (fits or r["reason"] == "max_raw_chars_exceeded")
        used += len(r["raw_text"]) if fits else 0
    built = pack.build_pack(found, SelectionPolicy(), EvidenceBudget(max_items=2), ContextPolicy(include_cleaned_text=False))
    p = built.first()
    assert (p["total_selected_items"], p["total_excluded_items"]) == (2, 2) and "CLEANED_TEXT" not in p["context"]
    assert pack.build_pack(found.repartition(3), SelectionPolicy(), EvidenceBudget(max_items=2), ContextPolicy(include_cleaned_text=False)).first()["pack_id"] == p["pack_id"]
    assert pack.build_pack(found).first()["pack_id"] != pack.build_pack(found, budget=EvidenceBudget()).first()["pack_id"]
    again = pack.from_json(pack.to_json(built), built.schema).first()
    assert again == p


@pytest.mark.parametrize(("labels", "shown"), [(["E1", "E1", "E1-2"], ["E1", "E1-3", "E1-2"]), (["E1", "E1", "E1"], ["E1", "E1-2", "E1-3"]), ([], []), (["E1-2", "E1", "E1"], ["E1-2", "E1", "E1-3"])])
def test_display_labels(spark, labels, shown):
    assert one(spark, notes.display_labels(F.array(*[F.lit(x) for x in labels]).cast("array<string>"))) == shown


def test_slug_and_file_name(spark):
    assert one(spark, ids.note_filename(F.lit("Test Note"), F.lit("note_001"))) == "test-note--id-6e6f74655f303031.md"
    assert one(spark, ids.note_filename(F.lit(" "), F.lit("a"))) == "id-61.md"
    assert one(spark, ids.note_filename(F.lit("x"), F.lit(" "))) is None
    assert one(spark, text.slug(F.lit("?!"))) == "note"
    assert one(spark, text.yaml_scalar(F.lit('a"b\\c\nd'))) == '"a\\"b\\\\c\\nd"'
    assert one(spark, text.blockquote(F.lit("a\n\nb"))) == "> a\n>\n> b"
    assert one(spark, notes.iso_utc(F.lit("2024-01-02T03:04:05Z"))) == "2024-01-02T03:04:05+00:00"


GOOD = """---
note_id: "n1"
note_type: "compiled_knowledge_wiki_note"
status: "draft"
generated_by: "x"
schema_version: "wiki-export-v1"
source_policy: "raw_text_authoritative"
validation_status: "validated"
evidence_count: 1
source_documents:
  - document_id: "d1"
    source_path: "a.md"
    content_hash: "abc"
---

# Title

## Claims

- A claim [E1]

## Evidence References

### E1

- **Document**: `d1`
- **Chunk**: `c1`

---

## Provenance Metadata
"""

FAULTS = {
    "missing_frontmatter": lambda t: "x" + t, "malformed_frontmatter": lambda t: t.replace('status: "draft"', "status draft"), "missing_required_field": lambda t: t.replace('generated_by: "x"', 'generated_by: " "'),
    "invalid_note_type": lambda t: t.replace("compiled_knowledge_wiki_note", "diary"), "invalid_schema_version": lambda t: t.replace("wiki-export-v1", "v9"), "invalid_status": lambda t: t.replace('"draft"', "lost"),
    "invalid_source_policy": lambda t: t.replace("raw_text_authoritative", "any"), "invalid_validation_status": lambda t: t.replace('"validated"', '"validation_required"'), "evidence_count_mismatch": lambda t: t.replace("evidence_count: 1", "evidence_count: 2"),
    "claim_missing_citation": lambda t: t.replace("- A claim [E1]", "- A claim"), "citation_unresolved": lambda t: t.replace("[E1]", "[E1, E9]"), "evidence_missing_document_id": lambda t: t.replace("- **Document**: `d1`\n", ""),
    "evidence_missing_chunk_id": lambda t: t.replace("`c1`", ""), "duplicate_evidence_label": lambda t: t.replace("evidence_count: 1", "evidence_count: 2").replace("\n---\n\n## Prov", "### E1\n- **Document**: `d1`\n- **Chunk**: `c2`\n\n---\n\n## Prov"),
    "missing_metadata_section": lambda t: t.replace("## Provenance Metadata", ""),
}


def test_each_lint_rule_and_only_it(spark):
    files = [("good.md", GOOD)] + [(f"{code}.md", change(GOOD).replace('"n1"', f'"{code}"')) for code, change in FAULTS.items()]
    df = spark.createDataFrame(files, "file_path string, content string")
    got = {}
    for r in health.lint(df).collect():
        got.setdefault(r["file_path"][:-3], set()).add(r["code"])
    want = {code: {code} for code in FAULTS}
    want["missing_frontmatter"] |= {"orphan_note"}
    want["malformed_frontmatter"] |= {"orphan_note"}
    assert got == want


def test_drift_and_duplicates(spark):
    df = spark.createDataFrame([("a.md", GOOD), ("b.md", GOOD)], "file_path string, content string")
    parsed = health.parse(df)
    known = spark.createDataFrame([("a.md", "other")], "key string, content_hash string")
    assert {r["code"] for r in health.drift_issues(parsed, known).collect()} == {"source_hash_mismatch"}
    assert health.drift_issues(parsed, spark.createDataFrame([("a.md", "abc")], "key string, content_hash string")).count() == 0
    assert {r["code"] for r in health.drift_issues(parsed, known.where("false")).collect()} == {"source_hash_missing_expected"}
    cross = health.cross_issues(parsed).collect()
    assert [(r["code"], r["file_path"]) for r in cross] == [("duplicate_note_id", "b.md")]
    assert json.loads(health.report_json(df, health.lint(df), "x"))["error_count"] == 1


def test_vault_plan_and_apply(spark, tmp_path):
    wiki, out = tmp_path / "wiki", tmp_path / "out"
    (wiki / "_skip").mkdir(parents=True)
    (wiki / "sub").mkdir()
    (wiki / "a.md").write_text(GOOD, encoding="utf-8")
    (wiki / "sub" / "A.md").write_text(GOOD.replace('"n1"', '"n2"'), encoding="utf-8")
    (wiki / "_skip" / "b.md").write_text("x", encoding="utf-8")
    files = vault.note_files(spark, str(wiki))
    plan = vault.plan(files, root=str(wiki)).cache()
    rows = {r["relative_source"]: r for r in plan.collect()}
    assert set(rows) == {"a.md", "sub/A.md"} and rows["sub/A.md"]["collision"] and not rows["a.md"]["rejected"]
    done = vault.apply(plan, str(out), str(wiki))
    assert done == {"success": True, "errors": [], "copied": 1}
    assert (out / "Vault/Notes/a.md").read_bytes() == (wiki / "a.md").read_bytes()
    assert "[[a.md|Title]]" in (out / "Vault/Index/Home.md").read_text()
    assert json.loads((out / "vault-manifest.json").read_text())["total_notes"] == 1
    assert not vault.apply(plan, str(out), str(wiki))["success"]
    (wiki / "bad.md").write_text("no front matter", encoding="utf-8")
    sick = vault.plan(vault.note_files(spark, str(wiki)), root=str(wiki))
    assert sick.where("not rejected").count() == 0


def test_write_notes_is_not_destructive(spark, tmp_path, sf_dir):
    from proofmill.plans import fixtures

    rows = fixtures.source_notes(spark, sf_dir).where("doc_id < 6").drop("doc_id")
    first = notes.write_notes(rows, str(tmp_path))
    assert sum(r["written"] for r in first) == 4 and sum(r["rejected"] for r in first) == 2  # 0 and 5 hold an unsupported claim
    assert all(r["skipped"] or r["rejected"] for r in notes.write_notes(rows, str(tmp_path)))
    assert health.lint(vault.note_files(spark, str(tmp_path))).count() == 0
    errors = notes.validate(rows.withColumn("metadata", F.col("metadata").withField("note_id", F.lit("z")))).first()["errors"]
    assert errors[0].startswith("note_id mismatch")


def test_settings():
    s = Settings.from_env(env={"PROOFMILL_TOP_K": "x", "PROOFMILL_HYBRID_ALPHA": "2", "PROOFMILL_MODEL_PROVIDER": "Ollama"})
    assert s.top_k == 5 and s.model_provider == "ollama" and s.validate() == ["Invalid integer for PROOFMILL_TOP_K", "hybrid_alpha must be between 0 and 1: 2.0"]
    assert (s.chunk_size, s.chunk_overlap) == (1000, 200) and Settings.from_env(env={}).validate() == []


def test_http_model(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from proofmill.sources.http_model import BadReply, HttpModel, ModelUnavailable

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            reply = {"response": json.dumps({"cleaned_text": asked["prompt"][:3]})} if asked["model"] == "m" else {"other": 1}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(reply).encode())

        def do_GET(self):
            self.send_error(404)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/generate"
    assert HttpModel(url, "m").available() and list(HttpModel(url, "m")(iter(["abcdef"]))) == ['{"cleaned_text": "abc"}']
    with pytest.raises(BadReply):
        list(HttpModel(url, "wrong")(iter(["x"])))
    server.shutdown()
    server.server_close()
    assert not HttpModel(url, "m", probe_timeout=1).available()
    with pytest.raises(ModelUnavailable):
        list(HttpModel(url, "m")(iter(["x"])))


def test_public_names_resolve():
    import proofmill

    assert all(getattr(proofmill, n) is not None for n in proofmill.__all__) and "retrieve" in proofmill.__all__
    assert callable(proofmill.create_pipeline)


def test_foreign_front_matter_is_read(spark):
    from proofmill.operators import health

    foreign = "---\nnote_id: n1\ntags: [a, b]\naliases:\n  - x\n  - y\nnested:\n  deep:\n    - 1\nsource_documents:\n- document_id: d1\n  source_path: p\nsummary: |\n  two\n  lines\n---\n# T\n"
    files = spark.createDataFrame([("a.md", foreign), ("b.md", "---\nx: [broken\n---\n"), ("c.md", "---\nnote_id: \"c\"\n---\n")], "file_path string, content string")
    got = {r["file_path"]: r for r in health.parse(files, yaml=True).collect()}
    assert [got[k]["fm_state"] for k in ("a.md", "b.md", "c.md")] == ["ok", "bad", "ok"]
    assert got["a.md"]["frontmatter"]["note_id"] == "n1" and got["a.md"]["frontmatter"]["summary"] == "two\nlines" and got["a.md"]["source_documents"][0]["document_id"] == "d1"
    assert got["c.md"]["frontmatter"]["note_id"] == "c"


def test_case_folds(spark):
    from pyspark.sql import functions as F

    from proofmill.functions import text

    words = ["Straße", "STRASSE", "ΣΑΣ", "σας", "ı", "I", "i", "Ǆ", "ﬁ", "FI", "É", "é"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(text.fold(F.col("w"))).collect()]
    assert all((got[a] == got[b]) == (words[a].casefold() == words[b].casefold()) for a in range(len(words)) for b in range(len(words)))


def test_later_rows_of_a_path_win(spark):
    from proofmill.sources import manifest

    known = spark.createDataFrame([("p", "h0", 1, "m", "2024-01-01")], manifest.ENTRY)
    runs = [("p", "h2", 2, "m", "2024-01-03"), ("p", "h1", 1, "m", "2024-01-02"), ("q", "h3", 3, "m", "2024-01-02")]
    got = sorted(tuple(r) for r in manifest.upsert(known, spark.createDataFrame(runs, manifest.ENTRY).repartition(3)).collect())
    assert got == [runs[0], runs[2]]


def test_sections_entries_and_sources_of_odd_notes(spark):
    body = "## Claims\n- a [E1]\n## Claims\n- b\n## Other\n## Claims\n- c\n##  \n ## Evidence References \n- **Document**: `d0`\n- **Source Raw Hash**: `h0`\n### E1\n- **Document**: `d1`\n- **Chunk**: none\n- **Source Raw Hash**: `h1`\n- **Source Raw Hash**: `h2`\n### E2\n- **Source Raw Hash**: `h3`"
    files = spark.createDataFrame([("a", '---\nnote_id: "n"\n---\n' + body), ("b", None), ("c", "")], "file_path string, content string")
    parsed = health.parse(files)
    rows = parsed.where("file_path = 'a'").first()["sections"]
    assert [s["line"] for s in rows if s["claims"]] == ["- a [E1]", "- b"]
    assert {s["section"] for s in rows} == {"", "## Claims", "## Other", "## Evidence References"}
    found = health.source_entries(parsed).orderBy("key").select("key", "note_hash").collect()
    assert [tuple(r) for r in found] == [("d0", "h0"), ("d1", "h2")]
    known = spark.createDataFrame([("d0", "h0"), ("d1", "h1")], "key string, content_hash string")
    said = [tuple(r) for r in health.lint(files, known).select("file_path", "code").collect()]
    assert ("a", "source_hash_mismatch") in said and ("a", "source_hash_missing_expected") not in said
    assert said.count(("a", "evidence_missing_document_id")) == 1 and said.count(("a", "evidence_missing_chunk_id")) == 2
    assert ("c", "orphan_note") in said and ("a", "citation_unresolved") not in said


def test_work_on_a_long_note_is_linear(spark):
    entry = "\n".join(f"### E{i}\n- **Document**: `d{i}`\n- **Chunk**: `c{i}`\n- **Source Raw Hash**: `h`" for i in range(20_000))
    files = spark.createDataFrame([("a", '---\nnote_id: "n"\n---\n## Evidence References\n' + entry)], "file_path string, content string")
    assert health.source_entries(health.parse(files)).count() == 20_000


def test_starts_of_very_many_chunks(spark):
    rows = chunk(spark.createDataFrame([("d", "abcdefghij" * 30_000)], "document_id string, raw_text string"), ChunkConfig(100, 0, False))
    assert rows.where("start_offset = chunk_index * 100 and end_offset = start_offset + 100").count() == rows.count() == 3_000


def test_overlapping_chunks_take_linear_time(spark):
    import time

    def seconds(pieces):
        rows = chunk(spark.createDataFrame([("d", "abcdefg hi" * (34 * pieces))], "document_id string, raw_text string").coalesce(1), ChunkConfig(400, 60))
        began = time.time()
        assert rows.where("end_offset - start_offset between 1 and 400 and start_offset = chunk_index * 340").count() == rows.count() == pieces
        return time.time() - began

    seconds(1_000)
    few, many = min(seconds(8_000) for _ in range(2)), min(seconds(32_000) for _ in range(2))
    assert many < 8 * few + 2


def test_vault_preflight_reads_yaml_and_parses_once(spark):
    from pyspark.sql import functions as F

    from proofmill.operators import health, vault
    from proofmill.plans import fixtures

    notes_ = fixtures.faulty_files(spark, "/root/testdata/sf0.001").where("doc_id % 13 = 0").select("file_path", "content").limit(2)
    good = [tuple(r) for r in notes_.collect()]
    foreign = ("wiki/other.md", good[0][1].replace("\n---\n", "\nabout: >\n  folded words\n  of a text\n---\n", 1).replace("note_id: ", "note_id: other_", 1))
    files = spark.createDataFrame([*good, foreign], "file_path string, content string")
    errors = lambda yaml: health.lint(files, yaml=yaml).where("severity = 'error'").count()
    for yaml in (False, True):
        rows = vault.plan(files, root="wiki", yaml=yaml).collect()
        said = {r["rejection_reason"] for r in rows if r["rejection_reason"] and r["rejection_reason"].startswith("Health")}
        assert said == ({f"Health preflight failed with {errors(yaml)} error(s)"} if errors(yaml) else set())
    assert errors(True) < errors(False)
    plan = vault.plan(files.withColumn("content", F.concat("content", F.lit(""))), root="wiki")._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" not in plan and "LocalTableScan" not in plan  # only the written rows are read


def test_health_text_is_grouped_by_file():
    from proofmill.operators import health

    issue = lambda f, c, s="error": {"file_path": f, "code": c, "severity": s, "message": f"{c}!"}
    found = {"path": "w", "files_scanned": 3, "error_count": 2, "warning_count": 1, "passed": False, "issues": [issue("b.md", "x"), issue("a.md", "y"), issue("b.md", "z", "warning")]}
    text = health.report_text(found)
    assert text.splitlines() == ["Wiki Health Report: w", "Files scanned: 3", "Issues: 2 error(s), 1 warning(s)", "Status: FAILED", "", "  a.md:", "    [ERROR] y: y!", "", "  b.md:", "    [ERROR] x: x!", "    [WARNING] z: z!"]
    assert health.report_text({**found, "issues": [], "passed": True}).endswith("Status: PASSED\n\nNo issues found.")
