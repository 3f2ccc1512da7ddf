"""One small case for each finding of the fourth round that was mended."""

import json
import os

from pyspark.sql import functions as F

from proofmill.operators import notes, replies, vault
from proofmill.plans import file_catalogue, fixtures
from proofmill.sources import scratch, store
from proofmill.streaming import keyed


def test_vault_files_are_written_copied_and_read_by_tasks(spark, sf_dir, monkeypatch):
    """the driver renders, copies and reads no note, and lists none by name."""
    monkeypatch.setattr(notes, "write_notes", None)
    monkeypatch.setattr(vault, "index_page", None)
    monkeypatch.setattr(vault, "manifest", None)
    found = file_catalogue.vault_files(spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "LocalTableScan" not in plan and "ExistingRDD" not in plan


def test_written_vault_equals_its_texts(spark, tmp_path, sf_dir):
    """the strung files are the one-text index pages and manifest; also of no notes."""
    rows = fixtures.source_notes(spark, sf_dir).where("doc_id < 40").drop("doc_id")
    for name, some in (("some", rows), ("none", rows.limit(0))):
        wiki, out = tmp_path / name / "wiki", tmp_path / name / "out"
        written = notes.write_files(some, str(wiki))
        assert written.where("written").count() == len(list(wiki.iterdir())) == (32 if name == "some" else 0)
        plan = vault.plan(vault.note_files(spark, str(wiki)), root=str(wiki)).cache()
        assert vault.apply(plan, str(out), str(wiki))["success"]
        for page in vault.INDEXES:
            assert (out / "Vault/Index" / page).read_text() == vault.index_page(page, plan)
        said = (out / "vault-manifest.json").read_text()
        assert said == vault.manifest(plan, str(wiki), str(out), at=json.loads(said)["generated_at"])


def test_a_failed_copy_takes_back_what_was_copied(spark, tmp_path, sf_dir):
    """also where tasks copy; what was there before stays."""
    rows = fixtures.source_notes(spark, sf_dir).where("doc_id < 40").drop("doc_id")
    wiki, out = tmp_path / "wiki", tmp_path / "out"
    notes.write_files(rows, str(wiki))
    name = sorted(os.listdir(wiki))[3]
    (out / "Vault/Notes" / name).mkdir(parents=True)
    (out / "kept.md").write_text("kept")
    plan = vault.plan(vault.note_files(spark, str(wiki)), root=str(wiki))
    done = vault.apply(plan, str(out), str(wiki), vault.VaultConfig(allow_overwrite=True))
    assert not done["success"] and name in done["errors"][0] and done["copied"] == 0
    assert [p.name for p in out.rglob("*") if p.is_file()] == ["kept.md"]


def test_notes_of_one_file_name_are_written_once(spark, tmp_path, sf_dir):
    """the first by note_id writes, later ones and those that are there are skipped."""
    one = fixtures.source_notes(spark, sf_dir).where("doc_id in (1, 2, 5)").drop("doc_id")
    first = notes.write_notes(one.unionByName(one), str(tmp_path))
    assert [(r["written"], r["skipped"], r["rejected"]) for r in first if r["rejected"]] == [(False, False, True)] * 2
    assert sum(r["written"] for r in first) == 2 and sum(r["skipped"] for r in first) == 2
    long = one.where(F.col("note_id") == "note_1").withColumns({"note_id": F.lit("n" * 200), "metadata": F.col("metadata").withField("note_id", F.lit("n" * 200))})
    again = notes.write_notes(one.unionByName(long), str(tmp_path))
    assert sum(r["skipped"] for r in again) == 2 and [r["reason"][:12] for r in again if r["file_path"].endswith("6e.md")] == ["write failed"]
    assert not [n for n in os.listdir(tmp_path) if n.startswith(".")]


def test_stream_states_are_kept_by_bucket(spark, tmp_path):
    """many paths share a state; statuses of paths beside each other, null sizes and large ones are their own."""
    rows = [[(f"p{k}", f"h{k % (n + 2)}" if (k + n) % 3 else None, None if k % 2 else 2**53 + 1, "m", f"run {n}") for k in range(60)] for n in range(3)]
    at, schema = tmp_path.as_uri(), "source_path string, content_hash string, size_bytes long, modified_time string, last_ingested string"
    for n, some in enumerate(rows):
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"{at}/events/run={n}")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{at}/events/run=*")
    calls = keyed.BUCKETS
    try:
        keyed.BUCKETS = 3
        keyed.follow(events, f"{at}/statuses", f"{at}/checkpoint").awaitTermination()
    finally:
        keyed.BUCKETS = calls
    known, want = {}, set()
    for r in (r for some in rows for r in some):
        before, known[r[0]] = known.get(r[0]), r[1]
        want.add((*r, ("skipped" if before is None else "removed") if r[1] is None else "new" if before is None else "unchanged" if before == r[1] else "changed"))
    assert {tuple(r)[:6] for r in spark.read.parquet(f"{at}/statuses").drop("v").collect()} == want
    assert keyed.current(spark, f"{at}/statuses").count() == sum(v is not None for v in known.values())
    last = max(int(p.name) for p in (tmp_path / "checkpoint/state/0").iterdir() if p.name.isdigit())
    assert last >= 0 and spark.read.format("statestore").load(f"{at}/checkpoint").count() <= 3  # a state for each bucket, not path


def test_the_log_is_read_once_and_hashes_meet_before_texts(spark, tmp_path, monkeypatch):
    """a commit reads only entries it has not seen, also those of others; rounds end in fewer commits."""
    one, other = (store.ChunkStore(spark, tmp_path.as_uri(), 2) for _ in range(2))
    rows = lambda k: spark.createDataFrame([(f"d{k}", "c")], "document_id string, chunk_id string")
    one.store(rows(0))
    other.store(rows(1))
    one.store(rows(2))
    assert [e["number"] for e in one.log()] == [e["number"] for e in other.log()] == [1, 2, 3]
    monkeypatch.setattr(type(spark), "read", None)
    assert one.version() == other.version() == 3  # nothing is read again


def test_an_answered_prompt_is_not_dealt_again(spark, tmp_path, monkeypatch):
    """the second run writes the hashes that lack a reply, and no prompt."""
    made = iter(("first", "second"))
    monkeypatch.setattr(scratch, "shared", lambda *_: f"{tmp_path.as_uri()}/{next(made)}")
    table = replies.ReplyTable(spark, f"{tmp_path.as_uri()}/table", 2)
    prompts = spark.createDataFrame([(f"p{k}",) for k in range(30)], "prompt string")
    assert table.ask(prompts, file_catalogue.AbsentModel(), 5) == 30 and table.ask(prompts, file_catalogue.AbsentModel(), 5) == 0
    assert not (tmp_path / "second").exists() and (tmp_path / "second-hashes").exists()
