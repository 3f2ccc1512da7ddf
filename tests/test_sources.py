import json
import os

import pytest

from proofmill import cli
from proofmill.sources import files, manifest
from proofmill.sources.store import ChunkStore
from proofmill.streaming.incremental import ingest_stream, latest


def test_ingest_new_unchanged_changed(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    for name, body in {"a.md": b"alpha", "sub/a.md": b"alpha", "_u.txt": b"under", "bad.txt": b"\xff\xfe", "skip.bin": b"1", ".h.md": b"h", "data/x.md": b"x", ".git/y.md": b"y", "b c+d.md": b"odd name"}.items():
        os.makedirs(os.path.dirname(f"docs/{name}"), exist_ok=True)
        open(f"docs/{name}", "wb").write(body)
    empty = spark.createDataFrame([], manifest.ENTRY)
    first = files.ingest(spark, "docs", empty)
    got = {r["source_path"]: r["status"] for r in first.collect()}
    assert got == {"docs/a.md": "new", "docs/sub/a.md": "new", "docs/_u.txt": "new", "docs/bad.txt": "error", "docs/skip.bin": "skipped", "docs/.h.md": "skipped", "docs/b c+d.md": "new"}
    assert first.where("status = 'new'").select("document_id").distinct().count() == 4
    known = manifest.upsert(empty, first.where("status = 'new'"))
    (tmp_path / "m.json").write_text(manifest.to_json(known))
    open("docs/a.md", "w").write("beta")
    again = files.ingest(spark, "docs", manifest.load(spark, str(tmp_path / "m.json")))
    got = {r["source_path"]: r["status"] for r in again.collect()}
    assert (got["docs/a.md"], got["docs/sub/a.md"]) == ("changed", "unchanged")
    assert manifest.remove(known, ["docs/a.md"]).count() == 3


def test_corrupt_manifest_raises(spark, tmp_path):
    bad = tmp_path / "m.json"
    for body in ("{broken", '{"version": "1.0"}', '{"entries": [{"content_hash": "x"}]}'):
        bad.write_text(body)
        with pytest.raises(Exception):  # noqa: B017, PT011
            manifest.load(spark, str(bad))


@pytest.mark.parametrize("body", ["nope", "[]", "{}", '{"entries": 1}', '{"entries": [1]}', '{"entries": [{"source_path": "a"}]}'])
def test_source_manifest_shapes(spark, body):
    table, problem = manifest.source_hashes(spark, body)
    assert table is None and problem


def test_source_manifest_last_wins(spark):
    table, _ = manifest.source_hashes(spark, json.dumps({"documents": [{"document_id": "d", "content_hash": "1"}, {"document_id": "d", "content_hash": "2"}]}))
    assert [tuple(r) for r in table.collect()] == [("d", "2")]


def test_store(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"), 4)
    store.store(spark.createDataFrame([(f"d{k % 5}", f"c{k}", k) for k in range(20)], "document_id string, chunk_id string, n int"))
    assert store.get("d1", "c6").count() == 1 and store.get("d1", "c7").count() == 0
    store.delete_document("d1")
    assert store.read().count() == 16 and store.read().where("document_id = 'd1'").count() == 0


def test_incremental_ingest(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = manifest.ENTRY
    row = lambda path, h: (path, h, 1, "t", "t")
    go = lambda: ingest_stream(spark.readStream.schema(schema).parquet(source), str(tmp_path / "m"), str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([row("a", "1"), row("b", "1")], schema).coalesce(1).write.mode("append").parquet(source)
    go()
    spark.createDataFrame([row("a", "2"), row("c", "1"), row("b", "1")], schema).coalesce(1).write.mode("append").parquet(source)
    go()
    got = {(r["v"], r["source_path"], r["status"]) for r in spark.read.parquet(str(tmp_path / "s")).select("v", "source_path", "status").collect()}
    assert got == {(0, "a", "new"), (0, "b", "new"), (1, "a", "changed"), (1, "b", "unchanged"), (1, "c", "new")}
    assert {(r["source_path"], r["content_hash"]) for r in latest(spark, str(tmp_path / "m")).collect()} == {("a", "2"), ("b", "1"), ("c", "1")}


def test_cli(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    os.makedirs("docs")
    open("docs/a.md", "w").write("x")
    assert cli.main(["version"]) == 0
    assert cli.main(["ingest", "docs", "--manifest", "m.json", "--json"]) == 0
    assert json.loads(capsys.readouterr().out.split("\n", 1)[1])["new_files"] == 1
    assert cli.main(["health", "docs"]) == 1
    assert cli.main(["vault-plan", "docs", "out"]) == 1
    assert cli.main(["vault-adapt", "docs", "out", "--allow-unhealthy"]) == 0
    assert os.path.exists("out/Vault/Notes/a.md")
