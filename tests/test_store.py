"""Chunk store: versions, time travel, concurrent writers, crashes."""

import threading

import pytest

from proofmill.sources import scratch
from proofmill.sources.store import ChunkStore, Conflict


def rows(spark, *names, text="x"):
    return spark.createDataFrame([(d, f"chunk_{d}_{k}", text) for d in names for k in range(2)], "document_id string, chunk_id string, raw_text string")


def held(df):
    return sorted({(r["document_id"], r["raw_text"]) for r in df.collect()})


@pytest.fixture
def store(spark):
    return ChunkStore(spark, scratch.shared(spark, "store"), 4)


def test_versions_and_time_travel(spark, store):
    assert store.version() == 0
    assert [store.store(rows(spark, "a", "b")), store.store(rows(spark, "c")), store.delete_document("a")] == [1, 2, 3]
    assert store.replace(rows(spark, "b", text="y")) == 4 and store.store(rows(spark, "a", text="z")) == 5
    want = {1: ["ax", "bx"], 2: ["ax", "bx", "cx"], 3: ["bx", "cx"], 4: ["by", "cx"], 5: ["az", "by", "cx"]}
    for version, names in want.items():
        assert held(store.read(version)) == [tuple(n) for n in names]
        assert store.read(version).columns == ["document_id", "chunk_id", "raw_text"]
    assert store.compact() == 6 and held(store.read()) == held(store.read(5))
    assert store.read(6).count() == 6 and store.get("a", "chunk_a_1").count() == 1 and store.get("a", "chunk_a_1", 3).count() == 0
    assert len(store.expire(6)) == 6 and held(store.read()) == [("a", "z"), ("b", "y"), ("c", "x")]
    assert store.expire(6) == [] and store.delete_documents(store.read()) == 7 and store.read().count() == 0


def test_a_lookup_reads_one_shard(spark, store):
    store.store(rows(spark, *[f"d{k}" for k in range(40)]))
    plan = store.get("d7", "chunk_d7_0")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan


def test_concurrent_writers_lose_nothing(spark, store):
    store.store(rows(spark, "old"))
    failed, versions = [], []

    def run(job):
        try:
            versions.append(job())
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    jobs = [lambda k=k: store.store(rows(spark, f"n{k}")) for k in range(4)] + [lambda: store.delete_document("old"), lambda: store.delete_document("none")]
    threads = [threading.Thread(target=run, args=(j,)) for j in jobs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and sorted(versions) == [2, 3, 4, 5, 6, 7] and [e["number"] for e in store.log()] == list(range(1, 8))
    assert held(store.read()) == [(f"n{k}", "x") for k in range(4)]


def test_a_compaction_yields_to_a_deletion_and_a_number_is_given_once(spark, store, monkeypatch):
    store.store(rows(spark, "a"))
    store.store(rows(spark, "b"))
    write = store._write

    def late(chunks):
        name = write(chunks)
        other = ChunkStore(spark, store.path, 4)
        other.delete_document("a")
        return name

    monkeypatch.setattr(store, "_write", late)
    with pytest.raises(Conflict):
        store.compact()
    monkeypatch.undo()
    assert held(store.read()) == [("b", "x")] and store.compact() == 4 and held(store.read()) == [("b", "x")]
    assert not store._claim(4, {"schema": "", "added": [], "gone": [], "removed": []})


def test_an_append_during_a_compaction_stays(spark, store, monkeypatch):
    for d in ("a", "b"):
        store.store(rows(spark, d))
    write = store._write
    monkeypatch.setattr(store, "_write", lambda chunks: (write(chunks), ChunkStore(spark, store.path, 4).store(rows(spark, "c")))[0])
    assert store.compact() == 4 and held(store.read()) == [("a", "x"), ("b", "x"), ("c", "x")]


def test_a_crash_before_the_log_entry_changes_nothing(spark, store, monkeypatch):
    store.store(rows(spark, "a"))
    monkeypatch.setattr(store, "_claim", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    for job in (lambda: store.store(rows(spark, "b")), lambda: store.delete_document("a"), lambda: store.replace(rows(spark, "a", text="y"))):
        with pytest.raises(OSError, match="lost"):
            job()
    monkeypatch.undo()
    assert store.version() == 1 and held(store.read()) == [("a", "x")]
