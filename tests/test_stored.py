"""Stored index, keyed stream state, incremental corpus: twins, what is read, what is done again."""

import pytest
from pyspark.sql import functions as F

from proofmill.config import MetadataFilter, RetrievalRequest
from proofmill.functions import ids
from proofmill.operators import refine, retrieve
from proofmill.operators.chunk import chunk
from proofmill.operators.incremental import IncrementalCorpus
from proofmill.operators.replies import ReplyTable
from proofmill.plans import catalogue, stored_catalogue
from proofmill.sources import scratch
from proofmill.sources.index import SIDES, StoredIndex
from proofmill.sources.tables import corpus, table_documents, text_documents
from tests.oracle_check import same


@pytest.mark.parametrize("name", sorted(stored_catalogue.ORACLE))
def test_stored_query_equals_its_twin(spark, sf_dir, name):
    same(stored_catalogue.QUERIES[name](spark, sf_dir), stored_catalogue.ORACLE[name], sf_dir)


@pytest.fixture(scope="module")
def index(spark, sf_dir):
    return StoredIndex(spark, scratch.shared(spark, "index"), 8).build(corpus(table_documents(spark, sf_dir)), block=8)


def hits(df):
    return [tuple(r) for r in df.select("chunk_id", "keyword_score", "matched_fields", "source_path", "raw_text").orderBy(F.desc("keyword_score"), "document_id", "chunk_id").collect()]


@pytest.mark.parametrize("policy", [*SIDES, "other"])
def test_index_equals_the_scan_and_opens_fewer_blocks(spark, sf_dir, index, policy):
    rows = corpus(table_documents(spark, sf_dir))
    chosen = MetadataFilter(source_type="md", key_value={"lang": "fr"})
    for query, filters in ((catalogue.QUERY, None), ("the the THE of", None), (catalogue.OTHER, chosen), ("nowhere found", None), ("?!", None)):
        request = RetrievalRequest(query, 3, filters=filters)
        assert hits(index.keyword_hits(None, request, policy, 6)) == hits(retrieve.keyword_hits(rows, request, policy, 6))
    few, every = index.blocks(["the"], policy, 3), index.blocks(["the"], policy, None)
    # scores stop at 1, and whole chunks of "the" reach it in both texts together: all those tie
    assert 0 < few.count() <= every.count() - (policy != "dual_context")


def test_index_reads_the_buckets_of_the_query(index):
    plan = index.blocks(["the"], "raw_only", None)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(token), EqualTo(token,the)" in plan
    assert index.terms(["the"]).first()["chunks"] == index.blocks(["the"], "raw_only", None).agg(F.sum("n")).first()[0]
    assert index.postings().agg(F.max("n")).first()[0] <= 8


def test_a_document_filter_reads_one_part(spark, sf_dir, index):
    from pyspark.sql import Observation

    own = table_documents(spark, sf_dir).where("size_bytes > 0").agg(F.max("document_id")).first()[0]
    found = index.filtered(MetadataFilter(document_id=own))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and f"EqualTo(document_id,{own})" in plan
    seen = Observation()
    files = found.select(F.input_file_name().alias("f")).observe(seen, F.max("f").alias("f"), F.min("f").alias("g")).collect()
    assert files and seen.get["f"] == seen.get["g"] and "part=" in seen.get["f"]


def test_pipeline_on_an_index_equals_one_on_the_corpus(spark, sf_dir, index):
    request = catalogue._request()
    cols = ["rank", "chunk_id", "keyword_score", "vector_score", "hybrid_score", "matched_fields", "source_retrievers", "score_policy", "total_candidates", "raw_text"]
    got = retrieve.HybridPipeline(index.chunks(), keyword=index.keyword_hits).retrieve(request).select(*cols)
    want = retrieve.HybridPipeline(corpus(table_documents(spark, sf_dir))).retrieve(request).select(*cols)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_batch_lists_from_an_index_equal_single_ones(spark, sf_dir, index):
    asked = [(1, catalogue.QUERY), (2, "the the of"), (3, "?!")]
    found = index.keyword_batch(spark.createDataFrame(asked, "query_id int, query string"), 4).collect()
    for number, query in asked:
        one = index.keyword_hits(None, RetrievalRequest(query, 2), "dual_context", 4).collect()
        assert {(r["chunk_id"], round(r["score"], 9)) for r in found if r["query_id"] == number} == {(r["chunk_id"], round(r["keyword_score"], 9)) for r in one}


def test_best_lists_keep_the_best_of_each_task_and_the_least_keys_of_ties(spark):
    rows = [(f"d{k % 7}", f"c{k:03}", "a " * (k % 4) + "b", 1 + k % 2) for k in range(500)]
    corpus = spark.createDataFrame(rows, "document_id string, chunk_id string, low string, times int").repartition(3)
    asked = spark.createDataFrame([(1, "a b a"), (2, "none"), (3, "A")], "query_id int, query string")
    kept = retrieve.best_lists(corpus, asked, 5).collect()
    assert len(kept) <= 3 * (2 + 3) * 5  # tasks, lists, chunks: no row for a pair
    for query_id, tokens in ((1, ["a", "b", "a"]), (2, ["none"]), (3, ["a"])):
        def score(r):
            f = lambda t: r[3] * r[2].split().count(t)  # noqa: B023, E731
            return min(1.0, round(sum(f(t) * 1.5 / (f(t) + 0.5) for t in tokens if f(t)), 12) / (1 + 0.001 * r[3] * len(r[2].split())))
        want = sorted((-score(r), r[0], r[1]) for r in rows if score(r))[:5]
        got = sorted((-r["score"], r["document_id"], r["chunk_id"]) for r in kept if r["query_id"] == query_id and r["list"] == "keyword")[:5]
        assert [(round(s, 12), d, c) for s, d, c in got] == [(round(s, 12), d, c) for s, d, c in want]


def test_hybrid_retrieval_cuts_the_corpus_once_for_both_lists(spark, sf_dir):
    lists = retrieve.built_in_lists(corpus(table_documents(spark, sf_dir)), catalogue._request(), "dual_context", 40)
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "WindowGroupLimit" in plan


def texts(spark, **named):
    rows = spark.createDataFrame(list(named.items()), "name string, text string")
    return text_documents(rows, F.concat("name", F.lit(".md")))


def test_incremental_corpus_works_on_what_changed(spark):
    kept = IncrementalCorpus(spark, scratch.shared(spark, "kept"), shards=2)
    first = kept.ingest(texts(spark, a="alpha beta. " * 200, b="beta", c="gamma", d="delta"))
    assert (first.recomputed, first.removed) == (4, 0)
    now = texts(spark, a="alpha beta. " * 200, b="beta two", c="", e="beta")
    second = kept.ingest(now)
    assert (second.recomputed, second.removed) == (3, 1)
    assert {r["source_path"]: r["status"] for r in second.statuses.collect()} == {"a.md": "unchanged", "b.md": "changed", "c.md": "changed", "e.md": "new"}
    want = refine.document_rollup(refine.refine_chunks(chunk(now)))
    assert sorted(map(str, kept.rollups.read().select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert {r["source_path"]: r["run"] for r in kept.rollups.read().collect()} == {"a.md": 1, "b.md": 2, "e.md": 2}
    assert {r["token"]: (r["documents"], r["n"]) for r in kept.document_frequencies().collect()} == {"alpha": (1, 200), "beta": (3, 202), "two": (1, 1)}
    third = kept.ingest(now)
    assert (third.recomputed, third.removed) == (0, 0) and kept.chunks.version() == 3


def test_a_run_that_stops_half_way_is_done_again(spark, monkeypatch):
    kept = IncrementalCorpus(spark, scratch.shared(spark, "half"), shards=2)
    kept.ingest(texts(spark, a="one", b="two"))
    monkeypatch.setattr(kept.manifest, "replace", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        kept.ingest(texts(spark, a="one more", b="two"))
    monkeypatch.undo()
    again = kept.ingest(texts(spark, a="one more", b="two"))
    assert again.recomputed == 1 and kept.rollups.read().count() == 2
    assert {r["raw_text"] for r in kept.chunks.read().collect()} == {"one more", "two"}


def test_document_ids_follow_the_text(spark):
    one, two = (texts(spark, a=t).first()["document_id"] for t in ("x", "y"))
    assert one[:16] == two[:16] and one != two and one == texts(spark, a="x").select(ids.document_id(F.col("source_path"), F.col("content_hash"))).first()[0]


def test_holding_finds_every_document_that_contains_an_item(spark):
    texts = ["say foo bar now", "foobar", "afoo barb", "pre one two three four five six seven! post", "one two three four", "prea b cpost", "", "the the the the the the"]
    items = ["foo bar", "a b c", "one two three four five six seven", "two three four", "the the the", "absent words here", ""]
    docs = spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(texts)] + [("none", None)], "document_id string, raw_text string")
    asked = spark.createDataFrame(list(enumerate(items)), "query_id int, item string")
    want = {(q, f"d{k}") for q, item in enumerate(items) for k, t in enumerate(texts) if item in t}
    assert sorted(map(tuple, retrieve.holding(docs, asked).collect())) == sorted(want)


class Counted:
    """Replies with the prompt's length and notes each call in a folder; may stop at a word."""

    def __init__(self, folder, stop=""):
        self.folder, self.stop = folder, stop

    def __call__(self, prompts):
        import os
        import uuid

        for p in prompts:
            if self.stop and self.stop in p:
                os._exit(1)  # the worker dies, and its task with it
            with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(p)
            yield str(len(p))


def test_replies_are_asked_for_once(spark, tmp_path):
    table = ReplyTable(spark, scratch.shared(spark, "replies"), 2)
    prompts = spark.createDataFrame([(f"prompt {k % 40}",) for k in range(100)] + [(None,)], "prompt string")
    seen = lambda: sorted(p.read_text() for p in tmp_path.iterdir())
    assert table.ask(prompts.where("prompt < 'prompt 2'"), Counted(tmp_path), 5) == 12
    assert len(set(seen())) == len(seen()) == 12
    with pytest.raises(Exception, match="(?s).*"):
        table.ask(prompts, Counted(tmp_path, "prompt 39"), 4)
    done = table.replies().count()
    lost = len(seen()) - done  # calls of the round that died
    assert 12 <= done < 40 and lost <= 8
    assert table.ask(prompts, Counted(tmp_path)) == 40 - done and table.ask(prompts, Counted(tmp_path)) == 0
    assert len(seen()) == 40 + lost and {r["reply"] for r in table.replies().collect()} == {"8", "9"}


def test_a_round_reads_its_own_prompts_alone(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "asked")
    monkeypatch.setattr(scratch, "shared", lambda *_: f"file://{at}")
    table = ReplyTable(spark, f"file://{tmp_path}/table", 2)
    calls = tmp_path / "calls"
    calls.mkdir()
    assert table.ask(spark.createDataFrame([(f"p{k}",) for k in range(30)], "prompt string"), Counted(calls), 5) == 30
    dealt = spark.read.parquet(f"{at}-rounds")
    assert dealt.count() == 30 and dealt.select("round").distinct().count() > 1 and table.replies().count() == 30


def test_request_problems_equal_single_checks(spark):
    grid = [(q, k, a, p) for q in ("q", " \u2003\x1c", "", "a b") for k in (-1, 0, 1) for a in (-0.1, 0.0, 1.0, 1.5) for p in (None, "raw_only", "x")]
    rows = spark.createDataFrame([(n, *g) for n, g in enumerate(grid)], "n int, query string, top_k int, alpha double, text_policy string")
    got = {r["n"]: r["problems"] for r in retrieve.request_problems(rows).collect()}
    assert got == {n: RetrievalRequest(q, k, a, text_policy=p).problems() for n, (q, k, a, p) in enumerate(grid)}
