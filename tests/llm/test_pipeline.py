import corpus_pipeline
from proofmill.llm import decontam, minhash
from proofmill.llm.queries import QUERIES


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontaminate", "mix", "tokens"]
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_one_by_one(spark, sf_dir, tmp_path):
    docs = start = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        seen[name] = docs = spark.read.parquet(str(tmp_path / name))
        if name != "tokens":
            assert docs.columns == start.columns
    assert seen["language"].count() >= 0.98 * start.count()
    groups = minhash.near_groups(seen["language"], minhash.STAGE_PERCENT)
    assert seen["near_dedup"].count() == groups.select("component_id").distinct().count()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontam.find_leaks(seen["near_dedup"], items).count() > 0 == decontam.find_leaks(seen["decontaminate"], items).count()
    most = seen["mix"].groupBy("doc_id").count().agg({"count": "max"}).first()[0]
    assert most <= 2
    assert seen["tokens"].count() == seen["mix"].count()
    last = seen["tokens"].orderBy("start").collect()
    assert [r["start"] for r in last] == [sum(x["n_tokens"] for x in last[:k]) for k in range(len(last))]


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
