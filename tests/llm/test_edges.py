"""Repeated ids, very long inputs, votes counted bit by bit, and the pipeline's stages on odd tables."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from proofmill.llm import langid, simhash, tokenbin, urlrules

WRAP = (1 << 64) - 1


def mixed(x):
    x = ((x ^ (x >> 30)) * simhash.MIX[1]) & WRAP
    x = ((x ^ (x >> 27)) * simhash.MIX[2]) & WRAP
    return x ^ (x >> 31)


def plain_fingerprint(text):
    """Every term votes on every bit, one by one, in whole Python numbers."""
    words = [xxhash.xxh3_64_intdigest(w) for w in text.encode().lower().split()]
    terms = Counter(words) + Counter(mixed((a * simhash.MIX[0] + b) & WRAP) for a, b in zip(words, words[1:], strict=False))
    votes = [0.0] * simhash.BITS
    for term, n in terms.items():
        weight = 1 + math.log(n)
        halves = (mixed((term + simhash.MIX[0]) & WRAP), mixed((term * simhash.MIX[1] + 1) & WRAP))
        own = b"".join(h.to_bytes(8, "little") for h in halves)
        for k in range(simhash.BITS):
            votes[k] += weight if own[k // 8] >> (7 - k % 8) & 1 else -weight
    return votes


def test_votes_are_counted_bit_by_bit(spark, sf_dir):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    for text in [*texts, "", "one", "same same same", "é ÉÈ ß 日本 " * 50]:
        got = int.from_bytes(simhash.fingerprint(text.encode()))
        for k, vote in enumerate(plain_fingerprint(text)):
            assert abs(vote) < 1e-3 or (got >> (simhash.BITS - 1 - k) & 1) == (vote > 0)


def test_repeated_ids_and_very_long_texts(spark):
    long = "Ein sehr langer Satz, a very long one. " * 60_000
    rows = [(1, "b text"), (1, "a text"), (1, None), (2, long), (2, long), (3, "a text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    prints = simhash.fingerprints(docs).collect()
    order = [None, "a text", "b text", long, long, "a text"]
    digests = [simhash.fingerprint((t or "").encode()) for t in order]
    want = sorted((i, d.hex(), simhash.likeness(d, digests[(k + 1) % 6])) for k, (i, d) in enumerate(zip([1, 1, 1, 2, 2, 3], digests, strict=True)))
    assert sorted((r["doc_id"], r["fingerprint"], r["near_next"]) for r in prints) == want
    shards = sorted(map(tuple, tokenbin.token_output(docs).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    assert [s[1] for s in shards] == [1, 1, 1, 2, 2, 3] and [s[2] for s in shards][:3] == [1, 3, 3] and shards[3][2:] == shards[4][2:]
    assert all(a[0] + a[2] == b[0] for a, b in zip(shards, shards[1:], strict=False))
    labelled = docs.withColumn("lang", F.when(F.col("doc_id") == 2, "de").otherwise("en"))
    found = sorted((r["doc_id"], r["lang_pred"], r["held_out"]) for r in langid.identify(labelled).collect())
    assert len(found) == 6 and all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, h in found) and (1, "und", found[0][2]) in found


def test_a_very_long_url(spark):
    host, path = "x" * 50_000 + ".Example.NET", "/en/" + "y" * 1_000_000
    pages = spark.createDataFrame([(1, f"http://{host}{path}?q#f"), (1, f"http://{host}{path}?q#f"), (2, "http://" + "net" * 300_000)], "page_id long, url string")
    got = urlrules.judge_urls(pages, [("net/", "block"), ("example.net/en/", "allow")]).orderBy("page_id").collect()
    assert [(r["rule"], r["verdict"]) for r in got] == [("example.net/en/", "allow")] * 2 + [(None, "allow")]
    assert got[0]["host"] == host.lower() and got[0]["path"] == path


@pytest.fixture(scope="module")
def odd_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    twice = docs.unionByName(docs.where("doc_id % 5 = 0"))  # repeated rows
    odd = spark.createDataFrame([(None, "the heat of the sun", "en", "src0", 19), (900_001, None, "en", None, 0), (900_002, "", None, "src1", 0), (900_003, "123 456", None, None, 7)], docs.schema)
    clash = {"size": F.lit("s"), "component_id": F.lit(1), "_row": F.lit(2), "_c0": F.lit("c"), "copies": F.lit(9), "accepted": F.lit("no")}
    return twice.unionByName(odd).withColumns(clash)


def test_stages_keep_columns_and_take_odd_rows(spark, sf_dir, odd_table):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd_table, sf_dir)
        assert out.columns == odd_table.columns, name
        assert out.count() >= 100 and out.where("size != 's' or copies != 9 or accepted != 'no'").count() == 0, name
        assert stage(spark, odd_table.where("false"), sf_dir).count() == 0, name
    kept = corpus_pipeline.language(spark, odd_table, sf_dir)
    assert kept.where("doc_id in (900001, 900002, 900003)").count() == 0 and kept.where("doc_id is null").count() == 1
    near = corpus_pipeline.near_dedup(spark, odd_table, sf_dir)
    assert near.groupBy("doc_id").count().where("count > 1").count() == 0


def test_pipeline_equals_its_stages_done_plainly(spark, sf_dir):
    """Near-dedup, decontamination, mix and tokens of sf0.001 from brute force over what language kept."""
    from tests.llm import brute
    from tokenizers import Tokenizer

    from proofmill.llm import minhash, mixing

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"]: r for r in corpus_pipeline.language(spark, docs, sf_dir).collect()}
    groups, _ = brute.near_groups([(i, r["text"]) for i, r in kept.items()], minhash.STAGE_PERCENT)
    left = {i: r for i, r in kept.items() if groups[i] == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    dirty = {d for d, _ in brute.leaks([(i, r["text"]) for i, r in left.items()], items)}
    clean = [r for i, r in left.items() if i not in dirty]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_report(spark.createDataFrame(clean, docs.schema)).collect()}  # equal to its SQL elsewhere
    whole = Tokenizer.from_file(tokenbin.default_tokenizer())
    want, start = [], 0
    for r in sorted(clean, key=lambda r: r["doc_id"]):
        ids = [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for _ in range(copies[r["doc_id"]]):
            want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == sorted(want)
