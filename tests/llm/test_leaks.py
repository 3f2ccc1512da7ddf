"""Decontamination against every window and item, at and around the least overlap."""

import time

import numpy as np
import pytest

from proofmill.llm import decontam
from tests.llm import brute

DOCS = "doc_id long, text string"


def words_from(rng, n, pool=4000):
    return [f"w{int(k)}" for k in rng.integers(0, pool, n)]


def without(rng, words, shingles):
    """The words with about `shingles` shingles broken: cut at the ends or one word changed."""
    words = list(words)
    kind = int(rng.integers(0, 3))
    if kind == 0 or shingles < 5:
        front = int(rng.integers(0, shingles + 1))
        return words[front : len(words) - (shingles - front)]
    words[int(rng.integers(4, max(5, len(words) - 5)))] = "changed"
    return words[shingles - 5 :] if kind == 1 else words[: len(words) - (shingles - 5)]


def planted(rng, answer):
    items, docs = [], []
    for n in (*range(5, 21), 25, 30, 35, 40, 60, 90):
        for k in range(4):
            question = words_from(rng, n + 4)
            told = words_from(rng, 5) if answer else []
            items.append((len(items), " ".join(question) + "." + (" " + " ".join(told) + "." if answer else "")))
            for broken in (n // 5, n // 5 + 1):
                left = without(rng, question, broken) + (told[: 4 - (k == 3)] if answer else [])
                docs.append((len(docs), " ".join([*words_from(rng, int(rng.integers(0, 150))), *left, *words_from(rng, int(rng.integers(0, 150)))])))
    return docs, items


@pytest.mark.parametrize("answer", [False, True])
def test_least_overlap_is_never_lost(answer):
    import pyarrow as pa

    docs, items = planted(np.random.default_rng(31 + answer), answer)
    found = {(docs[d][0], i) for d, i in decontam.leaks_in(decontam.build(items), pa.array([t for _, t in docs]))}
    want = brute.leaks(docs, items)
    assert found == want and len(want) > 60


def test_equal_to_every_window_and_item(spark, sf_dir):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items += [(900, "Two words"), (901, "eins"), (902, "今天天气很好我们去公园散步"), (903, "?! ..."), (904, None), (905, ""), (906, "Right. Left."), (907, "สวัสดีครับ"), (0, "a second text of the same number")]
    docs += [(9000, "here two WORDS, stand"), (9001, "two other words"), (9002, "eins zwei"), (9003, "昨天说今天天气很好我们去公园散步吧"), (9004, "right or left"), (9005, None), (9006, "x " * 40_000 + items[3][1]), (9007, "สวัสดีครับ ok"), (9008, "with a second text of the same number inside")]
    table = spark.createDataFrame([(*r, 0.5, 7) for r in docs], DOCS + ", score double, item_id long")
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(table, bench).collect()}
    want = brute.leaks(docs, items)
    assert got == want and {(9000, 900), (9002, 901), (9003, 902), (9004, 906), (9006, items[3][0]), (9007, 907), (9008, 0)} <= got
    kept = decontam.drop_leaks(table, bench)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_repeated_ids(spark):
    item = " ".join(words_from(np.random.default_rng(1), 30))
    docs = spark.createDataFrame([(1, f"a {item} b"), (1, "clean"), (1, f"a {item} b"), (None, item)], DOCS)
    bench = spark.createDataFrame([(5, item), (5, item), (None, "clean")], "item_id long, text string")
    assert sorted((r["doc_id"] or -1, r["item_id"]) for r in decontam.find_leaks(docs, bench).collect()) == [(-1, 5), (1, 5)]
    assert [r["text"] for r in decontam.drop_leaks(docs, bench).collect()] == ["clean"]


def test_large_index_is_built_quickly():
    rng = np.random.default_rng(3)
    items = [(k, " ".join(words_from(rng, 60, 60_000)) + ". " + " ".join(words_from(rng, 8, 60_000))) for k in range(5000)]
    began = time.time()
    index = decontam.build(items)
    assert time.time() - began < 20
    arrays = sum(v.nbytes for i in index for v in vars(i).values() if isinstance(v, np.ndarray))
    assert arrays < 16 * sum(len(t) for _, t in items)
