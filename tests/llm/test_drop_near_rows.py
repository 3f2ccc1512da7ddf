"""Rows that share or lack a doc_id are deduplicated by their texts."""

import numpy as np

from proofmill.llm import minhash


def test_rows_and_not_ids_decide(spark):
    rng = np.random.default_rng(8)
    long = lambda: " ".join("w" + str(k) for k in rng.integers(0, 5000, 60))
    one, two, three, four = long(), long(), long(), long()
    rows = [(1, one), (1, two), (1, two), (2, one + " tail"), (None, three), (None, three), (None, three), (3, four), (None, None), (5, None), (5, None), (6, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string")
    got = sorted((r["doc_id"] or -1, r["text"] or "") for r in minhash.drop_near(docs).collect())
    assert got == sorted([(-1, ""), (-1, three), (1, one), (1, two), (3, four), (5, ""), (6, "")])
    assert minhash.drop_near(docs).columns == docs.columns
