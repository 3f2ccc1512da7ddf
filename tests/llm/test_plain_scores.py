"""Language and licence results against plain, uncached, per-text versions of the same models."""

import re

import numpy as np
from pyspark.sql import functions as F

from proofmill.llm import langid, licenses


def test_languages_equal_plain_prediction(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(9000, None, "en"), (9001, "x" * 60_000, None), (9002, "Ein Wort " * 9000, "de"), (9003, "123", None), (1, "twice", "en"), (9004, "é ß 日本語", "fr")]
    rows = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    model = langid.fit(rows)
    got = sorted((r["_c0"], r["_lang"], round(r["_score"], 9), r["_accepted"]) for r in langid.predict(rows, model, ["doc_id"]).collect())
    want = []
    for r in rows.collect():
        buckets, _ = langid.features((r["text"] or "").encode().split())
        if not len(buckets):
            want.append((r["doc_id"], "und", 0.0, False))
            continue
        z = model["logits"].astype(np.float64)[buckets].mean(0) + model["bias"]
        own, long = z[:-1] / model["temperature"], len(buckets) >= langid.LONG
        p = np.exp(own - own.max()) / np.exp(own - own.max()).sum()
        strong = model["apart"].astype(np.float64)[buckets].mean() >= model["least"][long]
        want.append((r["doc_id"], model["langs"][int(p.argmax())], round(float(p.max()), 9), bool(z[-1] - z[:-1].max() <= model["most"][long] and strong)))
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in sorted(want)]
    assert max(abs(g[2] - w[2]) for g, w in zip(got, sorted(want), strict=True)) < 1e-6


def plain_license(text, model):
    text = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    gate = re.compile("(?<![a-z0-9])(?:" + "|".join(model["gate"]) + ")(?![a-z0-9])")
    split = lambda t: re.findall("[a-z0-9]+", t)
    lines = [split(x) for x in text.split("\n") if gate.search(x)]
    units = list(lines)
    if lines and "\n" in text:
        units += [w for w in licenses.windows(split(text)) if set(w) & set(model["gate"])]
    best, licensed = None, False
    for words in units:
        own = licenses.grams(words) & set(model["weights"])
        z = sum((np.array(model["weights"][g]) for g in own), np.zeros(len(model["families"]))) / np.sqrt(max(1, len(own)))
        z = (z + np.array(model["bias"])) / model["temperature"]
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        licensed = licensed or 1 - p[-1] >= model["licensed"]
        k = int(p[:-2].argmax())
        if p[k] < model["reject"]:
            continue
        pairs = licenses.grams(words, 2)
        for family, template in licenses.TEMPLATES:
            want = {g for g in licenses.grams(licenses.words_of(template), 2) if " " in g}
            share = len(want & pairs) / len(want)
            if family == model["families"][k] and share >= (1 if len(want) <= licenses.SHORT else licenses.CONFIRM):
                best = max(best or (0, 0, ""), (share, round(float(p[k]), 6), family))
    return (best[2], best[0], best[1], len(lines)) if best else ("unknown" if licensed else "none", 0.0, 0.0, len(lines))


HELD_OUT = [  # phrasings that are no template
    ("mit", "This library is distributed under the terms of the MIT License, see the file LICENSE"), ("apache-2.0", "The code is licensed under the Apache License, Version 2.0 (the License)"),
    ("gpl-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("cc-by-sa", "Text of this page: licensed under a Creative Commons Attribution-ShareAlike 4.0 International License unless noted"), ("mit", "# SPDX-License-Identifier: MIT"),
    ("apache-2.0", "// SPDX-License-Identifier: Apache-2.0"), ("gpl-2.0", "/* SPDX-License-Identifier: GPL-2.0-only */"), ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("unknown", "Permission is granted to anyone to use this software for any purpose and to redistribute it freely, subject to the following restrictions"), ("unknown", "Released under the Zorp Permissive Licence, see COPYING"),
    ("none", "He renewed his driving license last week."), ("none", "Her hunting licence ran out in the spring and she never asked for another"), ("none", "The factory was licensed to build trucks for the army"),
    ("unknown", "Licensed under the Frobnicate Source License"), ("unknown", "SPDX-License-Identifier: LicenseRef-Acme"), ("none", "The committee met again on Friday and nobody was late"),
]


def test_licences_equal_plain_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = [(9000 + k, t) for k, (_, t) in enumerate(HELD_OUT)] + [(9500, None), (9501, ""), (9502, ("word " * 9 + "\n") * 8000 + "Licensed under the MIT License"), (9000, "twice")]
    rows = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("clash", F.lit(1))
    model = licenses.fit(rows)
    got = licenses.scan(rows.withColumn("score", F.lit("x")), model).collect()
    for r in got:
        family, overlap, score, lines = plain_license(r["text"], model)
        assert (r["license"], r["n_paragraphs"]) == (family, lines), r["text"][:200]
        assert abs(r["overlap"] - overlap) < 1e-9 and abs(r["score"] - score) < 1e-4
    found = {r["doc_id"]: r["license"] for r in got if r["text"] != "twice"}
    wrong = {t: found[9000 + k] for k, (f, t) in enumerate(HELD_OUT) if found[9000 + k] != f}
    assert wrong == {} and found[9502] == "mit"
