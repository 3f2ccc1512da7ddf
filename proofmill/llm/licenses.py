"""License scans [native]: a trained paragraph classifier, confirmed by templates.

Paragraphs are a text's lines and, as notices are wrapped, windows of two strides of words across
the lines, one at each stride; a stride holds the longest template and a quarter more, so a wrapped
notice lies whole inside a window. Words are ASCII letter and digit runs of the lower-cased text,
so comment marks in front of lines do not part them. A multinomial logistic regression over word 1- to 3-grams is trained on the driver on the
templates below (whole, cut, with words lost, amid corpus words), on grants of other licences (OTHERS,
and FORMS under made-up names) as the class `unknown`, and, as the class `none`, on paragraphs of a bounded
hash-chosen sample of the corpus (SAMPLE_DOCS documents, for fitting only) and look-alike
sentences. Its features are n-grams of templates and grants that are rare in the sample. A
temperature calibrates the probabilities; a known family must reach a score, and all licences
together (what is not `none`) another, that at most UNKNOWN_RATE of the held-back negatives reach.

Scoring is built-in functions only and row by row, without a shuffle. A family is confirmed
when a template of it has at least CONFIRM of its word pairs in the paragraph; the gate words
are chosen so that every such paragraph holds one, so one regular expression over the whole
text finds the texts and paragraphs to score, and loses none.

Result for each row: license (the family of the confirmed paragraph with the highest overlap,
then score: a line of a wrapped notice can confirm a sibling family, its window does so better;
a template of at most SHORT pairs, as that of an SPDX line is, must be there whole;
`unknown` if none is confirmed and some paragraph's probability of being a licence of any kind reaches
its bound; else `none`),
template, score, overlap, n_paragraphs (lines that hold a gate word). Defined cases: null or
empty text is `none`; a very long text is scanned whole; ties go to the greater overlap, score and
then template text; repeated rows stay; extra columns are kept, those named like a result column are
replaced; an empty table gives no rows and trains on the look-alikes alone.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS, SAMPLE_TEXT, NEGATIVES = 400, 1 << 15, 3000
COMMON, UNKNOWN_RATE, CONFIRM, STEPS, SEED = 0.002, 0.001, 0.6, 250, 11

#: Notices by which licences are granted, by family.
TEMPLATES = [
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License version 3"),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Released under the BSD 3-Clause License"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 2.1"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "under the terms of the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl-2.0", "Licensed under the Mozilla Public License, version 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("epl-2.0", "Licensed under the Eclipse Public License, version 2.0"),
]
#: SPDX identifiers, by family; a line that names one is a notice of its own.
SPDX = [
    ("agpl-3.0", "AGPL-3.0-only"), ("agpl-3.0", "AGPL-3.0-or-later"), ("apache-2.0", "Apache-2.0"), ("bsd", "BSD-2-Clause"), ("bsd", "BSD-3-Clause"),
    ("cc-by", "CC-BY-4.0"), ("cc-by-nc", "CC-BY-NC-4.0"), ("cc-by-sa", "CC-BY-SA-4.0"), ("cc0", "CC0-1.0"), ("epl-2.0", "EPL-2.0"),
    ("gpl-2.0", "GPL-2.0-only"), ("gpl-2.0", "GPL-2.0-or-later"), ("gpl-3.0", "GPL-3.0-only"), ("gpl-3.0", "GPL-3.0-or-later"), ("isc", "ISC"),
    ("lgpl", "LGPL-2.1-only"), ("lgpl", "LGPL-2.1-or-later"), ("lgpl", "LGPL-3.0-or-later"), ("mit", "MIT"), ("mpl-2.0", "MPL-2.0"), ("unlicense", "Unlicense"),
]
TEMPLATES += [(family, f"SPDX-License-Identifier: {name}") for family, name in SPDX]
#: Templates of up to SHORT word pairs are confirmed by all of them only.
SHORT = 3
#: Sentences that name licence words and grant nothing known.
LOOK_ALIKES = [
    "He renewed his driving license last week", "The license plate was stolen", "All rights reserved", "Copyright 2020 by the authors",
    "The warranty of the car has expired", "She works for the public library", "Version 2 of the document was better", "The new version 3 is out",
    "Ask the general public for permission to use the road", "The Apache helicopter landed", "A creative person in the commons",
    "The software was sold under a secret agreement", "Students of MIT released a study", "This work is described below", "The foundation gave free copies to any person", "This file is large",
    "A fishing license is hereby granted to the owner", "The source of the river is subject to debate",
    "He lost his driving license", "The bar had a license to sell beer until midnight", "She applied for a business license in May", "The pilot showed his licence at the gate",
    "Their marriage licence was signed in the church", "The city will license street vendors again", "A license fee is due each year", "He was licensed to practise medicine in two states",
    "Students may use the library free of charge", "The terms of the peace were modified under pressure", "Any use of the old road is permitted until winter", "The band released its new record under another name",
    "Without permission nobody may copy the key of the house", "The bridge comes with no warranty said the builder", "The redistribution of land was governed by a new law", "You may not enter the work of others in the contest",
]
#: Grants of licences without a template here.
OTHERS = [
    "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "Distributed under the Boost Software License, Version 1.0", "This is free software; you can redistribute it under the terms of the Artistic License 2.0",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1", "This database is made available under the Open Database License",
    "Licensed under the terms of our own agreement", "Use of this software is governed by the license agreement that came with it", "Released under a custom license",
    "You may use, copy and modify this code under the terms of the license below", "All use is subject to the terms of the enclosed end user license agreement",
    "This material is licensed to you under the following terms and conditions", "See the file LICENSE for the terms under which this software may be used",
]
#: Grants under a made-up name N.
FORMS = [
    "Licensed under the N License", "Licensed under the N Source License, version 2", "Released under the N Public Licence", "SPDX-License-Identifier: LicenseRef-N", "This work is licensed under a N License",
    "This program is distributed under the terms of the N License", "Use of this source code is governed by the N license that can be found in the LICENSE file", "made available under the terms of the N Community License",
]
#: Words that name a licence; every paragraph with one is scored.
NAMES = ("licence", "licenced", "license", "licensed")
#: A word of grants that name none.
GRANTS = ("redistribute",)
_WORD = r"[a-z0-9]+"


def words_of(text: str) -> list[str]:
    return re.findall(_WORD, text.lower(), flags=re.ASCII)


STRIDE = max(len(words_of(t)) for _, t in TEMPLATES) * 5 // 4 + 1


def windows(words: list) -> list[list]:
    return [words[k : k + 2 * STRIDE] for k in range(0, max(1, len(words) - STRIDE), STRIDE)]


def grams(words: list[str], most: int = 3) -> set[str]:
    return {" ".join(words[k : k + n]) for n in range(1, most + 1) for k in range(len(words) - n + 1)}


_TELLING = {*NAMES, "granted", "redistribute", "gnu", "copyright", "permission", "redistribution"}
_SHOWN = [grams(words_of(t), 2) for t in [*(t for _, t in TEMPLATES), *OTHERS]]


def shows(words: list[str]) -> bool:
    """Whether words hold a template's or a grant's grams, so that they are no example of licence-free text."""
    return bool(_TELLING & set(words)) and any(len(t & own) >= CONFIRM * len(t) for own in [grams(words, 2)] for t in _SHOWN)


def licence_free(text: str) -> set[str]:
    """A text's lines and windows without those that a window with a template touches: the
    lines of a wrapped notice are parts of it, not examples of other text."""
    lines = text.split("\n")
    worded = [(w, k) for k, line in enumerate(lines) for w in words_of(line)]
    cut = [({k for _, k in part}, [w for w, _ in part]) for part in windows(worded)]
    noticed = set().union(*(at for at, words in cut if shows(words)))
    out = {line for k, line in enumerate(lines) if line.strip() and k not in noticed}
    return out | {" ".join(words) for at, words in cut if len(at) > 1 and not at & noticed}


def train(paragraphs: list[str]) -> dict:
    """The classifier; `paragraphs` are corpus paragraphs, taken as licence-free unless a template's pairs show."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    families = sorted({f for f, _ in TEMPLATES}) + ["unknown", "none"]
    none = len(families) - 1
    pairs = [(f, words_of(t)) for f, t in TEMPLATES]
    sample = [w for w in (words_of(p) for p in paragraphs) if w and not shows(w)]
    filler = [w for words in sample for w in words] or ["the", "a", "of", "and"]
    some = lambda most: [filler[int(i)] for i in rng.integers(0, len(filler), int(rng.integers(0, most)))]
    examples: list[tuple[set[str], int]] = [(grams(w), none) for w in sample]
    examples += [(grams(some(12) * (k > 0) + words_of(t) + some(12) * (k > 0)), none) for t in LOOK_ALIKES for k in range(5)]
    examples += [(grams(some(12)), none) for _ in range(40)]  # also where the corpus has few paragraphs
    stray = [w for _, words in pairs for w in words] + [w for t in OTHERS for w in words_of(t)]
    for k in range(2 * len(stray)):  # a word or two of a notice are no notice
        examples.append((grams([*some(12), stray[k % len(stray)], *some(6), *([stray[int(rng.integers(0, len(stray)))]] if k % 2 else []), *some(12)]), none))
    names = lambda t: words_of(re.sub(r"\bN\b", lambda _: " ".join(some(3)) or "acme", t))
    grants = [(f, words) for f, words in pairs for _ in range(24)]
    grants += [("unknown", words_of(t)) for t in OTHERS for _ in range(24)] + [("unknown", names(t)) for t in FORMS for _ in range(24)]
    for k, (family, words) in enumerate(grants):
        kept = [w for w in words if k % 24 < 4 or rng.random() > 0.08]
        examples.append((grams(kept if k % 24 < 2 else some(12) + kept + some(12)), families.index(family)))
    seen: dict[str, int] = {}
    for own, _ in examples[: len(sample)]:
        for g in own:
            seen[g] = seen.get(g, 0) + 1
    shown = [w for _, w in pairs] + [words_of(t) for t in OTHERS] + [words_of(re.sub(r"\bN\b", "", t)) for t in FORMS] + [words_of(t) for t in LOOK_ALIKES]
    features = sorted(g for g in set().union(*(grams(w) for w in shown)) if seen.get(g, 0) <= max(3, COMMON * len(sample)))
    at = {g: k for k, g in enumerate(features)}
    x = np.zeros((len(examples), len(features)), np.float32)
    for i, (own, _) in enumerate(examples):
        x[i, [at[g] for g in own if g in at]] = 1
    x /= np.sqrt(np.maximum(1, x.sum(1, keepdims=True)))
    y = np.array([c for _, c in examples])
    held = rng.random(len(y)) < 0.25
    weights, bias = np.zeros((len(features), len(families)), np.float32), np.zeros(len(families), np.float32)
    counts = np.bincount(y, minlength=len(families))
    share = (1 / counts[y]).astype(np.float32)
    share[y == none] *= none  # as much as all licences together
    share[held] = 0
    share /= share.sum()

    def soft(z):
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    for _ in range(STEPS):
        p = soft(x @ weights + bias)
        p[np.arange(len(y)), y] -= 1
        p *= share[:, None]
        weights -= 40 * (x.T @ p) + 2e-4 * weights
        bias -= 10 * p.sum(0)
    weights[np.abs(weights) < 0.02] = 0
    z = x @ weights + bias
    grid = np.geomspace(0.3, 4, 25)
    loss = [-np.log(soft(z[held] / t)[np.arange(held.sum()), y[held]] + 1e-9).mean() for t in grid] if held.any() else [0]
    temperature = float(grid[int(np.argmin(loss))])
    p = soft(z / temperature)
    known, licensed = p[:, :-2].max(1), 1 - p[:, -1]
    bound = lambda v: float(min(0.9, max(0.5, np.sort(v[y == none])[int((1 - UNKNOWN_RATE) * ((y == none).sum() - 1))])))
    single: dict[str, int] = {}
    for words in sample:
        for w in set(words):
            single[w] = single.get(w, 0) + 1
    kept = [k for k in range(len(features)) if weights[k].any()]
    gate = gate_words(pairs, single, COMMON * max(1, len(sample)))
    table = {features[k]: [round(float(v), 4) for v in weights[k]] for k in kept}
    return {"families": families, "weights": table, "bias": [float(b) for b in bias], "temperature": temperature, "reject": bound(known), "licensed": bound(licensed), "gate": gate}


def gate_words(pairs: list[tuple[str, list[str]]], counts: dict[str, int], common: float) -> list[str]:
    """Words of which every paragraph with CONFIRM of some template's word pairs holds at least one.

    Chosen greedily, corpus-rare words first, until so few pairs of each template are without
    a chosen word that they alone cannot confirm it.
    """
    chosen = {*NAMES, *GRANTS}
    open_ = [{g for g in grams(w, 2) if " " in g} for _, w in pairs]
    need = [CONFIRM * len(p) for p in open_]
    while True:
        open_ = [{g for g in p if not chosen & set(g.split())} for p in open_]
        short = [p for p, n in zip(open_, need, strict=True) if len(p) >= n]
        if not short:
            return sorted(chosen)
        gain: dict[str, int] = {}
        for p in short:
            for g in p:
                for w in set(g.split()):
                    gain[w] = gain.get(w, 0) + 1
        chosen.add(min(gain, key=lambda w: (counts.get(w, 0) > common, -gain[w], w)))


def fit(docs: DataFrame) -> dict:
    """Train against a bounded sample of the corpus."""
    rows = docs.where("text is not null and doc_id is not null").where(F.octet_length("text") <= SAMPLE_TEXT)
    count = rows.count()
    share = min(1.0, SAMPLE_DOCS / max(1, count))
    picked = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text").collect()
    lines = sorted({p for r in picked for p in licence_free(r["text"])})
    if len(lines) > NEGATIVES:
        import numpy as np

        lines = [lines[k] for k in np.random.default_rng(SEED).permutation(len(lines))[:NEGATIVES]]
    return train(lines)


def _grams(words: Column, n: int) -> Column:
    size = F.size(words) - (n - 1)
    made = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    return F.when(size >= 1, made).otherwise(F.array().cast("array<string>"))


def _known_score(docs: DataFrame, model: dict) -> DataFrame:
    """Adds _scored, for each paragraph in _words a struct(score, family, licensed): the calibrated
    probability of the best known family, and that of any licence. One column a step, so no step is
    computed twice."""
    families, known = model["families"], len(model["families"]) - 2
    table = F.from_json(F.lit(json.dumps(model["weights"])), "map<string,array<double>>")
    keys = F.from_json(F.lit(json.dumps(sorted(model["weights"]))), "array<string>")
    names, bias = F.array(*[F.lit(f) for f in families]), F.array(*[F.lit(b) for b in model["bias"]])
    zero = F.array(*[F.lit(0.0)] * len(families))
    add = lambda acc, g: F.zip_with(acc, F.try_element_at(table, g), lambda a, b: a + b)
    hits = F.transform("_words", lambda w: F.array_intersect(F.concat(_grams(w, 1), _grams(w, 2), _grams(w, 3)), keys))
    sums = F.transform("_hits", lambda h: F.struct(F.sqrt(F.greatest(F.size(h), F.lit(1)).cast("double")).alias("scale"), F.aggregate(h, zero, add).alias("t")))
    logits = F.transform("_sums", lambda s: F.zip_with(s["t"], bias, lambda t, b: (t / s["scale"] + b) / model["temperature"]))
    tops = F.transform("_z", lambda z: F.struct(z.alias("z"), F.array_max(z).alias("top")))
    powers = F.transform("_tops", lambda p: F.transform(p["z"], lambda v: F.exp(v - p["top"])))
    best = F.transform(
        "_powers",
        lambda e: F.struct(
            F.aggregate(e, F.lit(0.0), lambda a, b: a + b).alias("all"), F.element_at(e, -1).alias("none"),
            F.array_max(F.transform(F.slice(e, 1, known), lambda v, i: F.struct(v.alias("v"), (-i).alias("order")))).alias("top"),
        ),
    )
    score = F.transform("_best", lambda b: F.struct((b["top"]["v"] / b["all"]).alias("score"), F.element_at(names, (F.lit(1) - b["top"]["order"]).cast("int")).alias("family"), (F.lit(1.0) - b["none"] / b["all"]).alias("licensed")))
    out = docs
    for name, column in (("_hits", hits), ("_sums", sums), ("_z", logits), ("_tops", tops), ("_powers", powers), ("_best", best), ("_scored", score)):
        out = out.withColumn(name, column)
    return out.drop("_hits", "_sums", "_z", "_tops", "_powers", "_best")


def _confirm(words: Column, family: Column) -> Column:
    """struct(overlap, template): the family's template with the largest share of its pairs in the paragraph."""
    rows = [{"family": f, "template": t, "pairs": sorted(g for g in grams(words_of(t), 2) if " " in g)} for f, t in TEMPLATES]
    rows = [r | {"least": 1.0 if len(r["pairs"]) <= SHORT else CONFIRM} for r in rows]
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<family:string,template:string,least:double,pairs:array<string>>>")
    own = _grams(words, 2)
    mine = F.filter(table, lambda r: r["family"] == family)
    share = lambda r: F.size(F.array_intersect(r["pairs"], own)) / F.size(r["pairs"])
    found = F.transform(mine, lambda r: F.struct(share(r).alias("overlap"), r["template"].alias("template"), r["least"].alias("least")))
    return F.array_max(F.filter(found, lambda c: c["overlap"] >= c["least"]))


def scan(docs: DataFrame, model: dict) -> DataFrame:
    """docs with license, template, score, overlap and n_paragraphs; native, row by row."""
    gate = "(?<![a-z0-9])(?:" + "|".join(model["gate"]) + ")(?![a-z0-9])"
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    lines = F.filter(F.split(text, "\n"), lambda p: F.rlike(p, F.lit(gate)))
    gated = F.when(F.rlike(text, F.lit(gate)), lines).otherwise(F.array().cast("array<string>"))
    worded = F.transform(F.col("_gated"), lambda p: F.regexp_extract_all(p, F.lit(f"({_WORD})"), F.lit(1)))
    wrapped = (F.size("_gated") > 0) & F.contains(F.col("text"), F.lit("\n"))
    stream = F.when(wrapped, F.regexp_extract_all(text, F.lit(f"({_WORD})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("_stream") - STRIDE - 1), F.lit(STRIDE))
    cut = F.transform(starts, lambda k: F.slice("_stream", k + 1, F.lit(2 * STRIDE)))
    joined = F.filter(cut, lambda w: F.arrays_overlap(w, F.array(*[F.lit(g) for g in model["gate"]])))
    units = docs.withColumn("_gated", gated).withColumn("_lines", worded).withColumn("_stream", stream).withColumn("_joined", joined)
    staged = _known_score(units.withColumn("_words", F.concat("_lines", "_joined")).drop("_lines", "_stream", "_joined"), model)
    sure = F.filter(F.arrays_zip("_words", "_scored"), lambda p: p["_scored"]["score"] >= model["reject"])
    compared = F.transform("_sure", lambda p: F.struct(_confirm(p["_words"], p["_scored"]["family"]).alias("c"), p["_scored"]["score"].alias("score"), p["_scored"]["family"].alias("family")))
    ranked = F.transform("_confirmed", lambda p: F.struct(p["c"]["overlap"].alias("overlap"), p["score"].alias("score"), p["c"].alias("c"), p["family"].alias("family")))
    best = F.array_max(F.filter(ranked, lambda p: p["overlap"].isNotNull()))
    staged = staged.withColumn("_sure", sure).withColumn("_confirmed", compared).withColumn("_best", best)
    licensed = F.exists("_scored", lambda p: p["licensed"] >= model["licensed"])
    return staged.withColumns(
        {
            "license": F.when(F.col("_best").isNotNull(), F.col("_best.family")).when(licensed, F.lit("unknown")).otherwise(F.lit("none")),
            "template": F.col("_best.c.template"),
            "score": F.coalesce(F.col("_best.score"), F.lit(0.0)),
            "overlap": F.coalesce(F.col("_best.c.overlap"), F.lit(0.0)),
            "n_paragraphs": F.size("_gated").cast("long"),
        }
    ).drop("_gated", "_words", "_scored", "_sure", "_confirmed", "_best")


def license_report(docs: DataFrame) -> DataFrame:
    """doc_id with the columns of scan()."""
    return scan(docs.select("doc_id", "text"), fit(docs)).drop("text")
