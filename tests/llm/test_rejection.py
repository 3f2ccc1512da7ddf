"""Texts in none of the languages are rejected, the table's and mixed ones are kept."""

import base64

import numpy as np

from proofmill.llm import langid


def planted(rng):
    for low, high in ((0x61, 0x7A), (0x430, 0x44F), (0x4E00, 0x9FA5), (0x3B1, 0x3C9)):
        for _ in range(25):
            yield " ".join("".join(chr(c) for c in rng.integers(low, high + 1, int(rng.integers(2, 11)))) for _ in range(int(rng.integers(10, 200))))
    for _ in range(25):
        yield base64.b64encode(rng.bytes(int(rng.integers(90, 2000)))).decode()


def test_planted_garbage_is_rejected(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    first = {r["lang"]: r["text"][:400] for r in rows.where("length(text) > 400").orderBy("doc_id").collect()}
    mixed = [(2_000_000 + k, first[a] + " " + first[b], None) for k, (a, b) in enumerate((a, b) for a in sorted(first) for b in sorted(first) if a < b)]
    junk = [(1_000_000 + k, t, None) for k, t in enumerate(planted(np.random.default_rng(17)))]
    both = rows.unionByName(spark.createDataFrame(junk + mixed, "doc_id long, text string, lang string"))
    found = {r["doc_id"]: r["accepted"] for r in langid.identify(both).collect()}
    assert not any(found[i] for i, _, _ in junk)
    assert all(found[i] for i, _, _ in mixed)
    clean = [ok for i, ok in found.items() if i < 1_000_000]
    assert clean.count(False) <= 0.002 * len(clean)
    kept = {r["doc_id"] for r in langid.keep_identified(both).select("doc_id").collect()}
    assert kept == {i for i, ok in found.items() if ok}


#: Hand-written, not of the forms that the class of no language learns from.
WRITTEN = [
    "@dataclass\nclass Point:\n    x: float\n    y: float = 0.0\n\n    def norm(self) -> float:\n        return (self.x ** 2 + self.y ** 2) ** 0.5\n\nprint(Point(3, 4).norm())",
    "for (let i = 0; i < rows.length; i++) {\n  const cell = rows[i].cells[2];\n  if (cell.innerText === '') cell.classList.add('empty');\n}\nmodule.exports = { render };",
    "public class Main {\n  public static void main(String[] args) throws IOException {\n    BufferedReader br = new BufferedReader(new InputStreamReader(System.in));\n    int n = Integer.parseInt(br.readLine());\n    System.out.println(n * 2);\n  }\n}",
    '<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>x</title><link href="main.css" rel="stylesheet"></head>\n<body><div id="root" class="container-fluid"></div><script src="bundle.js"></script></body></html>',
    '10.1.2.3 - frank [10/Oct/2023:13:55:36 -0700] "GET /static/img/logo.png HTTP/1.1" 304 0 "-" "curl/7.64.1"\n10.1.2.4 - - [10/Oct/2023:13:55:37 -0700] "POST /api/v2/login HTTP/1.1" 401 17 "-" "okhttp/4.9"',
    "int main(void) {\n    char *p = malloc(64 * sizeof(*p));\n    if (!p) { fprintf(stderr, \"oom\\n\"); exit(1); }\n    memset(p, 0, 64);\n    free(p);\n    return 0;\n}",
    "SELECT c.id, COUNT(o.id) AS n FROM customer c LEFT JOIN orders o ON o.cust_id = c.id GROUP BY c.id HAVING COUNT(o.id) > 3 ORDER BY n DESC LIMIT 10;",
]


def test_code_markup_logs_and_an_unseen_language_are_rejected(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null and lang is not null").select("doc_id", "lang", "text").orderBy("doc_id").collect()
    samples = [(r["doc_id"], r["lang"], r["text"].encode()) for r in rows if len(r["text"]) < langid.SAMPLE_TEXT]
    known = langid.Predictor(langid.train([s for s in samples if s[1] != "de"]))
    assert not any(ok for _, _, ok in known.batch([t.encode() for t in WRITTEN]))
    unseen = known.batch([t for _, lang, t in samples if lang == "de" and len(t) > 300])
    assert len(unseen) > 50 and sum(not ok for _, _, ok in unseen) >= 0.9 * len(unseen)
    kept = known.batch([t for _, lang, t in samples if lang != "de"])
    assert sum(not ok for _, _, ok in kept) <= 0.002 * len(kept)
