import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofmill.llm import chat, licenses, mixing, urlrules
from proofmill.llm.queries import ORACLE, QUERIES
from tests.oracle_check import same


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_duckdb(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), ORACLE[name], sf_dir)


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "MapInArrow" not in plan


CHAT = "conv_id long, turn long, role string, text string, formatted string"


def test_chat_round_trip_of_hostile_texts(spark):
    random.seed(3)
    bits = ["\\", "### ", "###", "</turn>", "</turn>\n", "<\\/turn>", "##\\# ", "#", ": ", "\n", " ", "é😀", "User", "### Assistant: ", "x", "$1", "\\1"]
    rows = [(c, t, random.choice(["user", "assistant", "system", "odd: role", None, "USER", "### "]), random.choice([None, "", "".join(random.choices(bits, k=random.randint(1, 14)))]), "clash") for c in range(120) for t in range(4)]
    rows += [rows[0], (None, None, None, None, None)]
    done = chat.format_conversations(spark.createDataFrame(rows, CHAT))
    no_python(done)
    got = {r["conv_id"]: r for r in done.withColumn("back", chat.parse(F.col("formatted"))).collect()}
    want = {}
    for c, t, role, text, _ in rows:
        want.setdefault(c, []).append((t if t is not None else -1, role or "", text or ""))
    assert {c: [tuple(x) for x in r["back"]] for c, r in got.items()} == {c: [x[1:] for x in sorted(v)] for c, v in want.items()}
    for c, r in got.items():
        turns = r["formatted"].split(chat.END)[:-1]
        masked = [t[m["skip"] : m["skip"] + m["size"]] for t, m in zip(turns, r["loss_mask"], strict=True) if m["skip"] < len(t)]
        assert len(masked) == sum(x[1] == "assistant" and x[2] != "" for x in want[c])
        for piece in masked:
            assert "</turn>" not in piece
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], CHAT))).count() == 0


def test_chat_of_many_turns_is_linear(spark):
    import time

    took = []
    for turns in (8000, 32_000):
        rows = spark.range(turns).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("### é "), F.repeat(F.lit("word "), 20), F.col("id").cast("string")).alias("text"))
        began = time.time()
        r = chat.read_back(chat.format_conversations(rows)).first()
        took.append(time.time() - began)
        assert r["n_turns"] == turns and r["escaped"] and r["loss_chars"] == sum(len(f"### é {'word ' * 20}{k}") for k in range(1, turns, 2))
    assert took[1] < 8 * took[0] + 2


def test_chat_of_a_very_long_text(spark):
    text = "a long text </turn> " * 100_000
    rows = [(1, 0, "user", text), (1, 1, "assistant", text + "!"), (1, 1, "assistant", text + "!")]
    r = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert r["n_turns"] == 3 and r["loss_chars"] == 2 * (len(text) + 1)


def test_chat_escapes_only_on_conflict(spark):
    rows = [(1, 0, "user", "plain \\ text"), (2, 0, "user", "a</turn>\nb"), (3, 0, "user", "<\\/turn>")]
    got = {r["conv_id"]: r["escaped"] for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: False, 2: True, 3: True}


def test_mix_targets_caps_and_copies(spark):
    rows = [(k, "w " * (k % 50), s, "x") for k, s in enumerate(["a"] * 300 + ["b"] * 40 + [None] * 60 + ["empty"])]
    rows = [(i, None if s == "empty" else t, s, x) for i, t, s, x in rows] + [(None, "q r", "a", "x"), (5, rows[5][1], "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, seed string")
    report = mixing.mix_report(docs).cache()
    sizes = {r["source"]: r for r in docs.join(report.select("doc_id", "target", "source_size"), "doc_id").select("source", "target", "source_size").distinct().collect()}
    every = sum(r["source_size"] for r in sizes.values())
    assert abs(sum(r["target"] for r in sizes.values()) - 1.5 * every) < 1e-6 * every
    assert all(r["target"] <= 2 * r["source_size"] + 1e-9 for r in sizes.values())
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in report.collect())
    for r in docs.withColumnRenamed("seed", "s").join(report, "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("want")).collect():
        assert abs(r["t"] - r["want"]) <= 0.12 * r["want"] + 60
    copies = {(r["doc_id"], r["source"]): r["count"] for r in mixing.mix_documents(docs).groupBy("doc_id", "source").count().collect()}
    assert mixing.mix_documents(docs).columns == docs.columns
    by_row = report.groupBy("doc_id").agg(F.sum("copies").alias("c")).collect()
    assert {r["doc_id"]: r["c"] for r in by_row if r["c"]} == {d: sum(v for (x, _), v in copies.items() if x == d) for d, _ in copies}
    assert sorted(map(tuple, mixing.mix_report(docs).fillna(-1).collect())) == sorted(map(tuple, report.fillna(-1).collect()))
    assert mixing.mix_report(docs.where("false")).count() == 0 and mixing.mix_documents(docs.where("false")).count() == 0


def test_mix_of_very_long_documents(spark):
    rows = [(k, "w " * (3000 if k < 9 else 40_000 if k == 9 else 5), "a") for k in range(2000)] + [(k, "w " * (200 + k % 7), "b") for k in range(2000, 2400)] + [(k, "w " * 4, None) for k in range(2400, 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    for seed in range(2):
        report = {r["doc_id"]: r for r in mixing.mix_report(docs, seed=seed).collect()}
        for own, most in (("a", 40_000), ("b", 206), (None, 1200)):
            mine = [report[i] for i, _, s in rows if s == own]
            assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= most + 0.02 * mine[0]["target"]


def test_mix_draws_with_the_fractions_probability(spark):
    """Over SEEDS seeds every document's copies and all pairs' agreement are within 4 sigma."""
    seeds, many = 200, 300
    rows = [(k, "w " * (k % 3 + 1), "a" if k < 3 * many else "b" if k < 4 * many else "c") for k in range(5 * many)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert all(3 * mixing.LONG < r["source_size"] for r in mixing.mix_report(docs).collect())
    report = {r["doc_id"]: r for r in mixing.mix_report(docs).collect()}
    keyed = docs.select("doc_id", "source")
    draws = keyed.select("doc_id", *[mixing.draw(seed, F.col("source"), F.col("doc_id")).alias(f"s{seed}") for seed in range(seeds)]).collect()
    drawn = {r["doc_id"]: list(r)[1:] for r in draws}
    for group in (range(3 * many), range(3 * many, 4 * many)):
        rate = report[group[0]]["target"] / report[group[0]]["source_size"]
        fraction = rate - int(rate)
        assert 0.3 < fraction < 0.5
        assert all(report[i]["copies"] == int(rate) + (drawn[i][mixing.SEED] < fraction) for i in group)
        taken = np.array([[u < fraction for u in drawn[i]] for i in group])
        sigma = np.sqrt(fraction * (1 - fraction))
        assert abs(taken.mean() - fraction) <= 4 * sigma / np.sqrt(taken.size)
        assert np.abs(taken.mean(1) - fraction).max() <= 4 * sigma / np.sqrt(seeds)
        z = (taken - fraction) / sigma if sigma else taken * 0.0
        near = (z[:-1] * z[1:]).mean(1)  # neighbours by id
        assert np.abs(near).max() <= 4.5 / np.sqrt(seeds) and abs(near.mean()) <= 4 / np.sqrt(near.size * seeds)


def test_mix_draws_do_not_depend_on_other_documents(spark):
    rows = [(k, "w " * (k % 3 + 1), "a") for k in range(300)] + [(k, "w " * 3, "b") for k in range(300, 700)]
    more = [*rows, (9000, "w", "c")]
    seen = []
    for r in (rows, rows[1:], more):
        found = mixing.mix_report(spark.createDataFrame(r, "doc_id long, text string, source string")).collect()
        seen.append({x["doc_id"]: (x["copies"], x["target"] / x["source_size"]) for x in found})
    draws = {r["doc_id"]: r["u"] for r in spark.createDataFrame(rows, "doc_id long, text string, source string").select("doc_id", mixing.draw(mixing.SEED, F.col("source"), F.col("doc_id")).alias("u")).collect()}
    for found in seen:  # a document's copies follow from its own number and its source's rate alone
        assert all(copies == int(rate) + (draws[i] < rate - int(rate)) for i, (copies, rate) in found.items() if i != 9000)
    moved = [i for i in seen[1] if seen[0][i][0] != seen[1][i][0]]
    assert all(min(a, b) <= draws[i] <= max(a, b) for i in moved for a, b in [(seen[0][i][1] % 1, seen[1][i][1] % 1)])


def plain_judge(url, rules):
    import re

    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
    best = None
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        fits = (not h or host == h or host.endswith("." + h)) and re.match("".join(".*" if c == "*" else re.escape(c) for c in slash + p), path, re.S)
        if fits and (not h or m) and (best is None or (len(rule), rule) > (len(best[0]), best[0])):
            best = (rule, verdict)
    return host, path, best and best[0], best[1] if best else "allow"


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("a.b/x/*/z", "block"), ("/ads/", "block")]
URLS = [None, "", "nothing", "http://NET/", "http://x.net", "https://sub.example.net/en/p?q=/de/", "ftp://example.net/en", "http://badexample.net/en/", "http://a.b/x/1/2/z9", "http://any.host/ads/1", "http://EXAMPLE.com/de/#f", "x://y://z.org/fr/", "http://é.org/fr/\n", "://net/"]


@pytest.mark.parametrize("inline", [64, 0])
def test_url_rules_both_ways(spark, monkeypatch, inline):
    monkeypatch.setattr(urlrules, "INLINE_RULES", inline)
    pages = spark.createDataFrame([(k, u, "old", "t") for k, u in enumerate([*URLS, *URLS])], "page_id long, url string, rule string, token string")
    rules = spark.createDataFrame([*RULES, (None, "block")], "rule string, verdict string")
    done = urlrules.judge_urls(pages, rules)
    no_python(done)
    for r in done.collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_judge(r["url"], RULES), r
    assert urlrules.judge_urls(pages.where("false"), RULES).count() == 0


def test_url_index_uses_rarest_token():
    filed = {r["rule"]: r["token"] for r in urlrules.rule_rows(RULES)}
    assert filed["example.net/en/"] == "p:en" and filed["net/"] == "h:net" and filed["/ads/"] == "p:ads"


def test_licenses(spark):
    templates = [(100 + k, f"first line\nblah {t} .\nlast", "clash") for k, (f, t) in enumerate(licenses.TEMPLATES)]
    plain = [(k, t, "clash") for k, t in enumerate([None, "", "He lost his driving license", "the quick brown fox " * 3000, "Licensed under the terms of our own agreement", "free as in the public park"])]
    docs = spark.createDataFrame(plain + templates + templates[:1], "doc_id long, text string, score string")
    report = licenses.license_report(docs)
    no_python(report)
    got = {r["doc_id"]: r["license"] for r in report.collect()}
    assert [got[k] for k in range(6)] == ["none", "none", "none", "none", "unknown", "none"]
    right = sum(got[100 + k] == f for k, (f, _) in enumerate(licenses.TEMPLATES))
    assert right >= len(licenses.TEMPLATES) - 3
    assert report.count() == len(plain) + len(templates) + 1
    assert licenses.license_report(docs.where("false")).count() == 0


def test_license_lines_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    says = F.when(F.contains("text", F.lit("Apache License, Version 2.0")), "apache-2.0").when(F.contains("text", F.lit("CC BY-NC 4.0")), "cc-by-nc").when(F.contains("text", F.lit("MIT License")), "mit").when(F.contains("text", F.lit("GNU General Public License, version 3")), "gpl-3.0").otherwise("none")
    rows = licenses.license_report(docs).join(docs.select("doc_id", says.alias("says")), "doc_id")
    assert rows.where("license != says").count() == 0
