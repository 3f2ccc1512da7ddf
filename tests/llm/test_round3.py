"""Importance resampling, filter audit, line dedup: plain versions and defined cases."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from proofmill.llm import audit, linededup, queries, resample
from proofmill.llm.common import documents
from tests.oracle_check import same

LONG = "Grüße 你好 ab-cd " * 3000
DOCS = [
    (1, "a b c d e f g h i j k l m n o p q r s t u v", "en"), (2, "a b c d e f g h i j k l m n o p q r s t u v", None), (3, None, "de"), (4, "", "de"),
    (5, LONG, "en"), (5, LONG, "en"), (6, "one\nsame line that many documents hold\nsame line that many documents hold \n", "en"),
    (7, " SAME line that many documents hold\ntwo", "fr"), (8, "Same Line That Many Documents Hold", "fr"), (None, "same line that many documents hold\nx", "fr"),
    (9, "held by two documents only, yes\r\n$", "en"), (10, "held by two documents only, yes", "en"), (11, "x " * 300, "en"), (12, "x " * 300, "de"), (12, "x " * 300, "fr"),
    (None, "x " * 300, "fr"), (13, "\n\n", ""), (14, "ÄÖÜ$ SHOUT", None), (15, "word" * 10_000 + "\n" + "short", "en"),
]
CLASH = "key string, copies long, rank long, _keys string, batch int, h1 long, mark string, mask int, part string, places int, n long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, lang string").repartition(3)


def with_clash(docs):
    return docs.select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in CLASH.split(", ")])


def plain_resample(docs, target, percent=25):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    grams = lambda w: [bucket(x) for x in w] + [bucket(f"{a} {b}") for a, b in zip(w, w[1:], strict=False)]
    own = [(i, words(t)) for i, t in docs]
    s, t = Counter(b for _, w in own for b in grams(w)), Counter(b for x in target for b in grams(words(x)))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000))))
    out = []
    for i, w in own:
        g = grams(w)
        weight = sum(map(gain, g)) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    for k, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = k
    return sorted(tuple(r[:5]) for r in out if r[0] is not None) + sorted(tuple(r[:5]) for r in out if r[0] is None)


def collected(df):
    got = [tuple(r) for r in df.collect()]
    return sorted(r for r in got if r[0] is not None) + sorted(r for r in got if r[0] is None)


def ordered(rows):
    return sorted(rows, key=str)


def test_resample_equals_the_plain_version(spark, sf_dir):
    got = collected(queries.op11_resample(spark, sf_dir))
    whole = [(r["doc_id"], r["text"]) for r in documents(spark, sf_dir).collect()]
    want = plain_resample(whole, [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    assert got == want and sum(r[4] is not None for r in got) > 10


def test_resample_cases(spark, docs):
    target = spark.createDataFrame([("x ab cd",), (None,), ("X!",)], "text string")
    for percent in (25, 100):
        got = resample.importance_report(with_clash(docs), target, percent=percent).collect()
        assert ordered(map(tuple, got)) == ordered(plain_resample([r[:2] for r in DOCS], ["x ab cd", None, "X!"], percent))
    none = resample.importance_report(docs, target.where("false"))
    assert ordered(map(tuple, none.collect())) == ordered(plain_resample([r[:2] for r in DOCS], []))
    assert resample.importance_report(docs.where("false"), target).collect() == []
    drawn = resample.importance_sample(with_clash(docs), target, percent=50)
    best = {r[0] for r in plain_resample([r[:2] for r in DOCS], ["x ab cd", "X!"], 50) if r[4]}
    assert drawn.columns == with_clash(docs).columns and {r["doc_id"] for r in drawn.collect()} == best


def plain_audit(docs, labels, part=1):
    masks = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text))]
        fails.append(i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs))
        masks.append((i, lang or "", fails))
    good, bad = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    out = []
    for lang in sorted({p for _, p, _ in masks}):
        mine = [(i, f) for i, p, f in masks if p == lang]
        rows, shapley = [], Counter()
        for order in permutations(range(5)):
            left = mine
            for k, f in enumerate(order):
                gone = [(i, x) for i, x in left if x[f]]
                rest = [(i, x) for i, x in left if not x[f]]
                shapley[f] += len(gone)
                earlier = sum(x[f] for _, x in mine) - len(gone)
                alone = sum(x[f] and sum(x) == 1 for _, x in mine)
                rows.append((lang, "".join("ABCDE"[o] for o in order), k + 1, len(rest), len(gone), earlier, alone, sum(i in good for i, _ in gone), sum(i in bad for i, _ in gone), f))
                left = rest
        out += [(*r[:9], shapley[r[9]]) for r in rows]
    return sorted(out)


LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (5, None, 1), (12, 1, None), (99, 1, 1), (None, 1, 1)]


@pytest.mark.parametrize("chain_bytes", [1, audit.CHAIN_BYTES])
def test_audit_equals_the_plain_version(spark, docs, monkeypatch, chain_bytes):
    monkeypatch.setattr(audit, "CHAIN_BYTES", chain_bytes)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = audit.filter_audit(with_clash(docs), labels.withColumn("mask", F.lit(1)).withColumn("_id", F.lit(1)))
    assert sorted(map(tuple, got.collect())) == plain_audit(DOCS, LABELS)
    assert audit.filter_audit(docs.where("false"), labels).collect() == []
    assert sorted(r[0] for r in audit.copies(docs).collect()) == [2, 4, 12, 12]


def test_audit_equals_its_sql(spark, sf_dir):
    same(queries.op12_audit(spark, sf_dir), queries.ORACLE["op12_audit"], sf_dir)


def test_texts_of_one_fingerprint_are_told_apart():
    chains = audit.Chains()
    assert chains.add(1, b"x", 5, 0, {"en": 1}) == [] and chains.add(1, b"y", 4, 0, {"en": 1}) == []
    assert chains.add(1, b"x", 3, 8, {"de": 2}) == [(5, "en", 24, 1)]
    assert chains.add(1, b"x", 3, 8, {"de": 1, "fr": 1}) == []
    assert [link for _, link in chains.drain()] == [[b"x", 3, 0, {"de": 3, "fr": 1}], [b"y", 4, 0, {"en": 1}]]


def plain_lines(docs):
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    held = {}
    for i, t in {d[:2] for d in docs}:
        for k in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(k, []).append((i is not None, i or 0))
    out = []
    for i, t, *_ in docs:
        lines = (t or "").split("\n")
        gone = [len(k) >= 20 and len(held[k]) >= 3 and max(held[k]) != (i is not None, i or 0) for k in map(key, lines)]
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((i, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def test_lines_equal_sql(spark, sf_dir):
    same(queries.op13_lines(spark, sf_dir), queries.ORACLE["op13_lines"], sf_dir)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (5, 2), (4, 3)])
def test_lines_equal_the_plain_version(spark, docs, batches, fanout):
    got = linededup.line_report(with_clash(docs), batches=batches, fanout=fanout)
    want = plain_lines(DOCS)
    assert ordered(map(tuple, got.collect())) == ordered(r[:4] for r in want) and sum(r[2] for r in want) >= 3
    if batches == 4:
        kept = linededup.drop_lines(with_clash(docs))
        assert kept.columns == with_clash(docs).columns
        assert ordered((r["doc_id"], r["text"] or "") for r in kept.collect()) == ordered((r[0], r[4]) for r in want)
        assert linededup.line_report(docs.where("false")).collect() == []


def test_runs_take_batches_in_any_order_and_grow_by_what_is_new(spark, docs):
    lines = linededup.long_lines(docs).cache()
    want = {(r["h1"], r["h2"]): r["last"] for r in lines.groupBy("h1", "h2").agg(F.countDistinct(F.struct("doc_id", "mark")).alias("n"), F.max("doc_id").alias("last")).where("n >= 3").collect()}
    space = linededup.Workspace(spark, "runs")
    for ascending in (True, False):
        runs = linededup.LineRuns(spark, f"{space.path}/{ascending}", 2, fanout=2)
        for low in sorted((-1, 4, 8, 12), reverse=not ascending):
            runs.add(lines.where(F.coalesce("doc_id", F.lit(-1)).between(low + 1, low + 4) | (F.col("doc_id").isNull() & F.lit(low == -1))))
        assert [len(level) for level in runs.levels] == [0, 0, 1]
        assert {(r["h1"], r["h2"]): r["last"] for r in runs.common().collect()} == want
        before = len(runs.levels[0])
        runs.add(lines.where("doc_id = 6"))  # its common line is settled: 7 and 8 hold it too
        assert len(runs.levels[0]) == before + 1 and not spark.table(runs.levels[0][0]).join(runs.common(), ["h1", "h2"]).count()
        runs.drop()


def test_ids_over_the_whole_range_are_in_a_batch(spark):
    ids = [-(1 << 63), -(1 << 62), 0, 1 << 62, (1 << 63) - 1]
    docs = spark.createDataFrame([(i, f"a line that all of them hold\n{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_dropped"] for r in linededup.line_report(docs).collect()} == {i: int(i != ids[-1]) for i in ids}


def test_line_dedup_is_native(spark, docs):
    plan = linededup.line_report(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapIn" not in plan


@pytest.mark.parametrize("many", [3000, 12_000])
def test_unlinked_classes_of_one_bucket_do_not_meet(spark, many):
    """What is shipped grows with the links of a bucket, not with the square of its classes."""
    import numpy as np

    from proofmill.llm import minhash

    rng = np.random.default_rng(3)
    common = rng.integers(-(1 << 62), 1 << 62, 50)  # a passage that every class holds
    rows, pairs = [], set()
    for node in range(0, many, 2):
        own = rng.integers(-(1 << 62), 1 << 62, 60)
        twin = np.concatenate([own[:55], rng.integers(-(1 << 62), 1 << 62, 5)]) if node % 300 == 0 else rng.integers(-(1 << 62), 1 << 62, 60)
        pairs |= {(node, node + 1)} if node % 300 == 0 else set()
        rows += [(n, np.sort(np.concatenate([common, x]).astype("<i8").view("<u8")).tobytes()) for n, x in ((node, own), (node + 1, twin))]
    sets = spark.createDataFrame(rows, "node long, items binary")
    members = sets.select(F.lit(7).cast("long").alias("key"), "node", F.lit(110).cast("long").alias("n"), F.col("node").alias("component"))
    space = minhash.Workspace(spark, "rest")
    mixed = minhash._mixed(members)
    assert mixed.count() == many
    rare = space.save(minhash.prefixes(space, mixed, sets, 85), "prefixes")
    assert rare.count() <= 2 * 17 * len(pairs)
    assert {(min(r), max(r)) for r in minhash._rest(space, rare, sets, 85).collect()} == pairs
