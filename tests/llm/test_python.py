import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from proofmill.llm import decontam, langid, minhash, simhash, suffix, tokenbin
from proofmill.llm.queries import QUERIES
from tests.llm import brute

DOCS = "doc_id long, text string"


def table(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


def planted():
    rng = np.random.default_rng(5)
    word = lambda: "w" + str(rng.integers(0, 5000))
    base = [word() for _ in range(120)]
    rows = [(k, " ".join(word() for _ in range(int(rng.integers(1, 80))))) for k in range(30)]
    for k in range(30, 70):
        copy = list(base)
        for _ in range(int(rng.integers(0, 9))):
            copy[int(rng.integers(0, len(copy)))] = word()
        rows.append((k, " ".join(copy)))
    rows += [(70, None), (71, ""), (72, " \n"), (73, "one two"), (74, "ONE two"), (75, "one two three four"), (76, "x" * 50_000), (77, "x" * 50_000), (78, "é é é é é é"), (79, "É é é é é é")]
    return rows


@pytest.mark.parametrize("percent", [85, 80])
@pytest.mark.parametrize("chunk", [512, 4])
def test_near_groups_equal_brute_force(spark, monkeypatch, percent, chunk):
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    rows = planted()
    want, sizes = brute.near_groups(rows, percent)
    got = {r["doc_id"]: r for r in minhash.near_groups(spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", component_id string"), percent).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == sizes
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())


def test_near_groups_of_the_table(spark, sf_dir):
    want, _ = brute.near_groups(table(spark, sf_dir), 85)
    assert {r["doc_id"]: r["component_id"] for r in QUERIES["op7_minhash"](spark, sf_dir).collect()} == want


def test_drop_near_edges(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g"), (None, "z"), (3, None), (4, "")]
    docs = spark.createDataFrame([(*r, "k", "c") for r in rows], DOCS + ", kept string, `count` string")
    got = sorted((r["doc_id"] or -1, r["text"] or "") for r in minhash.drop_near(docs).collect())
    assert got == [(-1, "a b c d e f g"), (-1, "z"), (1, "a b c d e f g"), (3, ""), (4, "")]
    assert minhash.drop_near(docs).columns == docs.columns
    assert minhash.near_groups(docs.where("false")).count() == 0


@pytest.mark.parametrize("two", [False, True])
@pytest.mark.parametrize("few", [2, 8])
def test_cell_links_join_what_is_linked(monkeypatch, two, few):
    monkeypatch.setattr(minhash, "FEW", few)
    monkeypatch.setattr(minhash, "BLOCK", 64)
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 63, 900).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) > 0.04 * (k % 4)], rng.integers(0, 1 << 63, 3).astype(np.uint64)])) for k in range(20)]
    sets += [s[:150] for s in sets[:8]] + [s[:1] for s in sets[:3]]
    comps, sides = [k // 2 for k in range(len(sets))], [k % 2 * two for k in range(len(sets))]
    got = minhash.cell_links(comps, sides, sets, 85)
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if comps[a] != comps[b] and (not two or sides[a] != sides[b]) and minhash.linked(sets[a], sets[b], 85)}
    assert {tuple(sorted(p)) for p in got} <= want and len(got) < len(sets)
    joined = lambda edges: brute.components(range(len(sets)), lambda a, b: (a, b) in edges)
    assert joined({tuple(sorted(p)) for p in got}) == joined(want)


def test_a_family_below_the_threshold_writes_no_pairs(spark, monkeypatch):
    rows = []
    for k in range(1200):  # three words of its own each: 0.825 between two members
        own = [f"t{j}" for j in range(160)]
        own[20], own[70], own[120] = f"u{k}", f"v{k}", f"w{k}"
        rows.append((k, " ".join(own)))
    rows += [(5000 + k, rows[3 * k][1] + " tail") for k in range(400)]
    want = {k: k for k in range(1200)} | {5000 + k: 3 * k for k in range(400)}
    kept, save = {}, minhash.Workspace.save
    monkeypatch.setattr(minhash.Workspace, "save", lambda self, df, name: kept.setdefault(name, save(self, df, name)))
    monkeypatch.setattr(minhash.Workspace, "drop", lambda self, name="": None)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_groups(spark.createDataFrame(rows, DOCS)).collect()} == want
    assert all(kept[name].count() <= len(rows) for name in ("links", "more", "sets")) and kept["stars"].count() <= 32 * len(rows)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_equals_brute_force(spark, sf_dir, hot):
    rows = table(spark, sf_dir)[:120]
    shared = "".join(chr(97 + (k * k) % 26) for k in range(260))
    rows += [(1000 + k, f"{'left%d ' % k * k}{shared}{' right%d' % k * 9}") for k in range(12)]
    rows += [(2000, "ab" * 300), (2001, "a" * 201), (2002, "x" * 199), (2003, None), (2004, ""), (2005, "é" * 150 + "q"), (2006, "é" * 150 + "z"), (2007, "a" * 200)]
    want = brute.repeats(rows)
    done = suffix.remove_repeats(spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", start int"), hot, digest=True)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in done.collect()} == want


def test_suffix_of_repeated_and_missing_ids(spark):
    long = " ".join(f"word{k}" for k in range(80))
    rows = [(1, long), (1, "short"), (None, long), (None, None)]
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"]) for r in suffix.remove_repeats(spark.createDataFrame(rows, DOCS)).collect())
    n = len(long)
    assert got == [(-1, 0, 0), (-1, n, n), (1, 5, 0), (1, n, n)]
    assert suffix.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_long_texts_are_cut_into_pieces(monkeypatch):
    text = np.random.default_rng(1).integers(97, 123, 5000).astype(np.uint8).tobytes()
    starts = lambda: sorted({(s + k, int(a)) for _, anchors, _, ss, zs, _ in suffix.text_runs([text]) for a, s, z in zip(anchors.tolist(), ss.tolist(), zs.tolist(), strict=True) for k in range(z)})
    whole = starts()
    monkeypatch.setattr(suffix, "PIECE", 700)
    assert starts() == whole and len(whole) == len(text) - 199


def test_deep_shallow_orders_suffixes():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    text = np.concatenate([data, data[:600], np.zeros(8, np.uint8)])
    starts = np.arange(len(data) + 600 - suffix.LENGTH)
    order, ties = suffix.multikey(text, starts, np.zeros(len(starts), np.int64))
    heads = [text[s : s + suffix.SHALLOW].tobytes() for s in starts[order]]
    assert heads == sorted(heads) and all((heads[k] == heads[k - 1]) == (ties[k] == ties[k - 1]) for k in range(1, len(heads)))
    order, ties = suffix.blind_tries(text, starts, order, ties)
    whole = [text[s : s + suffix.LENGTH].tobytes() for s in starts[order]]
    assert whole == sorted(whole) and all((whole[k] == whole[k - 1]) == (ties[k] == ties[k - 1]) for k in range(1, len(whole)))


def test_hot_anchors_are_cut_until_they_fit(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, 6))
    core, rows = " ".join(word() for _ in range(60)), []
    for k in range(60):  # one passage between ever other words, cut at both ends
        a, b = int(rng.integers(0, 130)), int(rng.integers(0, 130))
        rows.append((k, " ".join([word() for _ in range(30)]) + core[a : len(core) - b] + " ".join([word() for _ in range(30)])))
    rows += [(100, "a" * 5000), (101, "ab" * 700), (102, core), (103, core)]
    want = brute.repeats(rows)
    for hot in (20_000, 3):
        done = suffix.remove_repeats(spark.createDataFrame(rows, DOCS), hot, digest=True)
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in done.collect()} == want


def test_repeated_characters_make_few_runs():
    found = [np.concatenate(x) for x in zip(*suffix.text_runs([b"x" * 50_000, b"xy" * 20_000]), strict=True)]
    keep, weights, (own, lows, highs) = suffix.collapsed(*found[:5])
    assert len(keep) < 10 and own.tolist() == [0, 1] and max(lows) <= 2 and min(highs - [50_000, 40_000]) >= -2 and 2 in weights


def test_language_held_out(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(rows).join(rows.select("doc_id", "lang"), "doc_id")
    held = found.where("held_out")
    assert held.count() > 100 and held.where("lang_pred = lang").count() >= 0.98 * held.count()
    assert held.where("not accepted").count() <= 0.01 * held.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found.select("doc_id", "held_out").collect())


def test_language_edges(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(90_000, None, "en"), (90_001, "", "en"), (90_002, "123 !!", None), (90_003, "the " * 60_000, None), (None, "and the of in", None), (90_004, "x" * 100_000, None), (90_005, "ß²", "de")], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").unionByName(odd).withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in langid.identify(both).collect()}
    assert len(got) == docs.count() + 7
    assert [got[k]["lang_pred"] for k in (90_000, 90_001, 90_002)] == ["und"] * 3 and got[90_000]["score"] == 0 and got[90_003]["lang_pred"] == "en"
    assert got[None]["held_out"] is False and all(0 <= r["score"] <= 1 for r in got.values())
    kept = langid.keep_identified(both)
    assert kept.columns == both.columns and kept.where("doc_id in (90000, 90001, 90002)").count() == 0
    assert {r["lang_pred"] for r in langid.identify(both.where("false").unionByName(both.where("doc_id = 90003"))).collect()} == {"und"}
    assert langid.identify(both.where("false")).count() == 0


def test_fingerprints_equal_plain_loop(spark, sf_dir):
    rows = [(i, t or "") for i, t in table(spark, sf_dir)][:60] + [(5000, ""), (5001, ""), (5002, "é😀" * 7)]
    got = {r["doc_id"]: r for r in simhash.fingerprints(spark.createDataFrame([(*r, "x") for r in rows[:-3]] + [(5000, None, "x"), (5001, "", "x"), (5002, "é😀" * 7, "x")], DOCS + ", fingerprint string")).collect()}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        changed = simhash.edited(t, nxt)
        a, b, c = (simhash.fingerprint(x.encode()) for x in (t, changed, nxt))
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (a.hex(), b.hex())
        assert (got[i]["near_edited"], got[i]["near_next"], got[i]["n_chars"]) == (simhash.likeness(a, b), simhash.likeness(a, c), len(t))
    assert simhash.fingerprints(spark.createDataFrame([], DOCS)).count() == 0
    alone = simhash.fingerprints(spark.createDataFrame([(1, "a b c d e f g h")], DOCS)).first()
    assert alone["near_next"] == 1.0


def test_near_fingerprints_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    base = [int.from_bytes(rng.bytes(16)) for _ in range(12)]
    prints = sorted({b ^ sum(1 << int(x) for x in rng.integers(0, 128, n)) for b in base for n in (0, 1, 2, 3, 4, 5, 7, 9)})
    names = [f"{p:032x}" for p in prints]
    df = spark.createDataFrame([(n,) for n in names], "fingerprint string")
    assert [simhash.agreeing(n) for n in (0, 1 << 22, 1 << 23, 1 << 30, 1 << 31)] == [1, 1, 2, 2, 3]
    for radius, shared in ((3, None), (5, 1), (5, 2), (7, 1), (7, 3)):
        got = sorted((r["query"], r["match"], r["distance"]) for r in simhash.near_fingerprints(df, df.limit(40), radius, shared).collect())
        asked = {r["fingerprint"] for r in df.limit(40).collect()}
        assert got == sorted((a, b, (int(a, 16) ^ int(b, 16)).bit_count()) for a in asked for b in names if a != b and (int(a, 16) ^ int(b, 16)).bit_count() <= radius)


def test_fingerprints_tell_edits_from_neighbours(spark, sf_dir):
    rows = QUERIES["op4_simhash"](spark, sf_dir).where("n_chars > 400")
    r = rows.agg(F.avg("near_edited").alias("e"), F.avg("near_next").alias("n"), F.avg((F.col("near_edited") > F.col("near_next")).cast("int")).alias("w")).first()
    assert r["e"] > 0.75 and r["n"] < 0.6 and r["w"] > 0.97


def test_wand_equals_full_scoring():
    rng = np.random.default_rng(6)
    word = lambda n: f"t{int(rng.zipf(1.4)) % n}"
    items = [(k, " ".join(word(80) for _ in range(int(rng.integers(8, 40)))) + ". " + " ".join(word(80) for _ in range(5))) for k in range(150)]
    index = decontam.build(items)[0]
    numbers = {w: t for t, w in enumerate(index.words.to_pylist())}
    for _ in range(200):
        terms = sorted({numbers[w] for w in (word(80) for _ in range(int(rng.integers(1, 60)))) if w in numbers})
        scores = {}
        for t in terms:
            for i, s in zip(*index.postings(t)[:2], strict=True):
                scores[i] = scores.get(i, 0.0) + s
        got = dict(index.search(terms))
        assert {i for i, s in scores.items() if s >= 1 + 1e-9} <= set(got) <= {i for i, s in scores.items() if s >= 1 - 1e-9}


def test_leaks_equal_brute_force(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts = [tuple(r) for r in items.collect()]
    extra = [(7000 + k, f"Some words ahead of it {t} and behind") for k, (_, t) in enumerate(texts)]
    extra += [(8000, None), (8001, ""), (8002, " ".join(w for w in texts[0][1].split()[::-1])), (8003, ("filler text here " * 20_000) + texts[1][1]), (8004, texts[2][1].upper())]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, DOCS))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(both, items).collect()}
    want = {(r["doc_id"], r["item_id"]) for r in both.join(items.withColumnRenamed("text", "item"), F.contains("text", F.col("item"))).collect()}
    assert want <= got and (8004, texts[2][0]) in got and all(d != 8002 for d, _ in got)
    clean = decontam.drop_leaks(both.withColumn("text2", F.lit(1)), items)
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in both.collect()} - {d for d, _ in got}
    none = items.where("false")
    assert decontam.find_leaks(both, none).count() == 0 and decontam.drop_leaks(both, none).count() == both.count()
    assert decontam.find_leaks(both.where("false"), items).count() == 0


def test_benchmark_in_parts_is_the_same(spark, sf_dir, monkeypatch):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, items).collect()}
    monkeypatch.setattr(decontam, "INDEX_BYTES", 2000)
    assert {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, items).collect()} == whole and whole
    twice = docs.unionByName(docs.where("doc_id % 3 = 0")).withColumn("_row", F.lit("mine")).withColumn("part", F.lit(1))
    left = decontam.drop_leaks(twice, items)
    assert len(decontam._parts(items)) > 3 and left.columns == twice.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(r["doc_id"] for r in twice.collect() if r["doc_id"] not in {d for d, _ in whole})
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "PythonMapInArrow" not in plan  # every part is written before the next


def test_token_files_equal_whole_text_encoding(spark, sf_dir):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenbin.default_tokenizer())
    rows = table(spark, sf_dir) + [(9000, None), (9001, ""), (9002, " lead <|endoftext|>, x İstanbul ΑΣ ﬁ e\u0301 it's,"), (9003, "word " * 90_000), (9004, "x" * 30_000), (None, "null id"), (9005, "\x0b\x0c\x1c\x85 \u2003")]
    got = {r["doc_id"]: r for r in tokenbin.token_output(spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", start int")).collect()}
    start = 0
    for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        start += len(ids)
    assert tokenbin.token_output(spark.createDataFrame([], DOCS)).count() == 0


def test_planes_round_trip(tmp_path):
    rng = np.random.default_rng(1)
    writer = tokenbin.ShardWriter(str(tmp_path), 3, 0)
    docs = [(k if k % 7 else None, rng.integers(0, 49_408, n).astype("<u4").tobytes()) for k, n in enumerate([0, 1, 5, 200_000, 65_536, 3])]
    for d, ids in docs:
        writer.add(d, ids)
    path, n, tokens = writer.close()
    back = [(d, s, b"".join(p)) for d, s, p in tokenbin.read_shard(str(tmp_path), path)]
    assert [(d, ids) for d, _, ids in back] == docs and n == 6 and tokens == sum(len(i) for _, i in docs) // 4
    assert not list(tmp_path.glob(".writing*"))


def test_encoder_rejects_no_batch():
    encoder = tokenbin.WordEncoder(open(tokenbin.default_tokenizer()).read())
    ids, at = encoder.batch(pa.array([], pa.string()))
    assert len(ids) == 0 and at.tolist() in ([0], [])
