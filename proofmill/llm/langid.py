"""Language ID: averaged hashed subword embeddings with a linear softmax.

A word's features are the hashed UTF-8 n-grams (NGRAMS) of its lower-cased letter runs in `<`
`>` and each run itself. A text is the mean of its features' embeddings; a linear layer and
a softmax give the languages. Embeddings and layer are trained on the driver by stochastic
gradient descent in numpy, on a bounded hash-chosen sample of labelled rows: about
SAMPLE_PER_LANG for each of at most MAX_LANGS languages, none over SAMPLE_TEXT bytes, about
SAMPLE_BYTES in all (these bounds are for fitting only). A further class, none of the languages, is trained beside
them on generated texts: random letters and scripts, encoded bytes, program code, markup, log
lines and pseudo-languages (texts of the sample whose vowels and whose consonants are swapped
among each other). A fifth of the sample is held back: on it a temperature calibrates the scores
of the languages, and two bounds of rejection are set, each for texts of fewer than LONG features
and for others. One is on the log-odds of none against the best language, the other on a text's
strength, the mean over its features of how far a feature's logits lie apart, which stays high
where languages mix. Each takes what it needs to reject DENY of fresh generated texts, but no more
than leaves all but REJECT of the held-back texts, snippets of a few words among them, a
margin inside. Short garbage can be like short clean texts and is then kept.

Prediction reads whole texts. As embedding and layer are linear, a feature has fixed logits,
a word the sum of its features', a text the mean; workers cache words within a bound.

Defined cases: null text or text without a letter: `und`, score 0, rejected. Null doc_id or
null lang never trains; null doc_id is not held out. Without any labelled row all is `und`.
Ties go to the language first by code point. A very long text is read whole (it is not in the
fitting sample, which is bounded). Repeated rows stay, rows that repeat a doc_id are each
predicted; an empty table gives no rows; extra columns, also of the result's names, are not read
by identify and kept by keep_identified.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import bounded_batches, release

SAMPLE_PER_LANG, SAMPLE_TEXT, SAMPLE_BYTES, MAX_LANGS = 500, 1 << 16, 64 << 20, 200
BUCKETS, DIM, NGRAMS, EPOCHS, RATE, BATCH = 1 << 15, 16, (2, 3, 4), 6, 0.6, 32
#: Small samples are passed over more often, up to this many steps.
LEAST_STEPS = 800
#: Margins of the log-odds of short and of long texts.
REJECT, MARGINS, DENY = 0.001, (2.0, 0.5), 0.98
GARBAGE, STRONG, LONG = 0.95, 0.9, 100
#: Generated texts of each kind that the class of no language learns from.
KINDS, GARBLED = 150, 100
#: First and last letter of scripts for generated texts.
SCRIPTS = [(0x61, 0x7A), (0x3B1, 0x3C9), (0x430, 0x44F), (0x5D0, 0x5EA), (0x627, 0x64A), (0x915, 0x939), (0xE01, 0xE2E), (0x3042, 0x3093), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]
#: Names of program code, and forms of its lines, of markup, of logs and of data: A is a name, N a number, W a word, ~ an indent.
NAMES = (
    "i", "j", "x", "idx", "tmp", "buf", "len", "str", "obj", "arr", "val", "key", "node", "ptr", "err", "ctx", "cfg", "args", "self", "this", "data", "item", "list", "map",
    "func", "int", "param", "result", "value", "index", "count", "name", "type", "id", "path", "file", "line", "size", "test", "util", "http", "url", "json", "xml", "api", "db", "sql",
)
FORMS = (
    ["~def A(A, A=N):", "~for A in range(N):", "~if A is not None and A > N:", "~return A.A(A)", "import A.A as A", "from A import A", "~self.A = A[N]", "class A(A):", "~raise ValueError(A)", "~with open(A) as A:", "~# W W W", "~A = [A for A in A if A]"],
    ["~const A = A.A(A => A);", "~if (A === N) { return A; }", "function A(A, A) {", "~var A = new A();", "~console.log(A);", "public static void A(String[] A) {", "~private int A = N;", "#include <A.h>", "~printf(A, A);", "~}", "~case N: A(); break;", "~while (A < A.length) A++;", "~// W W", "~export default A"],
    ['<div class="A A"><span id="A">W</span></div>', '<a href="http://A.A/A?A=N">W W</a>', "<td>N</td><td>W</td>", '<link rel="stylesheet" href="/A/A.css">', '<script src="A.js"></script>', "<ul><li>W</li><li>W</li></ul>", ".A { margin: Npx; color: #N; }", '<meta name="A" content="W">', "&nbsp;&amp;", "<br/>", '<img src="A.png" alt="W">', '<input type="text" name="A">'],
    ["N-N-N N:N:N,N ERROR [A-N] org.A.A.A - W W A=N", 'N.N.N.N - - [N/Jan/N:N:N:N +N] "GET /A/A HTTP/1.1" N N', "N:N:N INFO A: A started in N ms", "[WARN] A.A(N): A", "Traceback (most recent call last):", '~File "/A/A.py", line N, in A', "DEBUG A - A=A, A=N", "at A.A.A(A.java:N)"],
    ['{"A": N, "A": "W", "A": [N, N]}', "A;N;W;N", "A=N", "N,W,N,A", "A: A", "SELECT A, A FROM A WHERE A = N AND A LIKE W;", "INSERT INTO A VALUES (N, W);", "[A.A]", "export A=/A/A"],
)
CACHE_WORDS, CACHE_CHARS = 150_000, 40
FOLDS, HELD_OUT = 4, 2


def letter_runs(word: bytes) -> list[bytes]:
    text = word.decode("utf-8", "replace").lower()
    if text.isalpha():
        return [text.encode()]
    return "".join(c if c.isalpha() else " " for c in text).encode().split()


def features(words: list[bytes]):
    """(bucket of each feature, its position in `words`), in the order of words."""
    import numpy as np
    from xxhash import xxh32_intdigest

    runs = [(k, r) for k, w in enumerate(words) for r in letter_runs(w)]
    if not runs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.frombuffer(b"".join([b"<" + r + b">" for _, r in runs]), dtype=np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(runs)), [len(r) + 2 for _, r in runs])
    buckets = [np.array([xxh32_intdigest(r) % BUCKETS for _, r in runs])]
    owners = [np.arange(len(runs))]
    for n in NGRAMS:
        code = np.full(len(text) - n + 1, n, np.uint64)
        for k in range(n):
            code = (code << np.uint64(8)) | text[k : len(text) - n + 1 + k]
        whole = owner[: len(code)] == owner[n - 1 :]
        buckets.append(((code[whole] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % BUCKETS)
        owners.append(owner[: len(code)][whole])
    at = np.array([k for k, _ in runs])[np.concatenate(owners)]
    order = np.argsort(at, kind="stable")
    return np.concatenate(buckets)[order], at[order]


def _rows(examples: list[list[bytes]]):
    """CSR of feature shares: (indices, shares, offsets)."""
    import numpy as np

    indices, shares, offsets = [], [], [0]
    for words in examples:
        ids, counts = np.unique(features(words)[0], return_counts=True)
        indices.append(ids)
        shares.append(counts / max(1, counts.sum()))
        offsets.append(offsets[-1] + len(ids))
    return np.concatenate(indices), np.concatenate(shares).astype(np.float32), np.array(offsets)


def garbage(texts: list[bytes], seed: int) -> list[list[bytes]]:
    """Words of generated texts in no language: of the texts' letters, of a script's, encoded bytes."""
    import base64

    import numpy as np

    rng = np.random.default_rng(seed)
    letters = [sorted({c for t in texts for c in t.decode("utf-8", "replace").lower() if c.isalpha()}) or ["a"]]
    letters += [[chr(c) for c in range(a, z + 1)] for a, z in SCRIPTS]
    drawn = lambda own: "".join(own[int(i)] for i in rng.integers(0, len(own), int(rng.integers(2, 10)))).encode()
    out = []
    for k in range(GARBLED):
        for size in (int(rng.integers(1, 5)), int(rng.integers(5, 60))):
            script = letters[1 + k % len(SCRIPTS)]
            out += [[drawn(letters[0]) for _ in range(size)], [drawn(script) for _ in range(size)]]
            out += [[base64.b64encode(rng.bytes(size * 6))], [rng.bytes(size * 4).hex().encode()]]
    return out


def written_lines(rng, words: list[str]) -> list[list[bytes]]:
    """Generated program code, markup, log lines and data, of short names and of the texts' words."""
    pick = lambda own: own[int(rng.integers(0, len(own)))]
    parts = ["".join(pick("bcdfghklmnprstvwxz") + pick("aeiou") * int(rng.integers(0, 2)) for _ in range(int(rng.integers(1, 4)))) for _ in range(200)]

    def name() -> str:
        kind, own = int(rng.integers(0, 5)), pick(NAMES if rng.random() < 0.6 else parts)
        other = pick(words if rng.random() < 0.4 else NAMES)
        return (own, f"{own}_{other}", own + other.capitalize(), f"{own}.{other}", own.upper())[kind]

    def line(forms: list[str]) -> str:
        return re.sub("[ANW]", lambda m: name() if m[0] == "A" else str(int(rng.integers(0, 10**int(rng.integers(1, 7))))) if m[0] == "N" else pick(words), pick(forms).replace("~", " " * int(rng.integers(0, 9))))

    return ["\n".join(line(forms) for _ in range(int(rng.integers(1, 25)))).encode().split() for forms in FORMS for _ in range(KINDS)]


def swapped(texts: list[bytes], rng) -> list[list[bytes]]:
    """Texts of pseudo-languages: vowels swapped among each other, consonants among each other."""
    out = []
    for _ in range(4 * KINDS if texts else 0):
        table = bytearray(range(256))
        for own in (b"aeiou", b"bcdfghjklmnpqrstvwxyz"):
            for old, new in zip(own, rng.permutation(bytearray(own)).tolist(), strict=True):
                table[old], table[old - 32] = new, new - 32
        words = texts[int(rng.integers(0, len(texts)))].translate(bytes(table)).split()
        size = int(rng.integers(1, 60 if rng.random() < 0.7 else 400))
        at = int(rng.integers(0, max(1, len(words) - size + 1)))
        out.append(words[at : at + size])
    return out


def negatives(texts: list[bytes], seed: int) -> list[list[bytes]]:
    """Words of generated texts in none of the languages."""
    import numpy as np

    rng = np.random.default_rng(seed)
    words = [w for t in texts[:200] for w in re.findall("[a-z]{2,12}", t[:2000].decode("utf-8", "replace").lower())] or ["a"]
    found = garbage(texts, seed) + written_lines(rng, words) + swapped(texts, rng)
    return [words for words in found if any(letter_runs(w) for w in words)]


def train(samples: list[tuple[int, str, bytes]], seed: int = 7) -> dict:
    """samples: (key, lang, text); the key decides what is held back for calibration. The last column
    of logits and bias is the class of no language."""
    import numpy as np

    langs = sorted({lang for _, lang, _ in samples})
    if not langs:
        return {"langs": [], "logits": np.zeros((BUCKETS, 0), np.float32), "apart": np.zeros(BUCKETS, np.float32), "temperature": 1.0, "most": (np.inf, np.inf), "least": (0.0, 0.0)}
    rng = np.random.default_rng(seed)
    parts = {False: ([], []), True: ([], [])}
    for key, lang, text in sorted(samples):
        words = text.split()
        if not any(letter_runs(w) for w in words):
            continue
        examples, labels = parts[len(samples) >= 50 and zlib.crc32(str(key).encode()) % 5 == 0]
        for size in (len(words), rng.integers(1, 5), rng.integers(5, 60)):  # the text, and snippets as short texts
            at = rng.integers(0, max(1, len(words) - size + 1))
            examples.append(words[at : at + size])
            labels.append(langs.index(lang))
    (examples, labels), (kept, kept_labels) = parts[False], parts[True]
    texts = [text for _, _, text in sorted(samples)]
    if examples:
        others = negatives(texts, seed + 1)
        examples, labels = examples + others, labels + [len(langs)] * len(others)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, len(langs) + 1), np.float32), np.zeros(len(langs) + 1, np.float32)
    if examples:
        indices, shares, offsets = _rows(examples)
        y = np.array(labels)
        epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(y)))
        steps, step = epochs * (len(y) // BATCH + 1), 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for k in range(0, len(y), BATCH):
                rate, step = RATE * max(0.02, 1 - step / steps), step + 1
                pick = order[k : k + BATCH]
                spans = [slice(offsets[i], offsets[i + 1]) for i in pick]
                row = np.repeat(np.arange(len(pick)), [s.stop - s.start for s in spans])
                ids, share = np.concatenate([indices[s] for s in spans]), np.concatenate([shares[s] for s in spans])
                mean = np.zeros((len(pick), DIM), np.float32)
                np.add.at(mean, row, emb[ids] * share[:, None])
                z = mean @ layer + bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(pick)), y[pick]] -= 1
                back = p @ layer.T
                layer -= rate * mean.T @ p / len(pick) * 4
                bias -= rate * p.mean(0)
                np.add.at(emb, ids, -rate * 4 * share[:, None] * back[row])
    logits = emb @ layer
    model = {"langs": langs, "logits": logits.astype(np.float32), "bias": bias, "temperature": 1.0, "most": (np.inf, np.inf), "least": (0.0, 0.0)}
    model["apart"] = np.abs(logits[:, :-1] - logits[:, :-1].mean(1, keepdims=True)).max(1).astype(np.float32)
    if kept:
        z, y = scores(model, kept), np.array(kept_labels)

        def soft(t):
            e = np.exp((z[:, :-1] - z[:, :-1].max(1, keepdims=True)) / t)
            return e / e.sum(1, keepdims=True)

        grid = np.geomspace(0.2, 5, 41)
        loss = [-np.log(soft(t)[np.arange(len(y)), y] + 1e-9).mean() for t in grid]
        model["temperature"] = float(grid[int(np.argmin(loss))])
        good = z[:, :-1].argmax(1) == y
        clean, fresh = [w for w, g in zip(kept, good, strict=True) if g], negatives(texts, seed + 2)
        model["most"] = most_odds(model, clean, fresh)
        model["least"] = least_strength(model["apart"], clean, garbage(texts, seed + 2))
    return model


def scores(model: dict, examples: list[list[bytes]]):
    """The classes' scores of each example, the last that of no language."""
    import numpy as np

    indices, shares, offsets = _rows(examples)
    z = np.zeros((len(examples), model["logits"].shape[1]), np.float32)
    np.add.at(z, np.repeat(np.arange(len(examples)), np.diff(offsets)), model["logits"][indices] * shares[:, None])
    return z + model["bias"]


def most_odds(model: dict, clean: list[list[bytes]], noise: list[list[bytes]]) -> tuple[float, float]:
    """The greatest log-odds of no language against the best one, of short and of long texts."""
    import numpy as np

    def split(examples):
        z = scores(model, examples)
        odds, long = z[:, -1] - z[:, :-1].max(1), np.array([len(features(w)[0]) >= LONG for w in examples])
        return [np.sort(odds[long == side]) for side in (False, True)]

    return tuple(
        float(max(good[int((1 - REJECT) * (len(good) - 1))] + margin, bad[int((1 - DENY) * len(bad))])) if len(good) and len(bad) else np.inf
        for margin, good, bad in zip(MARGINS, split(clean), split(noise), strict=True)
    )


def least_strength(apart, clean: list[list[bytes]], noise: list[list[bytes]]) -> tuple[float, float]:
    """The least strength of short and of long texts."""
    import numpy as np

    def split(examples):
        found = [apart[features(words)[0]] for words in examples]
        return [np.sort([f.mean() for f in found if len(f) and (len(f) >= LONG) == long]) for long in (False, True)]

    return tuple(
        float(min(good[int(REJECT * len(good))] * STRONG, bad[int(GARBAGE * len(bad))])) if len(good) and len(bad) else 0.0
        for good, bad in zip(split(clean), split(noise), strict=True)
    )


def fit(docs: DataFrame) -> dict:
    """Train on the labelled rows outside the held-out fold."""
    usable = docs.where("text is not null and lang is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT)
    short = usable.where(F.octet_length("text") <= SAMPLE_TEXT)
    counts = short.groupBy("lang").agg(F.count(F.lit(1)).alias("count"), F.sum(F.octet_length("text")).alias("bytes")).orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()
    if not counts:
        return train([])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    rate = lambda r: min(1.0, SAMPLE_PER_LANG / r["count"], SAMPLE_BYTES / len(counts) / max(1, r["bytes"]))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], int(rate(r) * (1 << 30)))])
    picked = short.where(draw < F.try_element_at(share, F.col("lang")))
    rows = picked.select("doc_id", "lang", F.encode("text", "UTF-8").alias("text")).collect()
    return train([(r["doc_id"], r["lang"], bytes(r["text"])) for r in rows])


class Predictor:
    def __init__(self, model: dict):
        self.model = model
        self.clear()

    def clear(self):
        import numpy as np

        self.cache: dict[bytes, int] = {}
        self.table = np.zeros((1 << 14, self.model["logits"].shape[1] + 2))

    def sums(self, words: list[bytes]):
        """A row for each word: its features' summed logits and strengths, and their number."""
        import numpy as np

        buckets, at = features(words)
        logits = self.model["logits"]
        weighed = [*(logits[buckets, k] for k in range(logits.shape[1])), self.model["apart"][buckets]]
        return np.stack([np.bincount(at, weights=w, minlength=len(words)) for w in weighed] + [np.bincount(at, minlength=len(words))], axis=1)

    def batch(self, texts: list[bytes | None]) -> list[tuple[str, float, bool]]:
        import numpy as np

        if not self.model["langs"]:
            return [("und", 0.0, False)] * len(texts)
        if len(self.cache) > CACHE_WORDS:
            self.clear()
        cache, split = self.cache, [(t or b"").split() for t in texts]
        new = [w for w in dict.fromkeys(w for words in split for w in words if w not in cache) if len(w) <= CACHE_CHARS]
        if new:
            rows, have = self.sums(new), len(cache)
            while have + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[have : have + len(new)] = rows
            cache.update(zip(new, range(have, have + len(new)), strict=True))
        return [self._label(words) for words in split]

    def _label(self, words: list[bytes]) -> tuple[str, float, bool]:
        import numpy as np

        cache = self.cache
        known = [cache[w] for w in words if w in cache]
        total = self.table[known].sum(0)
        if len(known) < len(words):
            total = total + self.sums([w for w in words if w not in cache]).sum(0)
        if not total[-1]:
            return "und", 0.0, False
        z = total[:-2] / total[-1] + self.model["bias"]
        own = z[:-1] / self.model["temperature"]
        p = np.exp(own - own.max())
        p /= p.sum()
        best, long = int(p.argmax()), bool(total[-1] >= LONG)
        accepted = z[-1] - z[:-1].max() <= self.model["most"][long] and total[-2] / total[-1] >= self.model["least"][long]
        return self.model["langs"][best], float(min(1.0, p[best])), bool(accepted)


def predict(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """The `keep` columns (text among them or not) with _lang, _score, _accepted; a narrow map
    over whole texts. Result columns are positional: _c0, _c1 ... for `keep`."""
    from pyspark.sql import types as T

    spark = docs.sparkSession
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast(model)  # BUCKETS x languages floats: bounded
    own = [F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(keep)]
    text = keep.index("text") if "text" in keep else len(keep)
    rows = docs.select(*own) if text < len(keep) else docs.select(*own, F.col("text").alias("_text"))
    added = T.StructType([T.StructField("_lang", T.StringType()), T.StructField("_score", T.DoubleType()), T.StructField("_accepted", T.BooleanType())])
    schema = T.StructType([*rows.schema.fields[: len(keep)], *added.fields])

    def run(batches):
        import pyarrow as pa

        predictor = Predictor(shipped.value)
        for batch in batches:
            texts, found = batch.column(text).cast(pa.binary()), []
            for k in range(0, len(texts), 256):
                found += predictor.batch(texts[k : k + 256].to_pylist())
            results = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *results], names=schema.names)
        del predictor
        release()

    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of every document."""
    held = F.coalesce(F.crc32(F.col("_c0").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    found = predict(docs, fit(docs), ["doc_id"])
    return found.select(F.col("_c0").alias("doc_id"), held.alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_accepted").alias("accepted"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is accepted, with their own columns."""
    found = predict(docs, fit(docs), docs.columns)
    return found.where("_accepted").select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(docs.columns)])
