"""Benchmark decontamination: a BM25 index of the test items, block-max WAND, overlap checks.

Every passage of every training text is a query against an inverted index of the benchmark
items. A passage is a window of two strides of words; a stride holds the longest item of its
size class and a quarter more, so a copied item always lies whole inside a window. An item's
threshold is its own BM25 score less the most that can be missing from a passage that still
passes the overlap checks (`spare_words`), so retrieval above the threshold loses no such
passage. Weights are divided by the thresholds, which makes the threshold 1 for all.

All passages of a batch first meet the block-max bound in numpy: an item's weakest terms that
stay below 1 together cannot retrieve it alone, so only blocks in which a passage has one of an
item's other terms are open for it, and the block maxima of the passage's terms must reach 1.
Passages with such a block, and only those, are searched with block-max WAND, and each item
found is verified in the passage: QUESTION of the 5-word shingles of the item without its last
sentence and ANSWER of the last sentence's words (an item of one sentence is all question). A
question of fewer than five words is one shingle, so short items must stand in the text as
they are.

The driver builds the index once for each part of the benchmark and broadcasts its arrays, about
ten times the items' bytes; a part has at most INDEX_BYTES of items, a larger benchmark is dealt
by item id into more parts, one after another, a pass of the corpus each, and loses nothing.

Words are runs of letters and digits, lower-cased; in scripts without spaces each character is
a word. Defined cases: null or empty text matches nothing; null, empty and wordless items, and
items without an item_id, identify nothing and are left out; an item of one word is found
wherever that word stands; repeated items are one, texts that share an item_id are each searched
for; rows that repeat a doc_id are one in find_leaks, each for itself in drop_leaks; equally good
passages give one row, that of the greatest (score, question, answer); a very long text is many
passages and is read whole; an empty table on either side gives no match, so all documents stay;
extra columns, also of the result's names, are kept by drop_leaks and not read by find_leaks.
doc_id and item_id hold integers; other values stop the job.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import Workspace, bounded_batches, release

#: Least shares of an item that count as found, as fractions: whole numbers decide, not rounding.
QUESTION, ANSWER, SHINGLE = (4, 5), (4, 5), 5
K1, B, BLOCK = 1.2, 0.75, 16
#: Items of a block in the batch bound.
BOUND_BLOCK = 2
#: Cells of the term-by-passage table held at once.
PRESENCE = 1 << 24
INDEX_BYTES = 8 << 20
#: Size classes of items in words: powers of two from this on.
LEAST_CLASS = 64
MARKS = r"[^\p{L}\p{N}\s]+"
#: Scripts that put no space between words.
SPACELESS = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"


def arrow_words(texts):
    """(list offsets, word codes, Arrow array of the distinct words) of an Arrow string array."""
    import pyarrow.compute as pc

    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), MARKS, " ")
    if not pc.all(pc.string_is_ascii(plain)).as_py():
        plain = pc.if_else(pc.string_is_ascii(plain), plain, pc.replace_substring_regex(plain, SPACELESS, r" \1 "))
    split = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(plain))
    words = split.values.dictionary_encode()
    return split.offsets.to_numpy(), words.indices.to_numpy(), words.dictionary


def item_parts(text: str) -> tuple[str, str]:
    """(question, answer): the last sentence is the answer."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if s]
    return (" ".join(sentences[:-1]), sentences[-1]) if len(sentences) > 1 else (text, "")


def shingle_set(words: list) -> set:
    return {tuple(words[k : k + SHINGLE]) for k in range(len(words) - SHINGLE + 1)} if len(words) >= SHINGLE else {tuple(words)} if words else set()


def spare_words(question: list, answer: list) -> int:
    """How many distinct words of an item a passage may lack and still pass both checks.

    With m shingles missing, the distinct words that are absent and stand before the last four
    places of the question begin shingles of their own, and those that first stand in the last
    four end shingles of their own, so there are at most m of each, and at most four of the latter.
    """
    missing = len(shingle_set(question)) * (QUESTION[1] - QUESTION[0]) // QUESTION[1]
    return missing + min(SHINGLE - 1, missing) + len(set(answer)) * (ANSWER[1] - ANSWER[0]) // ANSWER[1]


def enough(part: int, whole: int, share: tuple[int, int]) -> bool:
    return part * share[1] >= whole * share[0]


class ItemIndex:
    """BM25 postings of one size class, weights over thresholds, with block maxima, as arrays."""

    def __init__(self, items: list[tuple[int, list[str], list[str]]]):
        import numpy as np
        import pyarrow as pa

        self.ids = [i for i, _, _ in items]
        flat = pa.array([w for _, q, a in items for w in q + a], pa.string()).dictionary_encode()
        self.words, codes = flat.dictionary, flat.indices.to_numpy().astype(np.int64)
        n, n_terms = len(items), len(self.words)
        length = np.array([len(q) + len(a) for _, q, a in items], np.int64)
        self.codes, self.starts = codes.astype(np.int32), np.concatenate([[0], np.cumsum(length)])
        self.asked = np.array([len(q) for _, q, _ in items], np.int64)
        self.stride = int(length.max()) * 5 // 4 + 1
        pairs, counts = np.unique(np.repeat(np.arange(n), length) * n_terms + codes, return_counts=True)
        item, term = pairs // n_terms, pairs % n_terms
        having = np.bincount(term, minlength=n_terms)
        idf = np.log(1 + (n - having + 0.5) / (having + 0.5))
        weight = idf[term] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * length[item] / length.mean()))
        order = np.lexsort((term, weight, item))
        item, term, weight = item[order], term[order], weight[order]
        distinct = np.bincount(item, minlength=n)
        first = np.cumsum(distinct) - distinct
        summed = np.cumsum(weight)
        summed -= (summed[first] - weight[first])[item]
        spare = np.array([spare_words(q, a) for _, q, a in items], np.int64)
        need = np.maximum(summed[first + np.maximum(1, distinct - spare) - 1], 1e-9) * (1 - 1e-9)
        share, essential = weight / need[item], summed >= need[item]

        by_term = np.lexsort((item, term))
        self.post_items, self.post_shares = item[by_term].astype(np.int32), share[by_term]
        self.post_starts = np.concatenate([[0], np.cumsum(having)])
        inside = np.arange(len(by_term)) - np.repeat(self.post_starts[:-1], having)
        heads = np.flatnonzero(inside % BLOCK == 0)
        self.tops = np.maximum.reduceat(self.post_shares, heads)
        self.lasts = self.post_items[np.append(heads[1:], len(by_term)) - 1]
        self.top_starts = np.concatenate([[0], np.cumsum(-(-having // BLOCK))])

        keep = by_term[essential[by_term]]
        self.essential_items = item[keep]
        self.essential_sizes = np.append(np.bincount(term[keep], minlength=n_terms), 0)  # -1: no term
        self.essential_starts = np.cumsum(self.essential_sizes) - self.essential_sizes

        by_block = np.lexsort((term, item // BOUND_BLOCK))
        where = (item // BOUND_BLOCK * n_terms + term)[by_block]
        heads = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        self.block_tops = np.maximum.reduceat(share[by_block], heads).astype(np.float32)
        self.block_terms = where[heads] % n_terms
        self.block_sizes = np.bincount(where[heads] // n_terms)
        self.block_starts = np.cumsum(self.block_sizes) - self.block_sizes
        self.used: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"used": {}}

    def postings(self, term: int):
        """(items, shares, block maxima, last item of each block, largest share) of a term."""
        if term not in self.used:
            at, top = slice(*self.post_starts[term : term + 2]), slice(*self.top_starts[term : term + 2])
            tops = self.tops[top].tolist()
            self.used[term] = (self.post_items[at].tolist(), self.post_shares[at].tolist(), tops, self.lasts[top].tolist(), max(tops))
        return self.used[term]

    def parts(self, item: int) -> tuple[list[int], list[int]]:
        """Term numbers of the question and of the answer."""
        own = self.codes[self.starts[item] : self.starts[item + 1]].tolist()
        return own[: self.asked[item]], own[self.asked[item] :]

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: every item whose score is 1 or more."""
        lists = [self.postings(t) for t in terms]
        at = [0] * len(lists)
        live = [(plist[0][0], k) for k, plist in enumerate(lists)]
        found = []

        def advance(k: int, to: int):
            ids, _, _, lasts, _ = lists[k]
            b = at[k] // BLOCK
            while b < len(lasts) and lasts[b] < to:
                b += 1
            p = max(at[k], b * BLOCK)
            while p < len(ids) and ids[p] < to:
                p += 1
            at[k] = p
            return (ids[p], k) if p < len(ids) else None

        while live:
            live.sort()
            bound, pivot = 0.0, -1
            for n, (_, k) in enumerate(live):
                bound += lists[k][4]
                if bound >= 1:
                    pivot = n
                    break
            if pivot < 0:
                break
            item = live[pivot][0]
            while pivot + 1 < len(live) and live[pivot + 1][0] == item:
                pivot += 1
            bound, skip_to = 0.0, live[pivot + 1][0] if pivot + 1 < len(live) else math.inf
            for _, k in live[: pivot + 1]:
                _, _, tops, lasts, _ = lists[k]
                b = at[k] // BLOCK
                while b < len(lasts) and lasts[b] < item:
                    b += 1
                if b < len(lasts):
                    bound += tops[b]
                    skip_to = min(skip_to, lasts[b] + 1)
            if bound < 1:
                moved, to = range(pivot + 1), max(skip_to, item + 1)
            elif live[0][0] == item:
                score = sum(lists[k][1][at[k]] for _, k in live[: pivot + 1])
                if score >= 1:
                    found.append((item, score))
                moved, to = range(pivot + 1), item + 1
            else:
                moved, to = [n for n in range(pivot + 1) if live[n][0] < item], item
            renewed = [advance(live[n][1], to) for n in moved]
            chosen = set(moved)
            live = [x for n, x in enumerate(live) if n not in chosen] + [x for x in renewed if x]
        return found

    def verify(self, item: int, own: list[int], shingles: set, bag: set) -> tuple[tuple[int, int], tuple[int, int]]:
        """(found, all) of an item's question shingles and of its answer words in a passage."""
        question, answer = self.parts(item)
        asked, told = shingle_set(question), set(answer)
        have = shingles if len(question) >= SHINGLE else {tuple(own[k : k + len(question)]) for k in range(len(own) - len(question) + 1)}
        return (len(asked & have), len(asked)), (len(told & bag), len(told))

    def match(self, offsets, codes, words):
        """(text number, item position, score, question, answer) of the leaks in a batch."""
        import numpy as np
        import pyarrow.compute as pc

        known = pc.fill_null(pc.index_in(words, value_set=self.words), -1)
        terms = known.to_numpy(zero_copy_only=False).astype(np.int64)[codes]
        n_terms, n_items = len(self.words), len(self.ids)
        lengths = np.diff(offsets)
        halves = np.maximum(1, -(-lengths // self.stride))
        first = np.cumsum(halves) - halves
        doc = np.repeat(np.arange(len(lengths)), lengths)
        half = first[doc] + (np.arange(len(codes)) - offsets[:-1][doc]) // self.stride if len(codes) else np.zeros(0, np.int64)
        hit = (terms >= 0) & (self.essential_sizes[terms] > 0)
        pairs = np.unique(half[hit] * n_terms + terms[hit])
        where, term = pairs // n_terms, pairs % n_terms
        size = self.essential_sizes[term]
        ends = np.cumsum(size)
        if not len(ends) or not ends[-1]:
            return
        flat = np.repeat(self.essential_starts[term] - (ends - size), size) + np.arange(ends[-1])
        key = np.repeat(where, size) * n_items + self.essential_items[flat]
        # a half window counts in the passage that starts with it and in the one before
        doc_of = np.repeat(np.arange(len(lengths)), halves)
        at_half, block = key // n_items, key % n_items // BOUND_BLOCK
        earlier = (at_half > 0) & (doc_of[np.maximum(at_half - 1, 0)] == doc_of[at_half])
        wanted = np.unique(np.concatenate([block * len(doc_of) + at_half, (block * len(doc_of) + at_half - 1)[earlier]]))
        block, at_half = wanted // len(doc_of), wanted % len(doc_of)
        seen = terms >= 0
        passages = set()
        step = max(1, PRESENCE // n_terms)
        for low in range(0, len(doc_of), step):  # presence of each term in each passage, a bounded table at a time
            high = min(low + step, len(doc_of))
            here = seen & (half >= low) & (half <= high)
            present = np.zeros((high - low + 1, n_terms), np.uint8)
            present[half[here] - low, terms[here]] = 1
            follow = (doc_of[low:high] == np.append(doc_of, -1)[low + 1 : high + 1]).astype(np.uint8)
            mine = (at_half >= low) & (at_half < high)
            rows, blocks = at_half[mine] - low, block[mine]
            for k in range(0, len(rows), 1 << 14):
                r, b = rows[k : k + (1 << 14)], blocks[k : k + (1 << 14)]
                size = self.block_sizes[b]
                ends = np.cumsum(size)
                at = np.repeat(self.block_starts[b] - (ends - size), size) + np.arange(ends[-1])
                row, term = np.repeat(r, size), self.block_terms[at]
                held = present[row, term] | (present[row + 1, term] & follow[row])
                bound = np.add.reduceat(held * self.block_tops[at], ends - size)
                passages.update((r[bound >= 1 - 1e-5] + low).tolist())
        for h in sorted(passages):
            d = int(doc_of[h])
            start = offsets[d] + (h - first[d]) * self.stride
            own = terms[start : min(start + 2 * self.stride, offsets[d + 1])].tolist()
            bag = set(own) - {-1}
            found = self.search(sorted(bag))
            if found:
                shingles = shingle_set(own)
                for k, score in found:
                    q, a = self.verify(k, own, shingles, bag)
                    if enough(*q, QUESTION) and enough(*a, ANSWER):
                        yield d, k, score, q[0] / max(1, q[1]) if q[1] else 1.0, a[0] / a[1] if a[1] else 1.0


def build(items: list[tuple[int, str]]) -> list[ItemIndex]:
    """One index per size class."""
    import pyarrow as pa

    clean = sorted({(i, t) for i, t in items if i is not None and t})
    offsets, codes, words = arrow_words(pa.array([p for _, t in clean for p in item_parts(t)], pa.string()))
    plain = words.to_pylist()
    parts = [[plain[c] for c in codes[a:b].tolist() if plain[c]] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    classes = defaultdict(list)
    for (item_id, _), q, a in zip(clean, parts[::2], parts[1::2], strict=True):
        q, a = (q, a) if q else (a, q)
        if q:
            classes[max(LEAST_CLASS, 1 << (len(q) + len(a) - 1).bit_length())].append((item_id, q, a))
    return [ItemIndex(classes[c]) for c in sorted(classes)]


def leaks_in(indexes: list[ItemIndex], texts) -> dict:
    """(text number, item_id) -> (score, question, answer), the best passage's."""
    best: dict = {}
    offsets, codes, words = arrow_words(texts)
    for index in indexes:
        for d, k, *scores in index.match(offsets, codes, words):
            at = (d, index.ids[k])
            best[at] = max(best.get(at, (0.0, 0.0, 0.0)), tuple(scores))
    return best


def _parts(benchmark: DataFrame) -> list[DataFrame]:
    """The items, dealt by id into parts of about INDEX_BYTES of text."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = -(-size // INDEX_BYTES)
    return [rows.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p) for p in range(parts)]


def _passes(docs: DataFrame, parts: list[DataFrame], run, schema: str, columns: list, space: Workspace):
    """What run(shipped index) makes of docs for each part of the items. A single part is one narrow,
    lazy pass. Of more, each is indexed, sent, passed over and written before the next, so that the
    driver, the executors and a task hold one part at a time."""
    for p, part in enumerate(parts):
        index = build([tuple(r) for r in part.collect()])
        if not index:
            continue
        shipped = docs.sparkSession.sparkContext.broadcast(index)
        found = docs.select(*columns).mapInArrow(run(shipped), schema)
        if len(parts) == 1:
            yield found
        else:
            yield space.save(found, f"part-{p}")
            shipped.destroy()


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every verified leak."""
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"

    def run(shipped):
        def each(batches):
            import pyarrow as pa

            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    part = batch.slice(k, 256)
                    ids = part.column(0)
                    out = [{"doc_id": ids[d].as_py(), "item_id": i, "score": s, "question_overlap": q, "answer_overlap": a} for (d, i), (s, q, a) in leaks_in(shipped.value, part.column(1)).items()]
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))

        return each

    found = docs.sparkSession.createDataFrame([], schema)
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text")]
    for one in _passes(docs, _parts(benchmark), run, schema, columns, Workspace(docs.sparkSession, "leaks")):
        found = found.unionByName(one)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text leaks an item: one narrow pass over docs, or, for a benchmark
    of several parts, a pass of row numbers for each and an anti-join."""
    bounded_batches(docs.sparkSession)
    space = Workspace(docs.sparkSession, "leaks-drop")
    names = [f"_c{k}" for k in range(len(docs.columns))]
    rows, text = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)]), docs.columns.index("text")
    own = lambda df: df.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])

    def kept(leaked: bool, at: int):
        def run(shipped):
            def each(batches):
                import pyarrow as pa

                for batch in batches:
                    for k in range(0, batch.num_rows, 256):
                        part = batch.slice(k, 256)
                        found = {d for d, _ in leaks_in(shipped.value, part.column(at))}
                        taken = part.take(pa.array([d for d in range(part.num_rows) if (d in found) == leaked], pa.int64()))
                        yield taken.select([0]) if leaked else taken
                release()

            return each

        return run

    parts = _parts(benchmark)
    if len(parts) < 2:
        found = list(_passes(rows, parts, kept(False, text), rows.schema, names, space))
        return own(found[0] if found else rows)
    numbered = space.save(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    gone = docs.sparkSession.createDataFrame([], "_row long")
    for one in _passes(numbered, parts, kept(True, 1), "_row long", ["_row", names[text]], space):
        gone = gone.unionByName(one)
    return own(numbered.join(gone.distinct(), "_row", "left_anti"))
