"""Filtered keyword and placeholder-vector retrieval, hybrid merge, ranking, traces.

Each branch is a top-(2 * top_k) of its own before the merge, which is part of the semantics: a
chunk outside one list scores 0 there. The built-in branches share one pass over the corpus: every
chunk is cut once, scored for both lists, and a grouped limit keeps each list's best in every
task before they meet. Other retrievers bring lists of their own, merged by an outer join.

Retrieval of one query goes in two phases: the first ranks chunk ids; the second fetches the texts
of the ranked rows, at most top_k for each weight, from their documents alone. Both are lazy;
`local` makes a result of up to LOCAL_ROWS rows a local relation, so that what is built on it
does not compute the retrieval again.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofmill.config import DUAL_CONTEXT, RAW_ONLY, TEXT_POLICIES, MetadataFilter, RetrievalRequest
from proofmill.functions import ids, text
from proofmill.operators import batch_scores

KEYS = ("document_id", "chunk_id")
#: Queries of a batch that meet the corpus at once.
QUERY_BLOCK = 5000
LOCAL_ROWS = 2000
#: What a branch contributes beside its score.
BRANCH = ("matched_fields", "retrieval_source", "source_retrievers", "score_policy")
CANDIDATE = (*KEYS, "chunk_index", "source_path", "source_type", "raw_text", "cleaned_text", "raw_text_hash", "cleaned_text_hash", "metadata")


class Retriever(Protocol):
    """Anything that scores a corpus; see keyword_hits for the result's columns."""

    def __call__(self, corpus: DataFrame, request: RetrievalRequest, policy: str, limit: int) -> DataFrame: ...


def apply_filter(corpus: DataFrame, chosen: MetadataFilter | None) -> DataFrame:
    """Rows equal in every set field; a missing metadata key does not match."""
    if chosen is None or chosen.is_empty():
        return corpus
    own = [F.col(n) == v for n, v in (("document_id", chosen.document_id), ("source_path", chosen.source_path), ("source_type", chosen.source_type)) if v is not None]
    keyed = [F.try_element_at(F.col("metadata"), F.lit(k)) == v for k, v in chosen.key_value.items()]
    return corpus.where(reduce(lambda a, b: a & b, own + keyed))


def _hits(df: DataFrame, keyword: Column, vector: Column, fields: Column, name: str, policy: str) -> DataFrame:
    own = [F.col(c) for c in CANDIDATE]
    return df.select(
        *own, keyword.alias("keyword_score"), vector.alias("vector_score"), fields.alias("matched_fields"),
        F.lit(name).alias("retrieval_source"), F.array(F.lit(name)).alias("source_retrievers"), F.lit(policy).alias("score_policy"),
    )


def matched_fields(policy: str, wanted: Column) -> Column:
    """Text fields that hold a query token, of those the policy searches."""
    has = lambda c: F.arrays_overlap(text.tokens(F.coalesce(F.col(c), F.lit(""))), wanted)
    names = {RAW_ONLY: ["raw_text"], DUAL_CONTEXT: ["raw_text", "cleaned_text"]}.get(policy, ["cleaned_text"])
    return F.filter(F.array(*[F.when(has(n), F.lit(n)) for n in names]), lambda n: n.isNotNull())


def query_tokens(query: str) -> list[str]:
    import re

    return re.findall("[a-z0-9]+", query.lower())


def keyword_hits(corpus: DataFrame, request: RetrievalRequest, policy: str, limit: int) -> DataFrame:
    wanted = query_tokens(request.query)
    rows = apply_filter(corpus, request.filters)
    if not wanted:
        return _hits(rows.where(F.lit(False)), F.lit(0.0), F.lit(0.0), F.array().cast("array<string>"), "keyword", "token_frequency")
    low, times = text.searched(policy, F.col("raw_text"), F.col("cleaned_text"))
    read = text.staged(text.staged(rows, _low=low, _k=times), _t=text.tokens(F.col("_low"), lowered=True))
    hit = text.staged(read, _n=F.size("_t"), _p=text.among(F.col("_t"), wanted)).drop("_low", "_t").where(F.size("_p") > 0)
    scored = text.staged(hit, _s=text.term_score(wanted, F.col("_p"), F.col("_n"), F.col("_k")))
    top = scored.drop("_k", "_n", "_p").orderBy(F.desc("_s"), *KEYS).limit(limit)
    return _hits(top, F.col("_s"), F.lit(0.0), matched_fields(policy, F.array(*[F.lit(t) for t in wanted])), "keyword", "token_frequency")


def vector_hits(corpus: DataFrame, request: RetrievalRequest, policy: str, limit: int) -> DataFrame:
    """The placeholder: a hash of query and chunk id; texts and policy play no part."""
    scored = apply_filter(corpus, request.filters).withColumn("_s", text.hash_score(F.lit(request.query), F.col("chunk_id")))
    top = scored.orderBy(F.desc("_s"), *KEYS).limit(limit)
    return _hits(top, F.lit(0.0), F.col("_s"), F.array().cast("array<string>"), "vector_placeholder", "deterministic_placeholder")


def embedding_hits(vectors: DataFrame, query: list[float], limit: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """An extra retriever: cosine top-k over an array column, with built-ins only."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.transform(column, lambda x: x.cast("double"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    score = dot(v, q) / F.nullif(F.sqrt(dot(v, v)) * F.sqrt(dot(q, q)), F.lit(0.0))
    return vectors.select(key, F.coalesce(score, F.lit(0.0)).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def merge(keyword: DataFrame, vector: DataFrame, alphas: tuple[float, ...]) -> DataFrame:
    """Full outer join of two short lists on the chunk, without texts; a row for each alpha."""
    keys = list(KEYS)
    side = lambda df, s, score: df.select(*keys, F.struct(score, *BRANCH).alias(s))
    both = side(keyword, "k", "keyword_score").join(side(vector, "v", "vector_score"), keys, "full_outer")
    k, v = F.col("k"), F.col("v")
    two = k.isNotNull() & v.isNotNull()
    pick = lambda c: F.when(k.isNotNull(), k[c]).otherwise(v[c])
    kw, vec = F.coalesce(k["keyword_score"], F.lit(0.0)), F.coalesce(v["vector_score"], F.lit(0.0))
    none = F.array().cast("array<string>")
    scores = [F.struct(F.lit(a).alias("alpha"), (F.lit(a) * vec + F.lit(1 - a) * kw).alias("hybrid_score")) for a in alphas]
    return both.select(
        *keys, kw.alias("keyword_score"), vec.alias("vector_score"), F.inline(F.array(*scores)),
        F.when(two, F.lit("hybrid")).otherwise(pick("score_policy")).alias("score_policy"),
        F.array_sort(F.array_union(F.coalesce(k["matched_fields"], none), F.coalesce(v["matched_fields"], none))).alias("matched_fields"),
        F.when(two, F.lit("hybrid")).otherwise(pick("retrieval_source")).alias("retrieval_source"),
        F.array_distinct(F.concat(F.coalesce(k["source_retrievers"], none), F.coalesce(v["source_retrievers"], none))).alias("source_retrievers"),
    )


def local(df: DataFrame) -> DataFrame:
    """A short result as a local relation; one of more than LOCAL_ROWS rows stays as it is."""
    rows = df.limit(LOCAL_ROWS + 1).repartition(1).collect()  # all tasks at once, where take() would go on from a few
    return df if len(rows) > LOCAL_ROWS else df.sparkSession.createDataFrame(rows, df.schema)


def top_lists(scores: DataFrame, limit: int, *by: str) -> DataFrame:
    """The `limit` best rows (score, KEYS) of each group; every task keeps only its own best."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), *KEYS)
    return scores.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).drop("_r")


def built_in_lists(corpus: DataFrame, request: RetrievalRequest, policy: str, limit: int) -> DataFrame:
    """The keyword and vector lists of one pass, by chunk: keyword_score, vector_score, null outside a list."""
    wanted = query_tokens(request.query)
    rows = apply_filter(corpus, request.filters)
    vector = F.struct(F.lit("vector").alias("list"), text.hash_score(F.lit(request.query), F.col("chunk_id")).alias("score"))
    if wanted:
        low, times = text.searched(policy, F.col("raw_text"), F.col("cleaned_text"))
        read = text.staged(text.staged(rows, _low=low, _k=times).select(*KEYS, "_low", "_k"), _t=text.tokens(F.col("_low"), lowered=True))
        seen = text.staged(read, _n=F.size("_t"), _p=text.among(F.col("_t"), wanted))
        score = F.when(F.size("_p") > 0, text.term_score(wanted, F.col("_p"), F.col("_n"), F.col("_k")))
        scored = seen.select(*KEYS, F.inline(F.array(vector, F.struct(F.lit("keyword").alias("list"), score.alias("score")))))
    else:
        scored = rows.select(*KEYS, F.inline(F.array(vector)))
    best = top_lists(scored.where(F.col("score").isNotNull()), limit, "list")
    of = lambda name: F.max(F.when(F.col("list") == name, F.col("score"))).alias(f"{name}_score")
    return best.groupBy(*KEYS).agg(of("keyword"), of("vector"))


def keyword_lists(corpus: DataFrame, request: RetrievalRequest, policies: tuple[str, ...], limit: int) -> DataFrame:
    """policy, KEYS, keyword_score, matched_fields: what keyword_hits finds under each policy, from one pass.

    Every chunk is cut, refined and read once: its raw tokens are its cleaned ones where refinement only
    trimmed it, and both together otherwise. A task keeps each list's best rows, without texts.
    """
    wanted = query_tokens(request.query)
    rows = apply_filter(corpus, request.filters)
    if not wanted:
        return rows.where(F.lit(False)).select(F.lit("").alias("policy"), *KEYS, F.lit(0.0).alias("keyword_score"), F.array().cast("array<string>").alias("matched_fields"))
    raw, cleaned = (F.coalesce(F.col(c), F.lit("")) for c in ("raw_text", "cleaned_text"))
    low = text.staged(rows.select(*KEYS, raw.alias("_r"), cleaned.alias("_c")), _same=text.trimmed(F.col("_r")) == F.col("_c"), _l=F.lower("_r"))
    counts = lambda p: F.when(F.size(p) > 0, text.occurrences(wanted, p))  # noqa: E731  null where no query token is
    read = lambda c: F.struct(text.let(text.present(c, wanted), counts).alias("c"), text.count_tokens(c).alias("n"))
    one = text.staged(low, _a=read(F.col("_l"))).select(*KEYS, "_same", "_a", "_c")
    two = text.staged(one, _b=F.when(F.col("_same"), F.col("_a")).otherwise(text.let(F.lower("_c"), read))).drop("_c")
    a, b, same = F.col("_a"), F.col("_b"), F.col("_same")
    together = F.when(a["c"].isNull(), b["c"]).when(b["c"].isNull(), a["c"]).otherwise(F.zip_with(a["c"], b["c"], lambda x, y: x + y))
    both = (F.when(same, a["c"]).otherwise(together), F.when(same, a["n"]).otherwise(a["n"] + b["n"]), F.when(same, F.lit(2)).otherwise(F.lit(1)))
    fields = {RAW_ONLY: [("raw_text", a)], DUAL_CONTEXT: [("raw_text", a), ("cleaned_text", b)]}

    def scored(policy: str) -> Column:
        found, length, times = {RAW_ONLY: (a["c"], a["n"], F.lit(1)), "cleaned_only": (b["c"], b["n"], F.lit(1))}.get(policy, both)
        names = F.filter(F.array(*[F.when(x["c"].isNotNull(), F.lit(name)) for name, x in fields.get(policy, [("cleaned_text", b)])]), lambda n: n.isNotNull())
        score = F.when(found.isNotNull(), text.counted_score(found, length, times))
        return F.struct(F.lit(policy).alias("policy"), score.alias("score"), names.alias("matched_fields"))

    hit = two.where(a["c"].isNotNull() | b["c"].isNotNull())
    each = hit.select(*KEYS, F.inline(F.array(*[scored(p) for p in policies]))).where(F.col("score").isNotNull())
    return top_lists(each, limit, "policy").withColumnRenamed("score", "keyword_score")


def merge_lists(lists: DataFrame, alphas: tuple[float, ...]) -> DataFrame:
    """What merge() makes of the built-in lists, but for matched_fields, which need the texts."""
    k, v = F.col("keyword_score").isNotNull(), F.col("vector_score").isNotNull()
    kw, vec = F.coalesce("keyword_score", F.lit(0.0)), F.coalesce("vector_score", F.lit(0.0))
    scores = [F.struct(F.lit(a).alias("alpha"), (F.lit(a) * vec + F.lit(1 - a) * kw).alias("hybrid_score")) for a in alphas]
    names = F.filter(F.array(F.when(k, F.lit("keyword")), F.when(v, F.lit("vector_placeholder"))), lambda n: n.isNotNull())
    return lists.select(
        *KEYS, kw.alias("keyword_score"), vec.alias("vector_score"), F.inline(F.array(*scores)),
        F.when(k & v, F.lit("hybrid")).when(k, F.lit("token_frequency")).otherwise(F.lit("deterministic_placeholder")).alias("score_policy"),
        F.when(k & v, F.lit("hybrid")).otherwise(F.element_at(names, 1)).alias("retrieval_source"), names.alias("source_retrievers"),
    )


def with_texts(corpus: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with the other candidate columns of their chunks. The semi-join on the document goes
    below the chunking, so only the rows' documents are chunked and refined."""
    near = corpus.select(*CANDIDATE).join(F.broadcast(rows.select("document_id").distinct()), "document_id", "left_semi")
    return near.join(F.broadcast(rows), list(KEYS))


def ranked(merged: DataFrame, top_k: int, by: tuple[str, ...] = ()) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("hybrid_score"), F.desc("keyword_score"), F.desc("vector_score"), *KEYS)
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def retrieve(corpus: DataFrame, request: RetrievalRequest, policy: str = DUAL_CONTEXT, keyword: Retriever = keyword_hits, vector: Retriever = vector_hits, alphas: tuple[float, ...] = ()) -> DataFrame:
    """Ranked results of one query with scores, provenance and audit columns.

    The request's text policy overrides the pipeline's and reaches the keyword side only.
    `alphas` ranks the same two lists under several weights instead of the request's one.
    """
    request.check()
    effective, limit = request.text_policy or policy, 2 * request.top_k
    weights = alphas or (request.alpha,)
    built_in = keyword is keyword_hits and vector is vector_hits
    if built_in:
        merged = merge_lists(built_in_lists(corpus, request, effective, limit), weights)
    else:
        merged = merge(keyword(corpus, request, effective, limit), vector(corpus, request, effective, limit), weights)
    total = merged.withColumn("total_candidates", F.count(F.lit(1)).over(Window.partitionBy("alpha")))
    filters = request.filters.describe() if request.filters else []
    audit = {
        "query": F.lit(request.query), "query_hash": F.lit(ids.text_hash(request.query)), "retrieval_run_id": F.lit(request.retrieval_run_id or f"run_{ids.text_hash(request.query)[:16]}"),
        "text_policy": F.lit(effective), "applied_filters": F.array(*[F.lit(f) for f in filters]).cast("array<string>"),
    }
    found = with_texts(corpus, ranked(total, request.top_k, ("alpha",)))
    if built_in:
        wanted = F.array(*[F.lit(t) for t in query_tokens(request.query)]).cast("array<string>")
        fields = F.array_sort(matched_fields(effective, wanted))
        found = found.withColumn("matched_fields", F.when(F.array_contains("source_retrievers", "keyword"), fields).otherwise(F.array().cast("array<string>")))
    return found.withColumns(audit)


class HybridPipeline:
    """A corpus with its retrievers and a default text policy; a request's own policy wins."""

    def __init__(self, corpus: DataFrame, policy: str = DUAL_CONTEXT, keyword: Retriever = keyword_hits, vector: Retriever = vector_hits):
        self.corpus, self.policy, self.keyword, self.vector = corpus, policy, keyword, vector

    def retrieve(self, request: RetrievalRequest, alphas: tuple[float, ...] = ()) -> DataFrame:
        return retrieve(self.corpus, request, self.policy, self.keyword, self.vector, alphas)


def create_pipeline(corpus: DataFrame, text_policy: str | None = None) -> HybridPipeline:
    """A pipeline of the built-in retrievers."""
    return HybridPipeline(corpus, text_policy or DUAL_CONTEXT)


def request_problems(requests: DataFrame) -> DataFrame:
    """requests (query, top_k, alpha, text_policy and more) with `problems`, what RetrievalRequest.problems() says of each."""
    known = F.col("text_policy").isin(*TEXT_POLICIES)
    checks = [
        (text.strip(F.coalesce("query", F.lit(""))) == "", F.lit("query must not be empty")), (F.col("top_k") < 1, F.lit("top_k must be >= 1")),
        (~F.col("alpha").between(0.0, 1.0), F.lit("alpha must be between 0.0 and 1.0")), (~known, F.concat(F.lit("unknown text_policy: "), F.col("text_policy"))),
    ]
    return requests.withColumn("problems", F.filter(F.array(*[F.when(bad, said) for bad, said in checks]), lambda p: p.isNotNull()))


def best_lists(rows: DataFrame, queries: DataFrame, limit: int, vector: bool = True, keyword: bool = True) -> DataFrame:
    """query_id, KEYS, list, score: the best chunks of each query in every task, for top_lists to end.

    rows: KEYS and, for the keyword side, `low` (searched text, lower-cased) and `times` (how often it
    counts). One pass: a task holds the queries of a block and, for each, its `limit`
    best chunks so far, so neither pairs nor tokens are shuffled or sorted. Gains of a
    batch's tokens times the queries' counts of them give its keyword scores; the vector score of
    every pair is hashed. A chunk that ties with a list's last one is kept as long as its keys are less.
    """
    asked = queries.select("query_id", "query", text.tokens(F.coalesce("query", F.lit(""))).alias("tokens")).collect()  # a block at most
    ids_, texts = [r["query_id"] for r in asked], [r["query"] for r in asked]
    wanted: dict[str, list[tuple[int, int]]] = {}
    for at, r in enumerate(asked):
        for token, n in Counter(r["tokens"]).items():
            wanted.setdefault(token, []).append((at, n))
    shared = rows.sparkSession.sparkContext.broadcast((texts, wanted))
    kind = queries.schema["query_id"].dataType
    sides = [s for s, on in (("keyword", keyword), ("vector", vector)) if on]

    def run(batches):
        lists = {side: batch_scores.Best(len(shared.value[0]), limit) for side in sides}
        scorer = batch_scores.Scorer(*shared.value)
        for batch in batches:
            scorer.add(batch, lists)
        for side, best in lists.items():
            yield from best.batches(side)

    found = rows.mapInArrow(run, "at int, document_id string, chunk_id string, list string, score double")
    names = rows.sparkSession.createDataFrame(list(enumerate(ids_)), T.StructType([T.StructField("at", T.IntegerType()), T.StructField("query_id", kind)]))
    return found.join(F.broadcast(names), "at").select("query_id", *KEYS, "list", "score")


def batch_lists(corpus: DataFrame, queries: DataFrame, limit: int, policy: str = DUAL_CONTEXT, vector: bool = True, keyword: bool = True) -> DataFrame:
    """query_id, KEYS, list, score: both lists of every query, a block of queries at a time."""
    low, times = text.searched(policy, F.col("raw_text"), F.col("cleaned_text"))
    rows = corpus.select(*KEYS, low.alias("low"), times.alias("times")) if keyword else corpus.select(*KEYS)
    blocks = -(-queries.count() // QUERY_BLOCK) or 1
    parts = [best_lists(rows, queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else queries, limit, vector, keyword) for b in range(blocks)]
    return top_lists(reduce(DataFrame.unionByName, parts), limit, "query_id", "list")


def batch_keyword(corpus: DataFrame, queries: DataFrame, limit: int, policy: str = DUAL_CONTEXT) -> DataFrame:
    """query_id, KEYS, score: the keyword list of each query. Sums are rounded to 12 digits, as their
    order is not fixed."""
    return batch_lists(corpus, queries, limit, policy, vector=False).drop("list")


def retrieve_batch(corpus: DataFrame, queries: DataFrame, top_k: int = 5, alpha: float = 0.5, policy: str = DUAL_CONTEXT, keyword: DataFrame | None = None) -> DataFrame:
    """retrieve() for many queries (query_id, query) at once; `keyword` are their keyword lists, where
    an index has them.

    The vector side scores every chunk for every query, which is what the placeholder means. Texts
    are not in the result; see StoredIndex.results.
    """
    lists = batch_lists(corpus, queries, 2 * top_k, policy, keyword=keyword is None)
    if keyword is not None:
        lists = lists.unionByName(keyword.select("query_id", *KEYS, F.lit("keyword").alias("list"), "score"))
    of = lambda name: F.coalesce(F.max(F.when(F.col("list") == name, F.col("score"))), F.lit(0.0)).alias(f"{name}_score")
    both = lists.groupBy("query_id", *KEYS).agg(of("keyword"), of("vector"))
    scored = both.withColumn("hybrid_score", F.lit(alpha) * F.col("vector_score") + F.lit(1 - alpha) * F.col("keyword_score"))
    return ranked(scored, top_k, ("query_id",))


def holding(docs: DataFrame, items: DataFrame, run: int = 5) -> DataFrame:
    """query_id, document_id: the documents whose raw_text contains an item's text (query_id, item).

    A document that contains an item holds the item's inner words, so the two meet on a run of these:
    that of an item's which the fewest documents hold. Only documents' runs that are an item's
    are shuffled. Items of too few words meet on a single inner word, and those without one are
    looked for in every text.
    """
    words = lambda c: F.split(c, r"[ \n]+")  # noqa: E731  what surrounds an item touches its first and last word only
    inner = lambda w: F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0)))
    runs = lambda w, n: F.when(F.size(w) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))))
    known = text.staged(items.select("query_id", "item"), w=inner(words(F.col("item"))))
    own = known.select("query_id", "item", F.explode(F.coalesce(runs(F.col("w"), run), runs(F.col("w"), 1))).alias("key"))
    read = text.staged(docs.select("document_id", "raw_text"), w=words(F.col("raw_text"))).select("document_id", F.explode(F.array_distinct(F.concat(F.coalesce(runs(F.col("w"), run), F.array().cast("array<string>")), F.coalesce(runs(F.col("w"), 1), F.array().cast("array<string>"))))).alias("key"))
    met = read.join(own.select("key").distinct(), "key", "left_semi")
    held = met.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    rare = own.join(held, "key", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "key")).alias("r"), F.first("item").alias("item"))
    near = met.join(rare.select("query_id", "item", F.col("r.key").alias("key")), "key").join(docs.select("document_id", "raw_text"), "document_id")
    short = known.where(F.size("w") == 0).select("query_id", "item")
    every = docs.select("document_id", "raw_text").join(short, F.contains(F.col("raw_text"), F.col("item")))
    return near.where(F.contains(F.col("raw_text"), F.col("item"))).select("query_id", "document_id").unionByName(every.select("query_id", "document_id"))


def quality(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """recall, precision and reciprocal rank at k per query; relevant: query_id, document_id."""
    truth = relevant.select("query_id", "document_id").distinct().withColumn("hit", F.lit(1))
    found = results.where(F.col("rank") <= k).groupBy("query_id", "document_id").agg(F.min("rank").alias("rank")).join(truth, ["query_id", "document_id"])
    per = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"))
    wanted = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
    hits = F.coalesce("hits", F.lit(0))
    return wanted.join(per, "query_id", "left").select("query_id", (hits / F.col("wanted")).alias("recall"), (hits / F.lit(k)).alias("precision"), F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))
