"""Target-distribution importance resampling over hashed word n-grams.

A document's features are its runs of 1 to GRAMS consecutive words, hashed into BUCKETS buckets.
The log ratio of a bucket's share in the target texts to its share in the corpus is its gain, a
document's weight is the mean gain of its features, and the documents with the highest sums of
weight and Gumbel noise are drawn, which is drawing without replacement by weight.

Identical texts are collapsed by grouping the full text (partial groups in the map tasks, so a
text that a third of all rows hold is one row a task). Features are hashed once for each class
and written as sorted bucket numbers; the corpus counts multiply them by the class's number of
copies; the class's weight is joined back to its documents by the SHA-256 of the text, and only
then a document gets the noise of its own doc_id. Counts and gains are one row for each bucket.
The draw ranks by a range sort: a row's rank is its place in its range after the sizes of the
ranges before it, so no task sees all rows.

Defined cases: null or empty text, or one without a word, has no feature and weight 0; a very long
text is hashed whole; a null doc_id hashes as empty text and ranks behind others of its score;
rows that repeat a doc_id are scored and ranked each, ties by doc_id, then weight and features;
an empty table gives no rows; an empty target has no counts (every gain falls with the bucket's
corpus count); other columns are not read by importance_report, whatever their names, and kept
by importance_sample.
"""

from __future__ import annotations

import math
import zlib
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import Workspace, bounded_batches, ranked, release

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: ASCII digits and letters (lower-cased) and every byte of other characters make words.
_WORDS = bytes(c if chr(c).isalnum() and c < 0x80 or c >= 0x80 else 0x20 for c in range(256)).lower()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def feature_buckets(words: list[bytes]):
    """The bucket of every word and of every pair of neighbours, repeats included."""
    import numpy as np

    single = list(map(zlib.crc32, words))
    pairs = map(zlib.crc32, [b" " + w for w in words[1:]], single)  # a checksum goes on from the first word's
    return np.fromiter(chain(single, pairs), np.uint32, max(0, 2 * len(words) - 1)) % np.uint32(BUCKETS)


def _key(text):
    return F.unhex(F.sha2(text, 256))


def text_features(docs: DataFrame) -> DataFrame:
    """key, copies, n_words, buckets (sorted little-endian uint16) of each distinct text."""
    bounded_batches(docs.sparkSession)
    classes = docs.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.count(F.lit(1)).alias("copies"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            numbers, packed = [], []
            for text in batch.column(2).cast(pa.binary()):
                words = words_of(text.as_py())
                numbers.append(len(words))
                packed.append(np.sort(feature_buckets(words).astype("<u2"), kind="stable").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(numbers, pa.int64()), pa.array(packed, pa.binary())], names=["key", "copies", "n_words", "buckets"])
        release()

    return classes.select(_key(F.col("text")).alias("key"), "copies", "text").mapInArrow(run, "key binary, copies long, n_words long, buckets binary")


def bucket_counts(features: DataFrame):
    """Occurrences of each bucket, copies counted, as one array. A task adds up its own, then
    about the square root of the tasks' arrays meet in a task, and as many sums in the driver."""
    import numpy as np

    meet = max(1, math.isqrt(features.rdd.getNumPartitions()))
    schema = "part int, counts binary"

    def row(total):
        import pyarrow as pa
        from pyspark import TaskContext

        return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % meet], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for copies, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total += copies * np.bincount(np.frombuffer(packed.as_buffer(), "<u2"), minlength=BUCKETS)
        yield row(total)

    def add(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for packed in batch.column(1):
                total += np.frombuffer(packed.as_buffer(), np.int64)
        if total.any():
            yield row(total)

    sums = features.select("copies", "buckets").mapInArrow(count, schema).repartition(meet, "part").mapInArrow(add, schema)
    return sum((np.frombuffer(r["counts"], np.int64) for r in sums.select("counts").collect()), np.zeros(BUCKETS, np.int64))


def gains(corpus, target):
    """floor(1000 * log ratio) of each bucket, add-one smoothed."""
    import numpy as np

    s_all, t_all = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    ratio = lambda s, t: (t + 1.0) * s_all / ((s + 1.0) * t_all)
    return np.array([math.floor(1000 * math.log(ratio(float(s), float(t)))) for s, t in zip(corpus, target, strict=True)], np.int64)


def _weights(features: DataFrame, gain) -> DataFrame:
    shipped = features.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            number, weight = [], []
            for packed in batch.column(2):
                buckets = np.frombuffer(packed.as_buffer(), "<u2")
                number.append(len(buckets))
                weight.append(int(shipped.value[buckets].sum()) // len(buckets) if len(buckets) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(number, pa.int64()), pa.array(weight, pa.int64())], names=["key", "n_words", "n_features", "weight"])

    return features.select("key", "n_words", "buckets").mapInArrow(run, "key binary, n_words long, n_features long, weight long")


def noise(doc_id, seed: int):
    """Gumbel noise in thousandths, hashed from the seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def text_weights(space: Workspace, docs: DataFrame, target: DataFrame) -> DataFrame:
    """key, n_words, n_features, weight of each distinct text of docs, against the target's texts."""
    features = space.save(text_features(docs), "features")
    gain = gains(bucket_counts(features), bucket_counts(space.save(text_features(target), "target")))
    # written: the join then has an exchange on both sides, and a text of very many rows can be split
    return space.save(_weights(features, gain), "weights")


def importance_report(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null where undrawn) of every document."""
    space = Workspace(docs.sparkSession, "resample")
    weights = text_weights(space, docs, target)
    keys = docs.select("doc_id", _key(F.coalesce("text", F.lit(""))).alias("key"))
    scored = space.save(keys.join(weights, "key").select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score")), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    most = able.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()]
    placed = ranked(space, able, order, "ranked").withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    others = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(others).select("doc_id", "n_features", "weight", "score", "rank")


def importance_sample(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn documents with their own columns. Rows that repeat a doc_id stand or fall with
    the best ranked of them."""
    drawn = importance_report(docs, target, **how).where("rank is not null").select("doc_id").distinct()
    drawn = drawn.withColumnRenamed("doc_id", "_drawn")
    return docs.join(drawn, docs["doc_id"].eqNullSafe(drawn["_drawn"]), "left_semi")
