"""Change detection on a stream with keyed state: what is known of a path is in the state of its bucket.

An event is an observation of a path (content_hash, size_bytes, modified_time, last_ingested) or its
removal (content_hash null). A micro-batch reads and writes the states of its own paths' buckets
alone, wherever the manifest stands: Spark's work for a state is shared by all paths of a bucket, and a
bucket's text grows with the manifest (1 / BUCKETS of it). The state store checkpoints them by version, so a micro-batch that
runs again starts from the state before it and yields the same rows, which replace its own folder.
The manifest is read off the statuses: the newest row of each path.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from proofmill.sources import manifest

EVENT = ("content_hash", "size_bytes", "modified_time", "last_ingested")
STATUS = f"{manifest.ENTRY}, status string"
_STATE = "known string"
#: Buckets that paths are dealt into by hash, each of one state: a JSON object of its paths' hashes. A checkpoint keeps to its number.
BUCKETS = 4096


def _advance(key, frames, state):
    """Rows of one bucket of paths, each path's oldest first, against what is known of it: new, changed,
    unchanged, removed, or skipped (a removal of what is not there)."""
    import pandas as pd

    rows = []
    for frame in frames:
        rows += zip(*[[None if x is None or x != x else x for x in frame[c].tolist()] for c in ("source_path", *EVENT)], strict=True)
    rows.sort(key=lambda r: [(x is not None, x or "") for x in (r[0], r[4], r[3])])
    known, said = (json.loads(state.get[0]) if state.exists else {}), []
    for path, found, *_ in rows:
        before = known.get(path)
        if found is None:
            said.append("skipped" if before is None else "removed")
            known.pop(path, None)
        else:
            said.append("new" if before is None else "unchanged" if before == found else "changed")
            known[path] = found
    if known:
        state.update((json.dumps(known),))
    elif state.exists:
        state.remove()
    columns = [*map(list, zip(*rows, strict=True)), said]
    yield pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(("source_path", *EVENT, "status"), columns, strict=True)})


def statuses(events: DataFrame) -> DataFrame:
    """A streaming DataFrame of the events with their statuses."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    rows = events.where(F.col("source_path").isNotNull()).select("source_path", *EVENT).withColumn("size_bytes", F.col("size_bytes").cast("string")).withColumn("bucket", F.pmod(F.xxhash64("source_path"), F.lit(BUCKETS)))
    # sizes go as text: pandas has large ones beside nulls as rounded floats
    found = rows.groupBy("bucket").applyInPandasWithState(_advance, STATUS.replace("size_bytes long", "size_bytes string"), _STATE, "append", GroupStateTimeout.NoTimeout)
    return found.withColumn("size_bytes", F.col("size_bytes").cast("long"))


def follow(events: DataFrame, statuses_path: str, checkpoint: str) -> StreamingQuery:
    """Starts the stream over what is there; statuses of micro-batch n are in `v=<n>`."""

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{statuses_path}/v={number}")

    return statuses(events).writeStream.outputMode("append").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, statuses_path: str) -> DataFrame:
    """The manifest after the last micro-batch: the newest event of each path that was not removed."""
    rows = spark.read.schema(f"{STATUS}, v long").option("basePath", statuses_path).parquet(statuses_path)
    names = [c.split()[0] for c in manifest.ENTRY.split(", ")]
    newest = rows.groupBy("source_path").agg(F.max(F.struct("v", "last_ingested", "modified_time", "content_hash", "size_bytes", "status")).alias("n"))
    return newest.where("n.content_hash is not null").select("source_path", *[F.col(f"n.{c}").alias(c) for c in names[1:]])
