"""Shared helpers: durable intermediate tables, word rules, stable hashes."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Workers get these functions by value, so executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])

#: Words of every contract: maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Folders made where the setting is missing, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="proofmill-")
            context.setCheckpointDir(_OWN[context.applicationId])
        found = _OWN[context.applicationId]
    return found.rstrip("/")


#: Rows of an Arrow batch: texts are whole and long, and a worker holds a batch several times.
ARROW_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ARROW_ROWS rows; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def release() -> None:
    """Gives a worker's freed memory back to the system: workers live on after a task, idle ones
    beside the next stage's."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class Workspace:
    """Written tables of one operator call, under the shared folder.

    A written table cuts lineage: a lost executor costs a re-read, not a recomputation.
    Tables that the returned (lazy) result still reads go when the session ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bounded_batches(spark)
        self.path = f"{shared_dir(spark)}/proofmill-{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.drop)

    def _fs(self, path: str):
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(conf), at

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and return a reader of it."""
        out = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(out)
        return self.spark.read.schema(df.schema).parquet(out)

    def drop(self, name: str = "") -> None:
        try:
            fs, at = self._fs(f"{self.path}/{name}".rstrip("/"))
            fs.delete(at, True)
        except Exception:  # noqa: BLE001  the session may be gone; the files are scratch
            if name:
                raise


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table, over all cores where its files give fewer splits than that (one small file)."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def partitions(df: DataFrame) -> int:
    """As many tasks as the input has splits, and no fewer than the session's shuffle setting."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def ascii_lower(c):
    return F.translate(c, UPPER, LOWER)


def word_count(c):
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def fits(df: DataFrame, most_rows: int, most_bytes: int = 8 << 20) -> bool:
    """Whether df has at most this many rows and bytes of text, so that it may be broadcast."""
    total = F.lit(0)
    for c, t in df.dtypes:
        if t == "string":
            total = total + F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0))
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(total.cast("long")), F.lit(0))).first()
    return n <= most_rows and size <= most_bytes


def small(df: DataFrame, most_rows: int, most_bytes: int = 8 << 20):
    """The rows of df as a list if they are at most this many and this large, else None."""
    return df.collect() if fits(df, most_rows, most_bytes) else None


def ranked(space: Workspace, rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with `rank` (1, 2, 3 ...) in this order. They are dealt into sorted ranges and written; a
    row's rank is its place in its range, after the sizes of the ranges before it."""
    dealt = rows.repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order)
    kept = space.save(dealt.withColumn("_at", F.monotonically_increasing_id()), name)
    placed = kept.withColumn("_range", F.shiftright("_at", 33)).withColumn("_place", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(starts), "_range").withColumn("rank", F.col("_before") + F.col("_place") + 1).drop("_at", "_range", "_place", "_before")
