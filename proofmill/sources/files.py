"""Files as documents: listing, strict decoding, ingest with statuses."""

from __future__ import annotations

import os
import re
import uuid
from contextlib import contextmanager
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.functions import ids
from proofmill.sources import scratch

#: Directories that a listing never enters.
IGNORED = (
    ".git", "__pycache__", ".pytest_cache", ".venv", "venv", "node_modules", "data", "storage", "uploads",
    "documents", "indexes", "vector_store", "vector-db", "chroma", "qdrant_storage", "lancedb",
)


def list_files(root: str) -> list[tuple[str, str]]:
    """(path, disposition) of every file below root: ingest, or skipped (hidden or unsupported).

    Spark's own listing hides names that start with `_` or `.`, so names are listed on the driver;
    ignored and hidden directories below the root are not entered.
    """
    found = []
    for folder, folders, files in os.walk(root):
        folders[:] = sorted(d for d in folders if d not in IGNORED and not d.startswith("."))
        for name in sorted(files):
            good = not name.startswith(".") and Path(name).suffix.lower() in (".txt", ".md", ".markdown")
            found.append((os.path.join(folder, name), "ingest" if good else "skipped"))
    return found


def normalize(path: str, base: str | None = None) -> str:
    """Resolved path, relative to `base` (the working directory) where it lies below, with `/`."""
    full, root = Path(path).resolve(), Path(base or os.getcwd()).resolve()
    return (full.relative_to(root) if full.is_relative_to(root) else full).as_posix()


def below(spark: SparkSession, root: str, keep, enter=lambda entry: True) -> DataFrame:
    """path: the files below root that `keep` takes. Folders are listed by tasks, level by level, into a
    scratch table; those that `enter` refuses are passed over. Both get the os.DirEntry."""
    os.scandir(root).close()  # a missing root fails here
    root = os.path.abspath(root)  # tasks have working directories of their own
    at, schema = scratch.shared(spark, "listed"), "path string, folder boolean"

    def look(batches):
        import pyarrow as pa

        rows: list[tuple[str, bool]] = []
        table = lambda: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_())], names=["path", "folder"])
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                with os.scandir(folder) as entries:
                    for e in entries:
                        if enter(e) if e.is_dir() else keep(e):
                            rows.append((e.path, e.is_dir()))
                        if len(rows) == 10_000:
                            yield table()
                            rows = []
        yield table()

    level, folders = 0, spark.createDataFrame([(root,)], "path string")
    while True:
        folders.mapInArrow(look, schema).write.parquet(f"{at}/{level}")
        folders = spark.read.schema(schema).parquet(f"{at}/{level}").where("folder").select("path")
        if folders.isEmpty():
            break
        folders, level = dealt(folders, "path"), level + 1
    return spark.read.schema(schema).parquet(*[f"{at}/{n}" for n in range(level + 1)]).where("not folder").select("path")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows over all tasks by a hash of the key: short rows that stand for much work, such as paths."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


#: How names of files begin that are being written.
WRITING = ".writing-"


@contextmanager
def placed(path: str):
    """A name beside `path` to write to, which then becomes `path`: a task that is killed or runs twice
    leaves no half file under it. Errors name `path`."""
    if os.path.islink(path):
        path = os.path.realpath(path)
    aside = os.path.join(os.path.dirname(path), f"{WRITING}{uuid.uuid4().hex}")
    try:
        yield aside
        os.replace(aside, path)
    except OSError as e:
        if os.path.exists(aside):
            os.remove(aside)
        raise OSError(e.errno, e.strerror, path if e.filename in (None, aside) else e.filename) from e


BINARY = "file_path string, modificationTime timestamp, length long, content binary"


#: Bytes of files that a task holds at once, beyond the last one.
_HELD = 16 << 20


def _read(batches):
    """BINARY rows of the files named in the first column, under their resolved paths."""
    import pyarrow as pa

    def table(found):
        times = pa.array([int(s.st_mtime * 1_000_000) for _, s, _ in found], pa.timestamp("us", tz="UTC"))
        return pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in found], pa.string()), times, pa.array([len(c) for _, _, c in found], pa.int64()), pa.array([c for _, _, c in found], pa.binary())], names=["file_path", "modificationTime", "length", "content"])

    folders: dict[str, str] = {}
    for batch in batches:
        found, held = [], 0
        for p in batch.column(0).to_pylist():
            folder, name = os.path.split(p)
            if folder not in folders:
                folders[folder] = os.path.realpath(folder)
            full = os.path.realpath(p) if os.path.islink(p) else os.path.join(folders[folder], name)
            found.append((full, os.stat(full), Path(full).read_bytes()))
            held += len(found[-1][2])
            if held > _HELD:
                yield table(found)
                found, held = [], 0
        yield table(found)


def open_files(paths: DataFrame) -> DataFrame:
    """BINARY rows of the files of a table of paths (first column), opened by all tasks."""
    return dealt(paths, paths.columns[0]).mapInArrow(_read, BINARY)


def read_binary(spark: SparkSession, paths: list[str]) -> DataFrame:
    """BINARY rows of exactly these files. Spark's readers pass over names that start with `_`,
    even when named, so those are opened by tasks of their own."""
    full = [str(Path(p).resolve()) for p in paths]
    hidden = [p for p in full if Path(p).name.startswith(("_", "."))]
    literal = ["file://" + re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in full if p not in set(hidden)]
    out = spark.createDataFrame([], BINARY)
    if literal:
        coded = F.replace(F.regexp_replace("_metadata.file_path", "^file:/+", "/"), F.lit("+"), F.lit("%2B"))
        out = spark.read.format("binaryFile").load(literal).select(F.url_decode(coded).alias("file_path"), "modificationTime", "length", "content")
    if hidden:
        out = out.unionByName(spark.createDataFrame([(p,) for p in hidden], "p string").mapInArrow(_read, BINARY))
    return out


def load_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """source_path, raw_text, sizes and times; text that is not UTF-8 has status error, not a failed job."""
    raw = read_binary(spark, paths)
    content = F.col("content").cast("string")
    valid = F.is_valid_utf8(content)
    return raw.select(
        F.col("file_path").alias("source_path"), F.when(valid, content).alias("raw_text"), F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size_bytes"),
        F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("modified_time"), F.when(~valid, F.lit("error")).alias("failure"),
    )


def ingest(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """Every file below root with its document id and status against the manifest."""
    listed = list_files(root) if os.path.isdir(root) else [(root, "ingest" if Path(root).suffix.lower() in (".txt", ".md", ".markdown") else "skipped")]
    names = {str(Path(p).resolve()): normalize(p) for p, d in listed if d == "ingest"}
    keys = spark.createDataFrame(list(names.items()) or [("", "")], "full string, named string")
    loaded = load_files(spark, list(names)).join(keys, F.col("source_path") == F.col("full")).withColumn("source_path", F.col("named")).drop("full", "named")
    known = manifest.select("source_path", F.col("content_hash").alias("_known"))
    status = F.coalesce("failure", F.when(F.col("_known").isNull(), F.lit("new")).when(F.col("_known") == F.col("content_hash"), F.lit("unchanged")).otherwise(F.lit("changed")))
    done = loaded.join(known, "source_path", "left").withColumn("status", status).drop("_known", "failure")
    done = done.withColumns({"document_id": F.when(F.col("status") != "error", ids.document_id(F.col("source_path"), F.col("content_hash"))), "source_type": ids.source_type(F.col("source_path")), "last_ingested": F.lit(datetime.now(timezone.utc).isoformat())})
    skipped = [(normalize(p), "skipped") for p, d in listed if d == "skipped"]
    if not skipped:
        return done
    return done.unionByName(spark.createDataFrame(skipped, "source_path string, status string"), allowMissingColumns=True)
