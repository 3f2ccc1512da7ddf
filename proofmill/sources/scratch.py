"""Folders for files that a query writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path on a file system that the driver opens by name: below spark.checkpoint.dir where
    that is set, else (local master only) a temporary folder that goes with the process."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return f"{found.removeprefix('file://').rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix=f"proofmill-{name}-")
    atexit.register(shutil.rmtree, made, True)
    return f"{made}/files"


def shared(spark: SparkSession, name: str) -> str:
    """A new path for tables, as a URI that driver and executors reach: below spark.checkpoint.dir
    where that is set, else (local master only) a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}" if found else f"file://{folder(spark, name)}"
