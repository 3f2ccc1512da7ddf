"""A chunk store of immutable files under a commit log: append, replace, delete, look up, time travel.

    data/commit=<id>/shard=<n>/*.parquet   chunks of one commit, dealt by a hash of the document
    gone/commit=<id>/*.parquet             tombstones: document_ids that one commit deletes
    log/<number>.json                      what version <number> adds, tombstones and removes

Files are written first and under names of their own; a version is the appearance of its log entry,
which either is made whole or not at all. Writers that want the same number meet there: one
gets it, the others look at what came between. Appends and deletes read nothing and take the
next number; a tombstone covers what versions before it added, so a replacement is one commit
of tombstones and new chunks. A compaction rewrites what it read, so it yields (Conflict) to a
commit that deleted or removed anything since. A crash leaves files that no entry names.
A deletion costs the deleted ids, whatever the shards hold; reads anti-join them.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = "number long, schema string, added array<string>, gone array<string>, removed array<string>"


class Conflict(RuntimeError):
    """A commit since the version that was read touches what this one rewrites."""


class ChunkStore:
    """Chunks (document_id, chunk_id and more) under one folder; a lookup reads one shard. Rows of
    other kinds can be kept under another `key` column."""

    def __init__(self, spark: SparkSession, path: str, shards: int = 64, key: str = "document_id"):
        self.spark, self.path, self.shards, self.key = spark, path.rstrip("/"), shards, key
        self._known: list = []  # log entries read so far, which never change

    def _shard(self, c) -> F.Column:
        return F.pmod(F.crc32(c), F.lit(self.shards)).cast("int")

    # the log

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def log(self) -> list:
        """The log's entries, oldest first; as many as there are commits. Numbers follow on each other, so
        only those after the last one known are looked for and read."""
        known = self._known
        if not known:
            fs, at = self._fs(f"{self.path}/log")
            if not fs.exists(at):
                return []
            known = sorted(self.spark.read.schema(ENTRY).json(f"{self.path}/log").collect(), key=lambda e: e["number"])
        new, number = [], 1 + max([0, *(e["number"] for e in known)])
        while True:
            fs, at = self._fs(f"{self.path}/log/{number + len(new):020d}.json")
            if not fs.exists(at):
                break
            new.append(at.toString())
        if new:
            known = [*known, *sorted(self.spark.read.schema(ENTRY).json(new).collect(), key=lambda e: e["number"])]
        self._known = known
        return list(known)

    def version(self) -> int:
        """The newest version; 0 is the empty store."""
        return max([0, *(e["number"] for e in self.log())])

    def _claim(self, number: int, entry: dict) -> bool:
        """Makes log entry `number`, unless it is there."""
        name, said = f"{self.path}/log/{number:020d}.json", json.dumps({"number": number, **entry})
        fs, at = self._fs(name)
        fs.mkdirs(at.getParent())
        aside = f"{self.path}/log/.{uuid.uuid4().hex}"
        if fs.getScheme() == "file":  # a local rename would replace, a link does not
            own, named = (self.spark._jvm.java.io.File(self._fs(p)[1].toUri().getPath()).getPath() for p in (aside, name))
            with open(own, "w") as f:
                f.write(said)
            try:
                os.link(own, named)
            except FileExistsError:
                return False
            finally:
                os.remove(own)
            return True
        jvm = self.spark._jvm
        out = fs.create(jvm.org.apache.hadoop.fs.Path(aside))
        out.write(said.encode())
        out.close()
        if fs.exists(at) or not fs.rename(jvm.org.apache.hadoop.fs.Path(aside), at):  # does not replace a file
            fs.delete(jvm.org.apache.hadoop.fs.Path(aside), False)
            return False
        return True

    def _commit(self, schema: str, added=(), gone=(), removed=(), read: int | None = None) -> int:
        """The version that the entry became; `read`: the one that its content was made from."""
        entry = {"schema": schema, "added": list(added), "gone": list(gone), "removed": list(removed)}
        while True:
            known = self.log()
            if read is not None:
                since = [e for e in known if e["number"] > read]
                if any(e["gone"] or set(e["removed"]) & set(removed) for e in since):
                    raise Conflict(f"version {read} was changed by {[e['number'] for e in since]}")
            number = 1 + max([0, *(e["number"] for e in known)])
            if self._claim(number, entry):
                return number

    # writing

    def _write(self, chunks: DataFrame) -> str:
        name = uuid.uuid4().hex
        # by hash, in pieces where there are more tasks than shards: finding ranges would make the chunks twice
        pieces = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.shards)
        dealt = chunks.withColumn("shard", self._shard(F.col(self.key))).repartition("shard", F.pmod(F.xxhash64(self.key), F.lit(pieces))).sortWithinPartitions("shard", self.key)
        dealt.write.partitionBy("shard").parquet(f"{self.path}/data/commit={name}")
        return name

    def _bury(self, ids: DataFrame) -> str:
        name = uuid.uuid4().hex
        ids.select(self.key).distinct().write.parquet(f"{self.path}/gone/commit={name}")
        return name

    def store(self, chunks: DataFrame) -> int:
        """Appends; the version it became."""
        return self._commit(chunks.schema.json(), added=[self._write(chunks)])

    def replace(self, chunks: DataFrame, ids: DataFrame | None = None) -> int:
        """Appends, and deletes what was there of the documents `ids` (the chunks' own), in one version."""
        name = self._write(chunks)
        own = self.spark.read.schema(f"{self.key} string").parquet(f"{self.path}/data/commit={name}") if ids is None else ids
        return self._commit(chunks.schema.json(), added=[name], gone=[self._bury(own)])

    def delete_documents(self, ids: DataFrame) -> int:
        """Deletes every row of the documents named in the key column."""
        return self._commit("", gone=[self._bury(ids)])

    def delete_document(self, document_id: str) -> int:
        return self.delete_documents(self.spark.range(1).select(F.lit(document_id).alias(self.key)))

    def compact(self) -> int:
        """Rewrites what is live as one commit without tombstones; raises Conflict if it came too late."""
        read = self.version()
        live, gone, schema = self._state(read)
        if schema is None or (len(live) < 2 and not gone):
            return read
        name = self._write(self.read(read))
        return self._commit(schema, added=[name], removed=[*live, *gone], read=read)

    def expire(self, oldest: int) -> list[str]:
        """Deletes the files that no version from `oldest` on reads; the folders that went."""
        needed, every = set(), set()
        for e in self.log():
            every |= {f"data/commit={n}" for n in e["added"]} | {f"gone/commit={n}" for n in e["gone"]}
            if e["number"] >= oldest:
                live, gone, _ = self._state(e["number"])
                needed |= {f"data/commit={n}" for n in live} | {f"gone/commit={n}" for n in gone}
        lost = sorted(n for n in every - needed if self._fs(f"{self.path}/{n}")[0].exists(self._fs(f"{self.path}/{n}")[1]))
        for n in lost:
            fs, at = self._fs(f"{self.path}/{n}")
            fs.delete(at, True)
        return lost

    # reading

    def _state(self, version: int | None = None) -> tuple[dict[str, int], dict[str, int], str | None]:
        """(chunk commits, tombstone commits) with the versions that made them, and the schema."""
        live, gone, schema = {}, {}, None
        for e in self.log():
            if version is not None and e["number"] > version:
                break
            for n in e["removed"]:
                live.pop(n, None)
                gone.pop(n, None)
            live |= dict.fromkeys(e["added"], e["number"])
            gone |= dict.fromkeys(e["gone"], e["number"])
            schema = e["schema"] or schema
        return live, gone, schema

    def _numbered(self, commits: dict[str, int], at: str) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame(list(commits.items()), f"commit string, {at} long"))  # a row for each commit

    def _live(self, version: int | None) -> DataFrame:
        live, gone, schema = self._state(version)
        if schema is None:
            raise ValueError(f"no chunks below {self.path}")
        fields = T.StructType.fromJson(json.loads(schema)).fields
        whole = T.StructType([*fields, T.StructField("commit", T.StringType()), T.StructField("shard", T.IntegerType())])
        if not live:
            return self.spark.createDataFrame([], whole)
        rows = self.spark.read.schema(whole).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/commit={n}" for n in live])
        if not gone:
            return rows
        tombs = self.spark.read.schema(f"{self.key} string, commit string").option("basePath", f"{self.path}/gone").parquet(*[f"{self.path}/gone/commit={n}" for n in gone])
        last = tombs.join(self._numbered(gone, "_gone_at"), "commit").groupBy(F.col(self.key).alias("_id")).agg(F.max("_gone_at").alias("_gone_at"))
        return rows.join(self._numbered(live, "_made_at"), "commit").join(last, (F.col(self.key) == F.col("_id")) & (F.col("_made_at") < F.col("_gone_at")), "left_anti")

    def read(self, version: int | None = None) -> DataFrame:
        """All chunks, of the newest version or as of an earlier one."""
        return self._live(version).drop("shard", "commit", "_made_at")

    def get(self, document_id: str, chunk_id: str, version: int | None = None) -> DataFrame:
        import zlib

        shard = zlib.crc32(document_id.encode()) % self.shards
        rows = self._live(version).where((F.col("shard") == shard) & (F.col("document_id") == document_id) & (F.col("chunk_id") == chunk_id))
        return rows.drop("shard", "commit", "_made_at")
