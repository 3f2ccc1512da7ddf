"""Line dedup over levelled sorted runs of line hashes [native].

A line's key is the line without ASCII white space at its ends, ASCII letters lower-cased; keys of
LEAST_CHARS code points or more count. A run is a table of key hashes sorted and bucketed by
hash, with the number of documents that hold the key and the largest doc_id among them. Documents
come in batches. A batch's own keys are first merge-anti-joined with the runs: where a run already
knows that a key is in enough documents and that a larger doc_id holds it, the batch has nothing
to add. What is left is the batch's own run, on level 0. FANOUT runs of a level are merged into
one of the next (numbers added, largest doc_id kept), so N batches make about log N levels and
a key is rewritten once a level. Buckets are the same in every run, so these joins move the
batch's keys only, never a run; a merge moves the runs that it merges.

When all batches are in, the runs are merged; keys in at least LEAST_DOCS documents are the common
ones, and a document's lines anti-join them: a line with a common key goes, unless the document
has the largest doc_id that holds it. Only (document, place) of lines that go are grouped; a text
is then cut once, row by row, by its list of places. Batches are ranges of doc_id from the top
down, so the runs know the largest holder of a key as early as possible; any other order gives
the same result.

Hashes are two 64-bit ones with different seeds (128 bits); equal hashes count as equal keys. A
line that a third of all documents hold is one row a task before it is shuffled, and in the last
join, whose sides are both written and exchanged, its rows can be split.

Defined cases: null or empty text is one empty line; a null doc_id ranks below all others and such
a row is a document; rows that repeat a doc_id with other texts count as documents each and keep or lose
the same keys, rows that repeat both are one; a key's repeats inside one text count once and go or stay together; a very long text or
line is read whole; an empty table gives no rows; extra columns are kept by drop_lines and not
read by line_report, whatever their names; a column named like a working one is no input.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.functions.text import staged
from proofmill.llm.common import Workspace, ascii_lower

LEAST_CHARS, LEAST_DOCS = 20, 3
#: Batches that a table is cut into, runs of a level that are merged, buckets of a run.
BATCHES, FANOUT = 4, 3
_BLANK = " \t\n\x0b\f\r"
_HASH = ["h1", "h2"]
#: Characters beyond ASCII that lower() changes are among these; without them it changes A-Z only, and is faster.
_OTHER_CASE = r"[[^\x00-\x7F]&&[\p{Lu}\p{Lt}\p{Nl}\p{So}]]"


def line_key(line) -> Column:
    cut = F.btrim(line, F.lit(_BLANK))
    return F.when(F.rlike(cut, F.lit(_OTHER_CASE)), ascii_lower(cut)).otherwise(F.lower(cut))


def _lines(text) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def long_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, mark (a hash of the text), h1, h2, place: a row for each line that counts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.posexplode(_lines(F.col("text"))).alias("place", "line"))
    key = line_key(F.col("line"))
    counted = rows.where(F.char_length(F.btrim("line", F.lit(_BLANK))) >= least_chars)  # lower-casing keeps the length
    return counted.select("doc_id", "mark", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"), "place")


@dataclass
class LineRuns:
    """The runs of line hashes, by level; each is a table (h1, h2, n_docs, last) sorted by hash."""

    spark: SparkSession
    path: str
    buckets: int
    least_docs: int = LEAST_DOCS
    fanout: int = FANOUT
    levels: list[list[str]] = field(default_factory=list)

    def _write(self, run: DataFrame, level: int) -> None:
        name = f"proofmill_run_{uuid.uuid4().hex[:12]}"
        sorted_run = run.repartition(self.buckets, *_HASH).write.bucketBy(self.buckets, *_HASH).sortBy(*_HASH)
        sorted_run.option("path", f"{self.path}/{name}").option("compression", "zstd").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _merged(self, names: list[str]) -> DataFrame:
        # read by path: a union of bucketed scans is taken for bucketed, and its groups stay parted
        rows = self.spark.read.schema(self.spark.table(names[0]).schema).parquet(*[f"{self.path}/{name}" for name in names])
        return rows.groupBy(*_HASH).agg(F.sum("n_docs").alias("n_docs"), F.max("last").alias("last"))

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> None:
        """Takes in a batch of long_lines()."""
        held = lines.select(*_HASH, "doc_id", "mark").distinct()  # a text's repeats of a key are one
        own = held.groupBy(*_HASH).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last"))
        for name in self.names():
            run = self.spark.table(name).where(F.col("n_docs") >= self.least_docs).select(*_HASH, F.col("last").alias("_last"))
            settled = own["last"].isNull() | (run["_last"] >= own["last"])
            own = own.join(run.hint("merge"), [own["h1"] == run["h1"], own["h2"] == run["h2"], settled], "left_anti")
        self._write(own, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """Merges the runs of a level into one of the next."""
        old, self.levels[level] = self.levels[level], []
        self._write(self._merged(old), level + 1)
        for name in old:
            self._drop(name)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def common(self) -> DataFrame:
        """h1, h2, last of the keys that at least least_docs documents hold."""
        names = self.names()
        if not names:
            return self.spark.createDataFrame([], "h1 long, h2 long, last long")
        return self._merged(names).where(F.col("n_docs") >= self.least_docs).select(*_HASH, "last")

    def drop(self) -> None:
        for name in self.names():
            self._drop(name)
        self.levels = []


def _batch(doc_id: Column, least, most, batches: int) -> Column:
    """The number of a row's batch: equal ranges of doc_id, the highest first, null last."""
    if least is None:
        return F.lit(batches - 1)
    width = float((int(most) - int(least)) // batches + 1)
    number = F.floor((F.lit(float(most)) - doc_id.cast("double")) / width)  # rounded for very large ids, so kept in range
    return F.coalesce(F.least(F.greatest(number, F.lit(0)), F.lit(batches - 1)).cast("int"), F.lit(batches - 1))


def lost_places(space: Workspace, docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT, buckets: int | None = None) -> DataFrame:
    """doc_id, mark, places: the places (from 0) of the lines that go, for each text that loses any."""
    spark = docs.sparkSession
    least, most = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
    dealt = long_lines(docs, least_chars).withColumn("batch", _batch(F.col("doc_id"), least, most, batches))
    at = f"{space.path}/lines"
    dealt.write.partitionBy("batch").option("compression", "zstd").parquet(at)
    lines = spark.read.schema(dealt.schema).parquet(at)
    runs = LineRuns(spark, f"{space.path}/runs", buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), least_docs, fanout)
    for number in range(batches):
        runs.add(lines.where(F.col("batch") == number))
    common = space.save(runs.common(), "common")
    runs.drop()
    # both joins are exchanged at every size, so that they cost and split alike
    found = lines.join(common.hint("merge"), _HASH).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    return space.save(found.groupBy("doc_id", "mark").agg(F.collect_set("place").alias("places")), "places")


def _cut(docs: DataFrame, places: DataFrame) -> DataFrame:
    """docs with _lines and _kept (the places that stay), joined by id and text hash."""
    own = places.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.col("places").alias("_places")).hint("shuffle_hash")
    on = docs["doc_id"].cast("long").eqNullSafe(own["_id"]) & (F.xxhash64(docs["text"]) == own["_mark"])
    cut = staged(docs.join(own, on, "left"), _lines=_lines(docs["text"]))
    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    return staged(cut, _kept=F.when(F.col("_places").isNull(), every).otherwise(F.array_except(every, "_places")))


def _joined() -> Column:
    return F.array_join(F.transform("_kept", lambda i: F.get(F.col("_lines"), i)), "\n")


def line_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    places = lost_places(Workspace(docs.sparkSession, "linededup"), docs, **how)
    cut = _cut(docs.select("doc_id", "text"), places)
    n_lines, n_kept = F.size("_lines").cast("long"), F.size("_kept")
    whole = F.coalesce(F.col("text"), F.lit(""))
    kept = F.when(F.col("_places").isNull(), whole).otherwise(_joined())
    return cut.select("doc_id", n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_dropped"), F.sha2(kept, 256).alias("kept_sha256"))


def drop_lines(docs: DataFrame, **how) -> DataFrame:
    """docs without the lines that go; a text that loses none stays as it is, null too."""
    places = lost_places(Workspace(docs.sparkSession, "linededup-drop"), docs, **how)
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    cut = _cut(packed, places)
    text = F.when(F.col("_places").isNull(), F.col("text")).otherwise(_joined())
    return cut.select(F.col("_row").withField("text", text).alias("_row")).select("_row.*")
