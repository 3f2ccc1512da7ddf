"""Cited Markdown notes: identity, labels, rendering, validation, strict export checks, writing.

A note is one row (NOTE); rendering is built-in functions over its arrays, one text per row.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.config import Branding
from proofmill.functions import ids, text
from proofmill.sources import files, scratch

REF = "struct<label:string,document_id:string,chunk_id:string,source_path:string,source_raw_hash:string,raw_text_hash:string,evidence_text_hash:string,excerpt:string>"
NOTE = (
    f"note_id string, title string, summary string, claims array<struct<statement:string,evidence_refs:array<{REF}>,unsupported:boolean>>, source_evidence array<{REF}>, "
    "metadata struct<note_id:string,note_type:string,status:string,generated_at:string,generated_by:string,generator_version:string,schema_version:string,source_policy:string,"
    "validation_status:string,confidence:string,evidence_count:int,source_documents:array<struct<document_id:string,source_path:string,source_raw_hash:string,content_hash:string>>,"
    "source_chunks:array<struct<document_id:string,chunk_id:string,source_raw_hash:string,raw_text_hash:string,cleaned_text_hash:string,evidence_text_hash:string>>>"
)
FIELDS = ("document_id", "chunk_id", "source_path", "source_raw_hash", "raw_text_hash", "evidence_text_hash", "excerpt")


def _some(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def identity(ref: Column) -> Column:
    """The key by which references are one: chunk, evidence text, source, else label and excerpt."""
    key = lambda kind, a, b: F.concat_ws("\x1f", F.lit(kind), F.coalesce(ref[a], F.lit("")), F.coalesce(ref[b], F.lit("")))
    doc = _some(ref["document_id"])
    return (
        F.when(doc & _some(ref["chunk_id"]), key("chunk", "document_id", "chunk_id"))
        .when(doc & _some(ref["evidence_text_hash"]), key("document-evidence", "document_id", "evidence_text_hash"))
        .when(doc & _some(ref["source_raw_hash"]), key("document-source", "document_id", "source_raw_hash"))
        .otherwise(key("label-excerpt", "label", "excerpt"))
    )


def merged_refs(claims: Column, evidence: Column) -> Column:
    """One entry per identity, claim references first; each field is the first non-empty one."""
    every = F.concat(F.flatten(F.transform(claims, lambda c: c["evidence_refs"])), evidence)
    keyed = F.transform(every, lambda r: F.struct(identity(r).alias("key"), r.alias("ref")))

    def one(key, mine):
        pick = lambda n: F.coalesce(F.get(F.filter(F.transform(mine, lambda k: k["ref"][n]), _some), F.lit(0)), F.lit("")).alias(n)
        label = F.get(mine, F.lit(0))["ref"]["label"]
        safe = F.when(text.strip(F.coalesce(label, F.lit(""))) != "", label).otherwise(F.lit("evidence"))
        return F.struct(key.alias("key"), safe.alias("label"), *[pick(n) for n in FIELDS])

    def merged(known):  # let(): references are keyed once, and those of a key found once
        keys = F.array_distinct(F.transform(known, lambda k: k["key"]))
        return F.transform(keys, lambda key: text.let(F.filter(known, lambda k: k["key"] == key), lambda mine: one(key, mine)))

    return text.let(keyed, merged)


def display_labels(labels: Column) -> Column:
    """Globally unique labels: the first of equal ones keeps it, later ones get a free `-n`."""
    return text.let(labels, _display_labels)


def _display_labels(labels: Column) -> Column:
    size = F.size(labels)
    start = F.array().cast("array<string>")

    def step(used, i):
        label = F.get(labels, i)
        earlier = F.size(F.filter(F.slice(labels, F.lit(1), i), lambda x: x == label))
        count = F.when(earlier == 0, F.lit(2)).otherwise(earlier + 1)
        tries = F.transform(F.sequence(count, count + size + 1), lambda n: F.concat(label, F.lit("-"), n.cast("string")))
        free = F.filter(tries, lambda t: ~F.array_contains(used, t) & ((earlier == 0) | ~F.array_contains(labels, t)))
        chosen = F.when((earlier == 0) & ~F.array_contains(used, label), label).otherwise(F.get(free, F.lit(0)))
        return F.concat(used, F.array(chosen))

    indices = F.when(size > 0, F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(indices, start, step)


def _line(name: str, value: Column, indent: str = "") -> Column:
    return F.concat(F.lit(f"{indent}{name}: "), text.yaml_scalar(value))


def _opt(name: str, value: Column, indent: str) -> Column:
    return F.when(_some(value), _line(name, value, indent))


def iso_utc(c: Column) -> Column:
    """An ISO time in UTC with `+00:00`; naive means UTC, microseconds only if not zero. Another
    text stops the job. Holds for any time zone of the session."""
    zoned = F.when(F.rlike(c, F.lit(r"(?:[Zz]|[+-]\d{2}:?\d{2})$")), c).otherwise(F.when(F.rlike(c, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.concat(c, F.lit("T00:00:00Z"))).otherwise(F.concat(c, F.lit("Z"))))
    at = F.unix_micros(F.try_to_timestamp(zoned))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(at / 86_400_000_000).cast("int"))
    inside = F.pmod(at, F.lit(86_400_000_000).cast("long"))
    two = lambda unit, most: F.lpad((F.floor(inside / unit) % most).cast("string"), 2, "0")
    micro = inside % 1_000_000
    tail = F.when(micro == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(micro.cast("string"), 6, "0")))
    said = F.concat(day.cast("string"), F.lit("T"), two(3_600_000_000, 24), F.lit(":"), two(60_000_000, 60), F.lit(":"), two(1_000_000, 60), tail, F.lit("+00:00"))
    return F.when(c.isNotNull() & at.isNull(), F.raise_error(F.concat(F.lit("not an ISO time: "), c))).otherwise(said)


def _frontmatter(m: Column) -> Column:
    names = ("note_id", "note_type", "status", "generated_at", "generated_by", "generator_version", "schema_version", "source_policy", "validation_status")
    doc = lambda d: F.concat_ws("\n", F.concat(F.lit("  - document_id: "), text.yaml_scalar(d["document_id"])), _opt("source_path", d["source_path"], "    "), _opt("source_raw_hash", d["source_raw_hash"], "    "), _opt("content_hash", F.when(_some(d["content_hash"]), d["content_hash"]).otherwise(d["source_raw_hash"]), "    "))
    part = lambda c: F.concat_ws("\n", F.concat(F.lit("  - document_id: "), text.yaml_scalar(c["document_id"])), _line("chunk_id", c["chunk_id"], "    "), *[_opt(n, c[n], "    ") for n in ("source_raw_hash", "raw_text_hash", "cleaned_text_hash", "evidence_text_hash")])
    listed = lambda title, items, each: F.when(F.size(items) > 0, F.concat(F.lit(f"{title}:\n"), F.array_join(F.transform(items, each), "\n")))
    return F.concat_ws(
        "\n", *[_line(n, m[n]) for n in names], F.when(m["confidence"].isNotNull(), _line("confidence", m["confidence"])),
        F.concat(F.lit("evidence_count: "), m["evidence_count"].cast("string")), listed("source_documents", m["source_documents"], doc), listed("source_chunks", m["source_chunks"], part),
    )


def render(notes: DataFrame, brand: Branding = Branding()) -> DataFrame:  # noqa: B008  frozen
    """Adds `markdown` and `file_name`; times are written in UTC."""
    at = iso_utc(F.col("metadata.generated_at"))
    notes = text.staged(notes, metadata=F.when(F.col("metadata").isNotNull(), F.col("metadata").withField("generated_at", at)))
    m = F.col("metadata")
    staged = text.staged(notes, _refs=merged_refs(F.col("claims"), F.col("source_evidence")))
    staged = text.staged(staged, _labels=display_labels(F.transform("_refs", lambda r: r["label"])))
    keys = F.transform("_refs", lambda r: r["key"])
    shown = lambda ref: F.get(F.col("_labels"), (F.array_position(keys, identity(ref)) - 1).cast("int"))

    def claim(c):
        labels = F.array_join(F.array_distinct(F.transform(c["evidence_refs"], shown)), ", ")
        tail = F.when(c["unsupported"], F.lit(" *(unsupported — no evidence)*")).when(F.size(c["evidence_refs"]) == 0, F.lit(" *(unsupported — no evidence refs)*"))
        return F.concat(F.lit("- "), c["statement"], F.coalesce(tail, F.concat(F.lit(" ["), labels, F.lit("]"))))

    def entry(r, i):
        field = lambda title, n, always=False: (lambda t: t if always else F.when(r[n] != "", t))(F.concat(F.lit(f"- **{title}**: `"), r[n], F.lit("`")))
        return F.concat_ws(
            "\n", F.concat(F.lit("### "), F.get(F.col("_labels"), i)), F.lit(""), field("Document", "document_id", True), field("Chunk", "chunk_id", True), field("Source", "source_path"),
            field("Source Raw Hash", "source_raw_hash"), field("Raw Text Hash", "raw_text_hash"), field("Evidence Text Hash", "evidence_text_hash"),
            F.when(r["excerpt"] != "", F.concat(F.lit("\n"), text.blockquote(r["excerpt"]))), F.lit(""),
        )

    many = lambda items, each: F.when(F.size(items) > 0, F.array_join(F.transform(items, each), "\n"))
    sources = F.when(F.size(m["source_documents"]) > 0, F.concat(F.lit("- source_documents:\n"), F.array_join(F.transform(m["source_documents"], lambda d: _line("document_id", d["document_id"], "  - ")), "\n")))
    chunks = F.when(F.size(m["source_chunks"]) > 0, F.concat(F.lit("- source_chunks:\n"), F.array_join(F.transform(m["source_chunks"], lambda c: _line("chunk_id", c["chunk_id"], "  - ")), "\n")))
    facts = [_line(n, m[n], "- ") for n in ("generated_at", "source_policy", "validation_status")]
    facts += [F.concat(F.lit("- evidence_count: "), m["evidence_count"].cast("string"))] + [_line(n, m[n], "- ") for n in ("generator_version", "schema_version")] + [sources, chunks]
    has = m.isNotNull()
    body = F.concat_ws(
        "\n", F.lit("---"), F.when(has, _frontmatter(m)), F.lit("---"), F.lit(""), F.concat(F.lit("# "), F.coalesce("title", F.lit(""))), F.lit(""),
        F.when(_some(F.col("summary")), F.concat(F.col("summary"), F.lit("\n"))), F.lit("## Claims"), F.lit(""), many(F.col("claims"), claim), F.lit(""),
        F.lit("## Evidence References"), F.lit(""), many(F.col("_refs"), entry), F.lit("---"), F.lit(""), F.lit(f"## {brand.metadata_heading}"), F.lit(""),
        F.concat(F.lit("- note_id: `"), F.col("note_id"), F.lit("`")), *[F.when(has, f) for f in facts], F.lit(""),
    )
    return text.staged(staged, markdown=body, file_name=ids.note_filename(F.col("title"), F.col("note_id"))).drop("_refs", "_labels")


def _blank(c: Column) -> Column:
    return text.strip(F.coalesce(c, F.lit(""))) == ""


def _missing(claim: Column, ref: Column, full: bool) -> Column:
    said = [F.lit("claim='"), claim["statement"]]
    if full:
        said += [F.lit("', label='"), F.coalesce(ref["label"], F.lit("None"))]
    said += [F.lit("', document_id='"), F.coalesce(ref["document_id"], F.lit("None")), F.lit("', chunk_id='"), F.coalesce(ref["chunk_id"], F.lit("None")), F.lit("'")]
    return F.concat(F.lit("evidence ref missing required source identity: " if full else "evidence ref missing required label: "), *said)


def _ref_problems(claims: Column, identity_check: bool) -> Column:
    bad = (lambda r: _blank(r["document_id"]) | _blank(r["chunk_id"])) if identity_check else (lambda r: _blank(r["label"]))
    per = lambda c: F.transform(F.filter(c["evidence_refs"], bad), lambda r: _missing(c, r, identity_check))
    return F.flatten(F.transform(F.filter(claims, lambda c: ~c["unsupported"]), per))


def _mismatch() -> Column:
    said = F.concat(F.lit("note_id mismatch: note.note_id '"), F.col("note_id"), F.lit("' does not match metadata.note_id '"), F.col("metadata.note_id"), F.lit("'"))
    return F.when(F.col("metadata").isNotNull() & (F.col("metadata.note_id") != F.col("note_id")), said)


def _uncovered(claims: Column) -> Column:
    bare = F.filter(claims, lambda c: ~c["unsupported"] & (F.size(c["evidence_refs"]) == 0))
    return F.transform(bare, lambda c: F.concat(F.lit("Claim '"), c["statement"], F.lit("' is supported but has no evidence refs")))


def validate(notes: DataFrame) -> DataFrame:
    """Adds `errors`, every problem that blocks an export, in fixed order."""
    claims = F.col("claims")
    some = F.filter(F.array(_mismatch()), lambda x: x.isNotNull())
    return notes.withColumn("errors", F.concat(some, _uncovered(claims), _ref_problems(claims, True), _ref_problems(claims, False)))


def export_plan(notes: DataFrame, strict: bool = True, allow_unvalidated: bool = False, allow_unsupported: bool = False) -> DataFrame:
    """Adds rejection_reason: the first failed check of a strict export, or null."""
    claims = F.col("claims")
    first = lambda a: F.get(a, F.lit(0))
    if not strict:
        return notes.withColumn("rejection_reason", F.lit(None).cast("string"))
    checks = [F.when(F.col("metadata").isNull(), F.lit("Note has no metadata"))]
    if not allow_unvalidated:
        checks.append(F.when(F.coalesce("metadata.validation_status", F.lit("")) != "validated", F.lit("Note is not validated")))
    checks += [_mismatch(), first(_uncovered(claims))]
    if not allow_unsupported:
        checks.append(first(F.transform(F.filter(claims, lambda c: c["unsupported"]), lambda c: F.concat(F.lit("Unsupported claim: '"), c["statement"], F.lit("'")))))
    checks += [first(_ref_problems(claims, True)), first(_ref_problems(claims, False))]
    return notes.withColumn("rejection_reason", F.coalesce(*checks))


RESULT = "note_id string, file_path string, written boolean, skipped boolean, rejected boolean, reason string"


def write_files(notes: DataFrame, folder: str, overwrite: bool = False, **strict) -> DataFrame:
    """Writes accepted notes below folder, one file each, by all tasks; never replaces without `overwrite`.

    RESULT, a row for each note: a failed write rejects that note and the batch goes on. Notes of one
    file name meet in a task, by note_id. What was there before is noted first, so that a task that
    runs again writes its files again.
    """
    spark, out = notes.sparkSession, Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    base = out.absolute()  # tasks have working directories of their own
    rows = render(export_plan(notes, **strict)).select("note_id", "file_name", F.when(F.coalesce("rejection_reason", F.lit("")) == "", F.col("markdown")).alias("markdown"), "rejection_reason")
    if overwrite or not any(out.iterdir()):
        rows = rows.withColumn("there", F.lit(False))
    else:

        def known(batches):
            for batch in batches:
                yield batch.filter([bool(n) and os.path.exists(base / n) for n in batch.column(0).to_pylist()])

        at = scratch.shared(spark, "there")
        files.dealt(rows.select("file_name").distinct(), "file_name").mapInArrow(known, "file_name string").write.parquet(at)
        there = spark.read.schema("file_name string").parquet(at).withColumn("there", F.lit(True))
        rows = rows.join(there, "file_name", "left").select("note_id", "file_name", "markdown", "rejection_reason", F.coalesce("there", F.lit(False)).alias("there"))

    def write(batches):
        import pyarrow as pa

        last = None
        for batch in batches:
            results = []
            for note_id, name, markdown, reason, there in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                at = out / (name or "")
                result = {"note_id": note_id, "file_path": str(at), "written": False, "skipped": False, "rejected": False, "reason": ""}
                if reason or not name:
                    result |= {"rejected": True, "reason": reason or "note_id is blank"}
                elif not overwrite and (there or name == last):
                    result |= {"skipped": True, "reason": "File already exists"}
                else:
                    try:
                        with files.placed(str(base / name)) as aside:
                            Path(aside).write_bytes(markdown.encode())
                        result["written"], last = True, name
                    except OSError as e:
                        result |= {"rejected": True, "reason": f"write failed: {e}"}
                results.append(result)
            yield pa.RecordBatch.from_pylist(results, pa.schema([(n.split()[0], {"string": pa.string(), "boolean": pa.bool_()}[n.split()[1]]) for n in RESULT.split(", ")]))

    at = scratch.shared(spark, "written")
    files.dealt(rows, "file_name").sortWithinPartitions("file_name", "note_id").mapInArrow(write, RESULT).write.parquet(at)
    return spark.read.schema(RESULT).parquet(at)


def write_notes(notes: DataFrame, folder: str, overwrite: bool = False, **strict) -> list[dict]:
    """write_files() with its results as a list, by file."""
    return [r.asDict() for r in write_files(notes, folder, overwrite, **strict).orderBy("file_path", "note_id").collect()]
