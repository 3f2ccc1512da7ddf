"""Vault layout: an inspectable plan table, index notes, manifest, and a fail-closed apply.

The plan is a DataFrame over the notes' files; nothing is written until every accepted row has
been checked. Tasks check and copy the files and sort the lines of indexes and manifest; each of
those is one file, so the driver strings its sorted pieces together, without holding them.
"""

from __future__ import annotations

import json
import os
import shutil
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofmill.config import Branding
from proofmill.functions import text
from proofmill.operators import health
from proofmill.sources import scratch
from proofmill.sources.files import below, dealt, open_files, placed

INDEXES = ("Home.md", "By-Type.md", "By-Source.md")


@dataclass(frozen=True)
class VaultConfig:
    allow_overwrite: bool = False
    allow_unhealthy: bool = False
    generate_index: bool = True
    generate_manifest: bool = True
    brand: Branding = Branding()


def note_files(spark: SparkSession, folder: str, exclude: list[str] | None = None) -> DataFrame:
    """file_path, content of the .md files below folder; directories that start with `.` or `_` and excluded ones are left out."""
    skip = [Path(e).resolve() for e in exclude or []]
    free = lambda e: not any(Path(e.path).resolve().is_relative_to(s) for s in skip)
    found = below(spark, folder, lambda e: Path(e.name).suffix.lower() == ".md" and free(e), lambda e: not e.name.startswith((".", "_")) and free(e))
    return open_files(found).select("file_path", F.col("content").cast("string").alias("content"))


def plan(files: DataFrame, existing: DataFrame | None = None, config: VaultConfig = VaultConfig(), root: str = "", yaml: bool = False) -> DataFrame:  # noqa: B008  frozen
    """One row per note file: destination, identity, rejected/skipped/collision flags and the reason.

    `existing` lists relative destinations that are already there (column relative_destination).
    With `yaml`, front matter outside the notes' own grammar is read as YAML, as in health.parse().
    The health preflight needs every note before it can accept one: notes are parsed once, and
    their narrow rows with their issues are written, counted and read again.
    """
    brand = config.brand
    parsed = health.parse(files, yaml)
    if not config.allow_unhealthy:
        parsed = health.file_issues(parsed, brand)
    fm = lambda k: F.coalesce(F.try_element_at(F.col("frontmatter"), F.lit(k)), F.lit(""))
    named = F.transform("source_documents", lambda d: d["document_id"])
    ids = F.array_distinct(F.filter(named, lambda d: F.coalesce(d, F.lit("")) != ""))
    in_body = F.array_distinct(F.regexp_extract_all("body", F.lit(r"- \*\*Document\*\*: `([^`]+)`"), F.lit(1)))
    name = F.regexp_extract("file_path", r"([^/]+)$", 1)
    count = F.coalesce(F.try_to_number(F.trim(fm("evidence_count")), F.lit("S999999999")).cast("int"), F.lit(0))
    title = text.strip(F.regexp_extract("body", r"(?m)^[ \t]*# (.*)$", 1))
    rows = parsed.select(
        F.col("file_path").alias("source_path"), F.when(F.startswith("file_path", F.lit(root.rstrip("/") + "/")), F.substr("file_path", F.lit(len(root.rstrip("/")) + 2))).otherwise(F.col("file_path")).alias("relative_source"),
        name.alias("original_filename"), F.concat(F.lit(f"{brand.vault_dir}/Notes/"), name).alias("relative_destination"), title.alias("title"), fm("note_id").alias("note_id"),
        fm("note_type").alias("note_type"), fm("status").alias("status"), count.alias("evidence_count"), F.when(F.size(ids) > 0, ids).otherwise(in_body).alias("source_document_ids"),
        *([] if config.allow_unhealthy else ["fm_state", "issues"]),
    )
    if not config.allow_unhealthy:
        at = scratch.shared(files.sparkSession, "plan")
        rows.write.parquet(at)
        rows = files.sparkSession.read.schema(rows.schema).parquet(at)
        bad = health.note_issues(rows.withColumnRenamed("source_path", "file_path")).agg(F.count_if(F.col("severity") == "error").alias("health_errors"))
        rows = rows.drop("fm_state", "issues").join(F.broadcast(bad))  # one row
    else:
        rows = rows.withColumn("health_errors", F.lit(0).cast("long"))
    sick = F.col("health_errors") > 0
    claim = Window.partitionBy(text.fold(F.col("relative_destination"))).orderBy("relative_source")
    rows = rows.withColumn("_first", F.first("relative_source").over(claim))
    collision = ~sick & (F.col("_first") != F.col("relative_source"))
    reason = F.when(sick, F.concat(F.lit("Health preflight failed with "), F.col("health_errors").cast("string"), F.lit(" error(s)"))).when(
        collision, F.concat(F.lit("Duplicate destination '"), F.col("relative_destination"), F.lit("' (first claimed by '"), F.col("_first"), F.lit("')"))
    )
    rows = rows.withColumns({"rejection_reason": reason, "rejected": reason.isNotNull(), "collision": collision}).drop("_first", "health_errors")
    if existing is None or config.allow_overwrite:
        return rows.withColumn("skipped", F.lit(False))
    there = existing.select("relative_destination").distinct().withColumn("_there", F.lit(True))
    return rows.join(there, "relative_destination", "left").withColumn("skipped", F.coalesce("_there", F.lit(False)) & ~F.col("rejected")).drop("_there")


def accepted(plan_rows: DataFrame) -> DataFrame:
    return plan_rows.where("not rejected and not skipped")


def _links(brand: Branding):
    link = F.replace(F.col("relative_destination"), F.lit(f"{brand.vault_dir}/Notes/"), F.lit(""))
    some = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs])
    order = F.coalesce(some("title", "note_id"), F.lit(""))
    return F.struct(order.alias("order"), F.col("relative_source"), F.concat(F.lit("- [["), link, F.lit("|"), some("title", "note_id", "original_filename"), F.lit("]]")).alias("line"))


def _grouped(plan_rows: DataFrame, by: str, brand: Branding) -> DataFrame:
    rows = accepted(plan_rows).withColumn("_l", _links(brand))
    if by == "note_type":
        return rows.select(F.coalesce(F.nullif(F.col("note_type"), F.lit("")), F.lit("unknown")).alias("group"), "_l")
    sources = F.when(F.size("source_document_ids") > 0, F.col("source_document_ids")).otherwise(F.array(F.lit("<no-source>")))
    return rows.select(F.explode(sources).alias("group"), "_l")


def grouped_links(plan_rows: DataFrame, by: str, brand: Branding = Branding()) -> DataFrame:  # noqa: B008  frozen
    """group, lines: the accepted notes of each type (`note_type`) or source (`source`)."""
    key = _grouped(plan_rows, by, brand)
    return key.groupBy("group").agg(F.array_sort(F.collect_list("_l")).alias("_ls")).select("group", F.transform("_ls", lambda x: x["line"]).alias("lines"))


_PAGES = {"By-Type.md": ("note_type", "Notes by Type", "Auto-generated index grouped by note type."), "By-Source.md": ("source", "Notes by Source", "Auto-generated index grouped by source document.")}


def _head(name: str, brand: Branding) -> list[str]:
    title, about = (brand.home_title, "Auto-generated vault index. Do not edit manually.") if name == "Home.md" else _PAGES[name][1:]
    return ["---", f'title: "{title}"', 'type: "vault_index"', "---", "", f"# {title}", "", about, ""]


def index_lines(name: str, plan_rows: DataFrame, brand: Branding = Branding()) -> DataFrame:  # noqa: B008  frozen
    """The lines of one index note between its head and the marker, sorted (column line). A group's heading
    and end are rows of their own, so that a group of any size is sorted by many tasks."""
    if name == "Home.md":
        around = plan_rows.sparkSession.createDataFrame([(0, "## Notes"), (1, ""), (3, "")], "kind int, line string").select("kind", F.lit("").alias("order"), F.lit("").alias("relative_source"), "line")
        rows = accepted(plan_rows).select(_links(brand).alias("l")).select(F.lit(2).alias("kind"), "l.*")
        return rows.unionByName(around).orderBy("kind", "order", "relative_source").select("line")
    if name not in INDEXES:
        raise ValueError(f"Unknown index file: {name}")
    rows = _grouped(plan_rows, _PAGES[name][0], brand).select("group", F.lit(2).alias("kind"), "_l.*")
    parts = [(0, F.concat(F.lit("## "), F.col("group"))), (1, F.lit("")), (3, F.lit(""))]
    around = rows.select("group").distinct().select("group", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit("").alias("order"), F.lit("").alias("relative_source"), line.alias("line")) for k, line in parts])))
    return rows.unionByName(around).orderBy("group", "kind", "order", "relative_source", "line").select("line")


def index_page(name: str, plan_rows: DataFrame, brand: Branding = Branding()) -> str:  # noqa: B008  frozen
    """The text of one index note."""
    lines = index_lines(name, plan_rows, brand)
    return "\n".join([*_head(name, brand), *[r["line"] for r in lines.collect()], brand.marker])


def _strung(lines: DataFrame, at: Path, head: str, tail: str, cut: int = 0) -> None:
    """Writes sorted lines to one file between head and tail, without the last `cut` bytes of the lines."""
    pieces = scratch.shared(lines.sparkSession, "lines")
    lines.write.option("compression", "none").text(pieces)
    with open(at, "wb") as f:
        f.write(head.encode())
        start = f.tell()
        for p in sorted(Path(pieces.removeprefix("file://")).glob("part-*")):
            with open(p, "rb") as piece:
                shutil.copyfileobj(piece, f, 1 << 20)
        if f.tell() > start:
            f.seek(-cut, os.SEEK_END)
            f.truncate()
        f.write(tail.encode())


NAMES = ("relative_source", "relative_destination", "original_filename", "note_id", "note_type", "status", "evidence_count")


def _note(r: dict) -> dict:
    return {"source_relative": r.pop("relative_source"), "destination_relative": r.pop("relative_destination"), **r}


def _about(wiki_dir: str, vault_dir: str, brand: Branding, at: str | None, total: int) -> dict:
    return {"version": "1.0", "generated_by": f"{brand.generator}-vault", "generated_at": at or datetime.now(timezone.utc).isoformat(), "source_wiki_dir": wiki_dir, "vault_dir": vault_dir, "total_notes": total}


def manifest(plan_rows: DataFrame, wiki_dir: str, vault_dir: str, brand: Branding = Branding(), at: str | None = None) -> str:  # noqa: B008  frozen
    """The vault manifest's JSON text: accepted notes by destination."""
    notes = [_note(r.asDict()) for r in accepted(plan_rows).select(*NAMES).orderBy("relative_destination").collect()]
    return json.dumps({**_about(wiki_dir, vault_dir, brand, at, len(notes)), "notes": notes}, indent=2)


def write_manifest(to: Path, plan_rows: DataFrame, wiki_dir: str, vault_dir: str, brand: Branding = Branding(), at: str | None = None) -> None:  # noqa: B008  frozen
    """Writes the text of manifest(), whose notes are sorted and put into JSON by tasks."""

    def said(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [json.dumps(_note(r), indent=2).replace("\n", "\n    ") for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f"    {t}," for t in texts], pa.string())], names=["line"])

    rows = accepted(plan_rows).select(*NAMES)
    total = rows.count()
    head = json.dumps({**_about(wiki_dir, vault_dir, brand, at, total), "notes": []}, indent=2).removesuffix("]\n}")
    _strung(rows.orderBy("relative_destination").mapInArrow(said, "line string"), to, head + "\n" * (total > 0), "\n  ]\n}" if total else "]\n}", cut=2)


def apply(plan_rows: DataFrame, vault_dir: str, wiki_dir: str, config: VaultConfig = VaultConfig()) -> dict:  # noqa: B008  frozen
    """Checks everything, then copies; a failure removes what this call wrote and reports the error.

    Files that are there and carry no marker are never replaced by an index or manifest.
    """
    spark, root, brand = plan_rows.sparkSession, Path(vault_dir).absolute(), config.brand
    at = scratch.shared(spark, "accepted")
    accepted(plan_rows).write.parquet(f"{at}/plan")  # read for the checks, the copies, each index and the manifest
    chosen = spark.read.schema(plan_rows.schema).parquet(f"{at}/plan")
    source = F.when(F.startswith("source_path", F.lit("/")), F.col("source_path")).otherwise(F.concat(F.lit(f"{os.getcwd()}/"), F.col("source_path"))).alias("source_path")  # tasks have working directories of their own
    dealt(chosen.select(source, "relative_destination"), "relative_destination").mapInArrow(_checker(root), CHECKED).write.parquet(f"{at}/checked")
    checked = spark.read.schema(CHECKED).parquet(f"{at}/checked")
    listed = lambda which, said: [r["p"] for r in checked.where(which).orderBy("relative_destination").select(said.alias("p")).collect()]
    problems = listed("missing", F.concat(F.lit("Source file not found: "), F.col("source_path")))
    if not config.allow_overwrite:
        problems += listed("there", F.concat(F.lit("Destination exists: "), F.col("target")))
    pages = {n: root / brand.vault_dir / "Index" / n for n in INDEXES} if config.generate_index else {}
    problems += [f"Index file is not ours: {p}" for p in pages.values() if p.exists() and not _holds(p, brand.marker)]
    ledger = root / brand.manifest_name
    if config.generate_manifest and ledger.exists() and not _holds(ledger, f'"{brand.generator}-vault"'):
        problems.append(f"Manifest file is not ours: {ledger}")
    problems += listed("blocked is not null", F.concat(F.lit("Cannot create destination parent path: "), F.col("blocked")))
    problems += [f"Cannot create destination parent path: {p.parent}" for p in pages.values() if _blocked(p)]
    if problems:
        return {"success": False, "errors": problems, "copied": 0}
    written: list[Path] = []
    try:
        dealt(checked.select("source_path", "target"), "target").mapInArrow(_copy, COPIED).write.parquet(f"{at}/copied")
        failed = spark.read.schema(COPIED).parquet(f"{at}/copied").where("error is not null").orderBy("target").first()
        if failed:
            raise OSError(failed["error"])
        for name, page in pages.items():
            page.parent.mkdir(parents=True, exist_ok=True)
            written.append(page)
            _strung(index_lines(name, chosen, brand), page, "\n".join(_head(name, brand)) + "\n", brand.marker)
        if config.generate_manifest:
            written.append(ledger)
            write_manifest(ledger, chosen, wiki_dir, vault_dir, brand)
    except OSError as e:
        for p in written:
            p.unlink(missing_ok=True)
        checked.where("not there").select("target").mapInArrow(_remove, "target string").count()
        return {"success": False, "errors": [str(e)], "copied": 0}
    return {"success": True, "errors": [], "copied": checked.count()}


CHECKED = "source_path string, relative_destination string, target string, missing boolean, there boolean, blocked string"
COPIED = "target string, error string"


def _holds(path: Path, marker: str) -> bool:
    """Whether a file holds the marker; read piece by piece."""
    wanted, kept = marker.encode(), b""
    with open(path, "rb") as f:
        while piece := f.read(1 << 20):
            if wanted in kept + piece:
                return True
            kept = (kept + piece)[-len(wanted) :]
    return not wanted


def _blocked(target: Path) -> bool:
    return not next(p for p in target.parents if p.exists()).is_dir()


def _checker(root: Path):
    """A function for mapInArrow: CHECKED rows of source_path and relative_destination."""

    def check(batches):
        import pyarrow as pa

        for batch in batches:
            sources, names = batch.column(0), batch.column(1)
            targets = [root / n for n in names.to_pylist()]
            blocked = [str(t.parent) if _blocked(t) else None for t in targets]
            missing = [not os.path.isfile(s) for s in sources.to_pylist()]
            flags = lambda x: pa.array(x, pa.bool_())
            yield pa.RecordBatch.from_arrays([sources, names, pa.array(map(str, targets), pa.string()), flags(missing), flags([os.path.exists(t) for t in targets]), pa.array(blocked, pa.string())], names=[c.split()[0] for c in CHECKED.split(", ")])

    return check


def _copy(batches):
    """COPIED rows of source_path and target; a task copies nothing more after an error."""
    import pyarrow as pa

    error = None
    for batch in batches:
        targets, errors = [], []
        for source, target in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if error is None:
                try:
                    if os.path.exists(target) and os.path.samefile(source, target):
                        raise shutil.SameFileError(f"{source!r} and {target!r} are the same file")
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    with placed(target) as aside:
                        shutil.copy2(source, aside)
                except OSError as e:
                    error = str(e)
                    targets.append(target)
                    errors.append(error)
        yield pa.RecordBatch.from_arrays([pa.array(targets, pa.string()), pa.array(errors, pa.string())], names=["target", "error"])


def _remove(batches):
    for batch in batches:
        for target in batch.column(0).to_pylist():
            Path(target).unlink(missing_ok=True)
        yield batch
