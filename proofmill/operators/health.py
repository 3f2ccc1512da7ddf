"""Note health: parse, lint rules, cross-note checks, source drift, report.

Input is file_path and content; every rule of one file is a row-local array of issues, so the
only shuffles are the cross-note checks and the drift join.
"""

from __future__ import annotations

import json
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.config import Branding
from proofmill.functions import text

#: Fixed values of the note contract.
REQUIRED = ("note_id", "note_type", "schema_version", "status", "generated_by", "source_policy", "validation_status", "evidence_count")
ENUMS = {
    "note_type": ("compiled_knowledge_wiki_note",),
    "schema_version": ("wiki-export-v1",),
    "status": ("deprecated", "draft", "proposal", "published"),
}
SOURCE_POLICY = "raw_text_authoritative"
_KEY = r"^([A-Za-z_][A-Za-z0-9_]*):(?: +(.*))?$"
_SOURCE = ("document_id", "source_path", "source_raw_hash", "content_hash")
#: What the cross-note checks need of a file, beside its note_id.
_KEPT = ("file_path", "fm_state", "issues")
_ISSUE = "code string, severity string, message string, file_path string"


def _issues(*found: Column) -> Column:
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _issue(code: str, message: Column, severity: str = "error") -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message"))


def _scalar(raw: Column) -> Column:
    """A YAML scalar as text: quotes and their escapes undone; null for nothing, `null` or `~`."""
    quoted = F.substr(raw, F.lit(2), F.length(raw) - 2)
    undone = F.replace(quoted, F.lit("\\\\"), F.lit("\x00"))
    for escaped, plain in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"'), ("\x00", "\\")):
        undone = F.replace(undone, F.lit(escaped), F.lit(plain))
    simple = F.replace(quoted, F.lit("''"), F.lit("'"))
    return (
        F.when(F.rlike(raw, F.lit(r'(?s)^".*"$')), F.when(F.contains(quoted, F.lit("\\")), undone).otherwise(quoted))
        .when(F.rlike(raw, F.lit(r"(?s)^'.*'$")), simple)
        .when(raw.isin("", "null", "~", "Null", "NULL"), F.lit(None).cast("string"))
        .otherwise(raw)
    )


def _foreign(raw: Column) -> Column:
    """Front matter in another YAML grammar, as struct(frontmatter, source_documents); null where
    it is not YAML or no mapping. Python, batch by batch, for the few texts that need it."""
    entry = f"array<struct<{','.join(f'{k}:string' for k in _SOURCE)}>>"

    @F.pandas_udf("string")
    def read(batch):
        import pandas as pd
        import yaml

        def said(v):
            return None if v is None else str(v).lower() if isinstance(v, bool) else v if isinstance(v, str) else json.dumps(v, default=str) if isinstance(v, (dict, list)) else str(v)

        def one(text):
            if text is None:
                return None
            try:
                found = yaml.safe_load(text)
            except yaml.YAMLError:
                return None
            if not isinstance(found, dict):
                return None
            listed = found.get("source_documents")
            docs = [{k: said(d.get(k)) for k in _SOURCE} for d in listed if isinstance(d, dict)] if isinstance(listed, list) else []
            return json.dumps({"frontmatter": {str(k): said(v) for k, v in found.items()}, "source_documents": docs})

        return pd.Series([one(t) for t in batch])

    return F.from_json(read(raw), f"struct<frontmatter:map<string,string>,source_documents:{entry}>")


def parse(files: DataFrame, yaml: bool = False) -> DataFrame:
    """file_path, content -> front matter map, source entries, body sections.

    With `yaml`, front matter outside the grammar below is read by PyYAML instead of being bad.

    The grammar is the one notes are written in: `key: scalar` lines, and lists of flat mappings
    under a key. `fm_state` is none, open (no closing line), bad (another grammar) or ok.
    """
    lead = F.regexp_replace("content", r"^[\r\n]+", "")
    some = lambda **c: text.staged(out, **c)
    out = text.staged(files, _lead=lead)
    out = some(_rest=F.substr("_lead", F.lit(4)), _close=F.instr(F.substr("_lead", F.lit(4)), "\n---"))
    state = F.when(~F.startswith("_lead", F.lit("---")), F.lit("none")).when(F.col("_close") == 0, F.lit("open")).otherwise(F.lit("ok"))
    raw = text.strip(F.substr("_rest", F.lit(1), F.greatest(F.col("_close") - 1, F.lit(0))))
    out = some(_state=state, _raw=raw)
    body = F.when(F.col("_state") == "ok", F.substr("_rest", F.col("_close") + 4)).when(F.col("_state") == "open", F.col("_rest")).otherwise(F.col("content"))
    lines = F.filter(F.split(F.when(F.col("_state") == "ok", F.col("_raw")).otherwise(F.lit("")), "\n"), lambda x: (F.trim(x) != "") & ~F.startswith(F.trim(x), F.lit("#")))
    out = some(body=body, _lines=lines)
    good = lambda x: F.rlike(x, F.lit(_KEY)) | F.rlike(x, F.lit(r"^ *- .*$")) | F.rlike(x, F.lit(r"^ +[A-Za-z_][A-Za-z0-9_]*:(?: .*)?$"))
    value = lambda x: F.trim(F.regexp_extract(x, _KEY, 2))
    torn = lambda x: F.rlike(value(x), F.lit(r'^["\[{]')) & ~F.rlike(value(x), F.lit(r'^(?:"(?:[^"\\]|\\.)*"|\[.*\]|\{.*\})$'))
    bad = (F.size("_lines") == 0) | F.exists("_lines", lambda x: ~good(x) | (F.rlike(x, F.lit(_KEY)) & torn(x)))
    tops = F.transform(F.filter("_lines", lambda x: F.rlike(x, F.lit(_KEY))), lambda x: F.struct(F.regexp_extract(x, _KEY, 1).alias("k"), value(x).alias("v")))
    listed = F.regexp_extract(F.concat(F.lit("\n"), F.array_join("_lines", "\n"), F.lit("\n")), r"\nsource_documents:[ ]*\n((?:[ -][^\n]*\n)*)", 1)
    items = F.filter(F.split(F.concat(F.lit("\n"), listed), r"\n *- "), lambda x: F.trim(x) != "")
    out = some(fm_state=F.when((F.col("_state") == "ok") & bad, F.lit("bad")).otherwise(F.col("_state")), _tops=tops, _items=items)
    if yaml:
        out = some(_yaml=_foreign(F.when(F.col("fm_state") == "bad", F.col("_raw"))))
        out = out.withColumn("fm_state", F.when(F.col("_yaml").isNotNull(), F.lit("yaml")).otherwise(F.col("fm_state")))
    later = lambda i: F.slice(F.col("_tops"), i + 2, F.size("_tops"))
    last = F.filter("_tops", lambda p, i: ~F.exists(later(i), lambda q: q["k"] == p["k"]))
    own = lambda x, k: F.trim(F.regexp_extract(F.concat(F.lit("\n"), x), rf"\n *{k}:[ ]*([^\n]*)", 1)).alias(k)
    out = some(_tops=last, _items=F.transform("_items", lambda x: F.struct(*[own(x, k) for k in _SOURCE])))
    pairs = F.map_from_entries(F.transform("_tops", lambda p: F.struct(p["k"].alias("k"), _scalar(p["v"]).alias("v"))))
    docs = F.transform("_items", lambda d: F.struct(*[_scalar(d[k]).alias(k) for k in _SOURCE]))
    ok = F.col("fm_state") == "ok"
    none = F.array().cast("array<struct<" + ",".join(f"{k}:string" for k in _SOURCE) + ">>")
    if yaml:
        read = F.col("fm_state") == "yaml"
        pairs, docs = F.when(read, F.col("_yaml.frontmatter")).otherwise(pairs), F.when(read, F.col("_yaml.source_documents")).otherwise(docs)
        ok = ok | read
    out = some(frontmatter=F.when(ok, pairs).otherwise(F.create_map().cast("map<string,string>")), source_documents=F.when(ok, docs).otherwise(none), sections=_sections(F.col("body")))
    out = out.withColumn("fm_state", F.when(F.col("fm_state") == "yaml", F.lit("ok")).otherwise(F.col("fm_state")))
    return out.drop("_lead", "_rest", "_close", "_state", "_raw", "_lines", "_tops", "_items", "_yaml")


def _sections(body: Column) -> Column:
    """Array of struct(line, section, claims) for the stripped lines of a body; `claims` is set
    for lines of the first claims section only (and of others that follow it at once).

    The body is split ahead of its headings, so the work is linear in it.
    """
    space = r"[\s\x1c-\x1f&&[^\n]]"
    parts = F.transform(F.split(body, rf"(?U)\n(?={space}*## [^\n]*[^\s\x1c-\x1f])"), lambda p: F.transform(F.split(p, "\n"), text.strip))
    headed = F.transform(parts, lambda p: F.struct(F.when(F.startswith(p[0], F.lit("## ")), p[0]).otherwise(F.lit("")).alias("head"), p.alias("lines")))

    def marked(all_parts):
        first = F.array_position(F.transform(all_parts, lambda p: p["head"]), F.lit("## Claims")).cast("int")
        run = F.array_position(F.transform(F.slice(all_parts, F.greatest(first, F.lit(1)), F.size(all_parts)), lambda p: p["head"] != "## Claims"), F.lit(True)).cast("int")
        of = lambda bounds: F.flatten(
            F.transform(all_parts, lambda p, i: F.transform(p["lines"], lambda x: F.struct(x.alias("line"), p["head"].alias("section"), ((x != p["head"]) & (i + 1 >= bounds["first"]) & (i + 1 < bounds["past"])).alias("claims"))))
        )
        past = F.when(first == 0, F.lit(0)).when(run == 0, F.size(all_parts) + 1).otherwise(first + run - 1)
        return text.let(F.struct(first.alias("first"), past.alias("past")), of)

    return text.let(headed, marked)


def _cut(lines: Column, pattern: str) -> Column:
    """An array of lines as arrays of lines, cut ahead of each line that the pattern finds."""
    joined = F.concat(F.lit("\n"), F.array_join(lines, "\n"))
    return F.transform(F.split(joined, rf"\n(?={pattern})"), lambda p: F.split(p, "\n"))


def _entries() -> Column:
    """Evidence entries: struct(label, doc, chunk); a field is there if the last line that names it holds a value."""
    lines = F.transform(F.filter("sections", lambda s: (s["section"] == "## Evidence References") & (s["line"] != "## Evidence References")), lambda s: s["line"])
    blocks = F.filter(_cut(lines, "### "), lambda b: F.startswith(b[0], F.lit("### ")))

    def held(block, name):
        named = F.filter(F.slice(block, 2, F.size(block)), lambda x: F.contains(x, F.lit(f"**{name}**:")))
        return F.coalesce(F.rlike(F.try_element_at(named, F.lit(-1)), F.lit("`[^`]+`")), F.lit(False))

    return F.transform(blocks, lambda b: F.struct(F.substr(b[0], F.lit(5)).alias("label"), held(b, "Document").alias("doc"), held(b, "Chunk").alias("chunk")))


def file_issues(parsed: DataFrame, brand: Branding = Branding()) -> DataFrame:  # noqa: B008  frozen
    """Adds `issues`: the rules of a single file."""
    fm = lambda k: F.try_element_at(F.col("frontmatter"), F.lit(k))
    quote = lambda c: text.quoted(c)
    required = [F.when(fm(k).isNull() | (text.strip(F.coalesce(fm(k), F.lit(""))) == ""), _issue("missing_required_field", F.lit(f"Missing required frontmatter field: {k}"))) for k in REQUIRED]
    enums = [F.when(~fm(k).isin(list(ok)), _issue(f"invalid_{k}", F.concat(F.lit(f"Invalid {k}: "), quote(fm(k)), F.lit(f" (expected one of {list(ok)})")))) for k, ok in ENUMS.items()]
    policy = F.when(fm("source_policy") != SOURCE_POLICY, _issue("invalid_source_policy", F.concat(F.lit("Invalid source_policy: "), quote(fm("source_policy")), F.lit(f" (expected '{SOURCE_POLICY}')"))))
    status = fm("validation_status")
    validation = F.when(status == "validation_required", _issue("invalid_validation_status", F.lit("validation_status is 'validation_required' (only 'validated' passes cleanly)"), "warning")).when(
        status != "validated", _issue("invalid_validation_status", F.concat(F.lit("Invalid validation_status: "), quote(status)))
    )
    actual = F.size(F.filter("sections", lambda s: (s["section"] == "## Evidence References") & F.startswith(s["line"], F.lit("### "))))
    expected = F.try_to_number(F.trim(fm("evidence_count")), F.lit("S999999999")).cast("int")
    count = F.when(expected != actual, _issue("evidence_count_mismatch", F.concat(F.lit("evidence_count is "), expected.cast("string"), F.lit(" but found "), actual.cast("string"), F.lit(" evidence section(s) in body"))))
    claims = F.filter("sections", lambda s: s["claims"] & F.startswith(s["line"], F.lit("- ")))
    bare = F.filter(claims, lambda s: ~F.rlike(s["line"], F.lit(r"(?i)\(unsupported")) & ~F.rlike(F.substr(s["line"], F.lit(3)), F.lit(r"\[[^\]]+\]")))
    uncited = F.transform(bare, lambda s: _issue("claim_missing_citation", F.concat(F.lit("Supported claim has no evidence citation: "), quote(F.substr(s["line"], F.lit(3), F.lit(80))))))
    pair = r"^- (.+?)\s+\[([^\]]+)\]$"
    cited = F.flatten(F.transform(F.filter("sections", lambda s: s["claims"] & F.rlike(s["line"], F.lit(pair))), lambda s: F.transform(F.split(F.regexp_extract(s["line"], pair, 2), ","), lambda t: text.strip(t))))
    headings = F.transform(F.filter("sections", lambda s: (s["section"] == "## Evidence References") & F.startswith(s["line"], F.lit("### "))), lambda s: F.substr(s["line"], F.lit(5)))
    labels = F.col("_labels")
    lost = F.transform(F.filter(cited, lambda c: ~F.array_contains(labels, c)), lambda c: _issue("citation_unresolved", F.concat(F.lit("Citation ["), c, F.lit("] in claim is not found in evidence references"))))
    entries = F.col("_entries")
    names = F.transform(entries, lambda e: e["label"])
    times = lambda x: F.size(F.filter(names, lambda y: y == x))
    doubled = F.transform(F.filter(F.array_sort(F.array_distinct(names)), lambda x: times(x) > 1), lambda x: _issue("duplicate_evidence_label", F.concat(F.lit("Evidence label '"), x, F.lit("' appears "), times(x).cast("string"), F.lit(" times"))))
    lacks = lambda field, name: F.transform(F.filter(entries, lambda e: ~e[field]), lambda e: _issue(f"evidence_missing_{name}", F.concat(F.lit("Evidence '"), e["label"], F.lit(f"' is missing {name}"))))
    heading = F.when(~F.contains(F.col("body"), F.lit(f"## {brand.metadata_heading}")), _issue(brand.metadata_issue, F.lit(f"Body is missing '## {brand.metadata_heading}' section")))
    whole = F.concat(_issues(*required, *enums, policy, validation, count), uncited, lost, doubled, lacks("doc", "document_id"), lacks("chunk", "chunk_id"), _issues(heading))
    early = {
        "none": ("missing_frontmatter", "No YAML frontmatter (missing opening --- delimiter)"),
        "open": ("malformed_frontmatter", "YAML frontmatter has no closing --- delimiter"),
        "bad": ("malformed_frontmatter", "YAML frontmatter contains parse errors"),
    }
    found = whole
    for state, (code, said) in early.items():
        found = F.when(F.col("fm_state") == state, F.array(_issue(code, F.lit(said)))).otherwise(found)
    ready = text.staged(parsed, _entries=_entries(), _labels=headings)
    return text.staged(ready, issues=found).drop("_entries", "_labels")


def _with_sources(parsed: DataFrame) -> DataFrame:
    """Adds `sources`: struct(key, at, hash, info) of the sources a note names, the last of a key in it."""
    lines = F.transform(F.filter("sections", lambda s: s["section"] == "## Evidence References"), lambda s: s["line"])
    named = r"- \*\*Document\*\*: `([^`\n]+)`"

    def hashed(block):
        doc = F.regexp_extract(block[0], f"^{named}", 1)
        hashes = F.filter(F.transform(block, lambda x: F.regexp_extract(x, r"^- \*\*Source Raw Hash\*\*: `([^`]+)`", 1)), lambda h: (h != "") & (doc != ""))
        return F.transform(hashes, lambda h: F.struct(doc.alias("key"), h.alias("hash"), F.concat(F.lit("document_id='"), doc, F.lit("'")).alias("info")))

    in_body = F.flatten(F.transform(_cut(lines, f"### |{named}"), hashed))

    def top(d):
        some = lambda c: F.coalesce(c, F.lit("")) != ""
        said = F.when(some(d["document_id"]), F.concat(F.lit("document_id='"), d["document_id"], F.lit("'")))
        key = F.when(some(d["source_path"]), d["source_path"]).otherwise(d["document_id"])
        info = F.when(some(d["source_path"]), F.concat_ws(" ", F.concat(F.lit("source_path='"), d["source_path"], F.lit("'")), said)).otherwise(said)
        return F.struct(key.alias("key"), F.when(some(d["content_hash"]), d["content_hash"]).otherwise(d["source_raw_hash"]).alias("hash"), info.alias("info"))

    in_front = F.filter(F.transform("source_documents", top), lambda e: (F.coalesce(e["hash"], F.lit("")) != "") & (F.coalesce(e["key"], F.lit("")) != ""))
    ok = F.col("fm_state") == "ok"
    every = F.filter(F.concat(in_body, in_front), lambda e: ok)
    ordered = F.array_sort(F.transform(every, lambda e, i: F.struct(e["key"].alias("key"), (-i).alias("at"), e["hash"].alias("hash"), e["info"].alias("info"))))
    ready = text.staged(parsed, _sources=ordered)
    last = F.filter("_sources", lambda e, i: (i == 0) | (F.get(F.col("_sources"), i - 1)["key"] != e["key"]))
    return ready.withColumn("sources", last).drop("_sources")


def source_entries(parsed: DataFrame) -> DataFrame:
    """file_path, key, note_hash, info: the sources a note names, the last of a key in it."""
    rows = _with_sources(parsed).select("file_path", F.explode("sources").alias("e"))
    return rows.select("file_path", "e.key", F.col("e.hash").alias("note_hash"), "e.info")


def _drift(content_hash: Column, note_hash: Column, info: Column) -> Column:
    """The issue of a source under another hash than a manifest's, or null."""
    lacks = _issue("source_hash_missing_expected", F.concat(F.lit("Source "), info, F.lit(" not found in provided source manifest")), "warning")
    other = _issue("source_hash_mismatch", F.concat(F.lit("Source "), info, F.lit(" hash mismatch: note='"), note_hash, F.lit("', manifest='"), content_hash, F.lit("'")), "warning")
    return F.when(content_hash.isNull(), lacks).when(content_hash != note_hash, other)


def drift_issues(parsed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sources that a manifest (key, content_hash) lacks or knows with another hash; both warn."""
    joined = source_entries(parsed).join(manifest.select("key", "content_hash"), "key", "left")
    found = joined.select("file_path", _drift(F.col("content_hash"), F.col("note_hash"), F.col("info")).alias("i")).where("i is not null")
    return found.select("i.code", "i.severity", "i.message", "file_path")


def _cross(rows: DataFrame) -> DataFrame:
    """rows (file_path, fm_state, note_id, issues) with orphan_note and duplicate_note_id added.

    Rows without an id are dealt by their path, so they make no hot key of the window.
    """
    orphan = F.when(F.col("fm_state").isin("none", "open"), _issue("orphan_note", F.lit("Note has no valid frontmatter (orphaned Markdown file)"), "warning")).when(
        F.col("note_id").isNull(), _issue("orphan_note", F.lit("Note has no note_id in frontmatter (orphaned or foreign Markdown)"), "warning")
    )
    first = F.min("file_path").over(Window.partitionBy(F.col("note_id").isNull(), F.coalesce("note_id", "file_path")))
    said = F.concat(F.lit("Duplicate note_id '"), F.col("note_id"), F.lit("' in '"), F.col("_first"), F.lit("' and '"), F.col("file_path"), F.lit("'"))
    doubled = F.when(F.col("note_id").isNotNull() & (F.col("_first") != F.col("file_path")), _issue("duplicate_note_id", said))
    return rows.withColumn("_first", first).withColumn("issues", F.concat("issues", _issues(orphan, doubled))).drop("_first", "fm_state", "note_id")


def _note_id() -> Column:
    found = F.try_element_at(F.col("frontmatter"), F.lit("note_id"))
    return F.when(F.coalesce(found, F.lit("")) != "", found)


def _exploded(rows: DataFrame) -> DataFrame:
    return rows.select("file_path", F.explode("issues").alias("i")).select("i.code", "i.severity", "i.message", "file_path")


def cross_issues(parsed: DataFrame) -> DataFrame:
    """duplicate_note_id against the first path that has the id, and orphan_note."""
    none = F.array().cast("array<struct<code:string,severity:string,message:string>>")
    return _exploded(_cross(parsed.select("file_path", "fm_state", _note_id().alias("note_id"), none.alias("issues"))))


def note_issues(rows: DataFrame) -> DataFrame:
    """code, severity, message, file_path of rows with file_path, fm_state, note_id and their own issues."""
    return _exploded(_cross(rows.select("file_path", "fm_state", F.nullif(F.col("note_id"), F.lit("")).alias("note_id"), "issues")))


def linted(files: DataFrame, directory: bool = True, brand: Branding = Branding(), yaml: bool = False) -> DataFrame:  # noqa: B008  frozen
    """file_path, issues of every file, those without an issue too."""
    rows = file_issues(parse(files, yaml), brand).select(*_KEPT, _note_id().alias("note_id"))
    return (_cross(rows) if directory else rows).select("file_path", "issues")


def lint(files: DataFrame, manifest: DataFrame | None = None, directory: bool = True, brand: Branding = Branding(), yaml: bool = False) -> DataFrame:  # noqa: B008  frozen
    """code, severity, message, file_path of every issue; one pass over the files.

    With a manifest, issues and named sources leave a file as rows of one kind; only sources have
    a key to be joined, and issues are dealt by their path.
    """
    if manifest is None:
        return _exploded(linted(files, directory, brand, yaml))
    rows = _with_sources(file_issues(parse(files, yaml), brand)).select(*_KEPT, _note_id().alias("note_id"), "sources")
    rows = _cross(rows) if directory else rows
    none = F.lit(None)
    kind = "array<struct<i:struct<code:string,severity:string,message:string>,key:string,hash:string,info:string>>"
    said = F.transform("issues", lambda i: F.struct(i.alias("i"), none.alias("key"), none.alias("hash"), none.alias("info"))).cast(kind)
    named = F.transform("sources", lambda e: F.struct(none.alias("i"), e["key"].alias("key"), e["hash"].alias("hash"), e["info"].alias("info"))).cast(kind)
    each = rows.select("file_path", F.inline(F.concat(said, named))).withColumn("_deal", F.coalesce("key", F.concat(F.lit("\0"), "file_path")))
    joined = each.join(manifest.select(F.col("key").alias("_deal"), "content_hash"), "_deal", "left")
    found = joined.select("file_path", F.coalesce("i", F.when(F.col("key").isNotNull(), _drift(F.col("content_hash"), F.col("hash"), F.col("info")))).alias("i")).where("i is not null")
    return found.select("i.code", "i.severity", "i.message", "file_path")


def unrecognized(spark, path: str, problem: str) -> DataFrame:
    """The issue of a source manifest that cannot be read."""
    return spark.createDataFrame([("source_manifest_unrecognized", "error", problem, path)], _ISSUE)


def report(files: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: files_scanned, error_count, warning_count, passed."""
    counts = issues.agg(F.count_if(F.col("severity") == "error").alias("error_count"), F.count_if(F.col("severity") == "warning").alias("warning_count"))
    return files.agg(F.count(F.lit(1)).alias("files_scanned")).join(counts).withColumn("passed", F.col("error_count") == 0)


def report_json(files: DataFrame, issues: DataFrame, path: str) -> str:
    """The report file: counts and the issues in file, code, message order, one text on the driver; write_report
    is for more files than that holds."""
    rows = [r.asDict() for r in issues.orderBy("file_path", "code", "message").collect()]
    of = lambda severity: sum(r["severity"] == severity for r in rows)
    head = {"files_scanned": files.count(), "error_count": of("error"), "warning_count": of("warning"), "passed": of("error") == 0}
    return json.dumps({"path": path, **head, "issues": rows}, indent=2, ensure_ascii=False)


def write_report(rows: DataFrame, path: str, at: str) -> None:
    """The report of linted() rows as a folder that all tasks write: `head`, a row of counts, and `issues`, JSON lines
    whose part files hold them in file, code, message order. Files are linted once, into `files`."""
    rows.select("file_path", "issues").write.parquet(f"{at}/files")
    kept = rows.sparkSession.read.parquet(f"{at}/files")
    _exploded(kept).orderBy("file_path", "code", "message").withColumn("n", F.monotonically_increasing_id()).write.json(f"{at}/issues")
    of = lambda severity: F.coalesce(F.sum(F.size(F.filter("issues", lambda i: i["severity"] == severity))), F.lit(0))
    head = kept.agg(F.count(F.lit(1)).alias("files_scanned"), of("error").alias("error_count"), of("warning").alias("warning_count"))
    head.select(F.lit(path).alias("path"), "*", (F.col("error_count") == 0).alias("passed")).write.json(f"{at}/head")


def read_report(spark, at: str) -> tuple[DataFrame, DataFrame]:
    """What write_report wrote: the row of counts, and the issues with `position`, from 0.

    A row's number has its part above 33 bits and its place in that below; the parts before it are counted first.
    """
    head = spark.read.schema("path string, files_scanned long, error_count long, warning_count long, passed boolean").json(f"{at}/head")
    rows = spark.read.schema(f"n long, {_ISSUE}").json(f"{at}/issues").withColumn("_part", F.shiftright("n", 33))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))  # a row a part
    placed = rows.join(F.broadcast(starts), "_part").withColumn("position", F.col("_start") + F.col("n").bitwiseAND(F.lit((1 << 33) - 1)))
    return head, placed.select("position", "code", "severity", "message", "file_path")


def report_text(found: dict) -> str:
    """A report_json() object as text for readers: counts, then the issues under each file. Words are fixed."""
    counts = f"Files scanned: {found['files_scanned']}\nIssues: {found['error_count']} error(s), {found['warning_count']} warning(s)"
    parts = [f"Wiki Health Report: {found['path']}\n{counts}\nStatus: {'PASSED' if found['passed'] else 'FAILED'}\n"]
    for path, issues in groupby(sorted(found["issues"], key=lambda i: i["file_path"]), key=lambda i: i["file_path"]):
        parts.append("\n".join([f"  {path}:", *(f"    [{i['severity'].upper()}] {i['code']}: {i['message']}" for i in issues)]) + "\n")
    return "\n".join(parts if found["issues"] else [*parts, "No issues found."])
