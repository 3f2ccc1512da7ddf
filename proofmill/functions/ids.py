"""Identities: every id and hash of the data model, bit for bit."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofmill.config import policy_fields
from proofmill.functions import text


def sha(c: Column) -> Column:
    return F.sha2(c, 256)


def document_id(path: Column, content_hash: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(sha(path), 1, 12), F.lit("_"), F.substring(content_hash, 1, 12))


def chunk_id(doc: Column, index: Column) -> Column:
    return F.concat(F.lit("chunk_"), doc, F.lit("_"), index.cast("string"))


def source_type(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(suffix.isin(".md", ".markdown"), F.lit("md")).otherwise(F.lit("txt"))


def supported_file(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(".txt", ".md", ".markdown")


def text_hash(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()


def policy_hash(policy) -> str:
    return text_hash(policy_fields(policy))[:16]


def pack_id(run_id: Column, query_hash: Column, pairs: Column, selection, context, budget) -> Column:
    """pairs: array of `document:chunk` in pack order."""
    tail = [policy_hash(selection), policy_hash(context), policy_hash(budget) if budget is not None else "no_budget"]
    return sha(F.concat_ws("|", run_id, query_hash, pairs, *[F.lit(x) for x in tail]))


def note_filename(title: Column, note_id: Column) -> Column:
    """`<slug>--id-<hex>.md`; null where the note id is blank."""
    encoded = F.concat(F.lit("id-"), F.lower(F.hex(F.encode(note_id, "UTF-8"))), F.lit(".md"))
    named = F.when(text.strip(F.coalesce(title, F.lit(""))) == "", encoded).otherwise(F.concat(text.slug(title), F.lit("--"), encoded))
    return F.when(text.strip(note_id) != "", named)
