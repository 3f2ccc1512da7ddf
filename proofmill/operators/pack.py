"""Evidence packs: keep-first de-duplication, greedy whole-item budgets, context, ids, audit.

Input is the result of retrieve(): a run has at most top_k rows, so a run's rows meet as one
sorted array and the budget is a fold over it. Runs are independent of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofmill.config import ContextPolicy, EvidenceBudget, SelectionPolicy
from proofmill.functions import ids

RUN = ("retrieval_run_id", "query_hash")


def deduplicate(results: DataFrame, policy: SelectionPolicy | None = None) -> DataFrame:
    """Adds reason and detail (null for the first of each key, in rank order)."""
    by_hash = (policy or SelectionPolicy()).deduplicate_by == "raw_text_hash"
    key = ["raw_text_hash"] if by_hash else ["document_id", "chunk_id"]
    first = F.row_number().over(Window.partitionBy(*RUN, *key).orderBy("rank")) == 1
    said = F.concat(F.lit("duplicate of raw_text_hash="), F.col("raw_text_hash")) if by_hash else F.concat(F.lit("duplicate of (document_id="), F.col("document_id"), F.lit(", chunk_id="), F.col("chunk_id"), F.lit(")"))
    reason = F.lit("duplicate_raw_text_hash" if by_hash else "duplicate_document_chunk")
    return results.withColumns({"reason": F.when(~first, reason), "detail": F.when(~first, said)})


def _budget_reasons(items: Column, budget: EvidenceBudget, context: ContextPolicy) -> Column:
    """Array of reasons (null: selected) for an array of struct(raw, cleaned) sizes in rank order."""
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("n"), zero.alias("raw"), zero.alias("cleaned"), zero.alias("context"), F.array().cast("array<string>").alias("out"))

    def step(s, i):
        size = (i["raw"] if context.include_raw_text else zero) + (i["cleaned"] if context.include_cleaned_text else zero)
        reason = F.lit(None).cast("string")
        checks = [
            ("max_context_chars", s["context"] + size, budget.max_context_chars), ("max_cleaned_chars", s["cleaned"] + i["cleaned"], budget.max_cleaned_chars),
            ("max_raw_chars", s["raw"] + i["raw"], budget.max_raw_chars), ("max_items", s["n"] + 1, budget.max_items),
        ]
        for name, value, most in checks:  # the last one tested wins: items, raw, cleaned, context
            if most is not None:
                reason = F.when(value > most, F.lit(f"{name}_exceeded")).otherwise(reason)
        taken = reason.isNull().cast("long")
        return F.struct(
            (s["n"] + taken).alias("n"), (s["raw"] + taken * i["raw"]).alias("raw"), (s["cleaned"] + taken * i["cleaned"]).alias("cleaned"),
            (s["context"] + taken * size).alias("context"), F.concat(s["out"], F.array(reason)).alias("out"),
        )

    return F.aggregate(items, start, step, lambda s: s["out"])


def select_items(results: DataFrame, selection: SelectionPolicy | None = None, budget: EvidenceBudget | None = None, context: ContextPolicy | None = None) -> DataFrame:
    """Every input row with its reason (null: selected) and item_no of the selected ones."""
    marked = deduplicate(results, selection)
    if budget is None or budget == EvidenceBudget():
        judged = marked
    else:
        sizes = F.struct("rank", "document_id", "chunk_id", F.length("raw_text").cast("long").alias("raw"), F.length("cleaned_text").cast("long").alias("cleaned"))
        runs = marked.where("reason is null").groupBy(*RUN).agg(F.array_sort(F.collect_list(sizes)).alias("items"))
        folded = runs.withColumn("reasons", _budget_reasons(F.col("items"), budget, context or ContextPolicy()))
        rows = folded.select(*RUN, F.explode(F.arrays_zip("items", "reasons")).alias("z")).select(*RUN, F.col("z.items.rank").alias("rank"), F.col("z.reasons").alias("_b"))
        judged = marked.join(rows, [*RUN, "rank"], "left").withColumn("reason", F.coalesce("reason", "_b")).drop("_b")
    number = F.row_number().over(Window.partitionBy(*RUN, F.col("reason").isNull()).orderBy("rank"))
    return judged.withColumn("item_no", F.when(F.col("reason").isNull(), number))


def exclusions(selected: DataFrame) -> DataFrame:
    """Excluded rows in audit order: duplicates first, then budget, each by rank."""
    field = F.when(~F.startswith(F.col("reason"), F.lit("duplicate")), F.regexp_replace("reason", "_exceeded$", ""))
    late = field.isNotNull().cast("int")
    number = F.row_number().over(Window.partitionBy(*RUN).orderBy(late, "rank"))
    return selected.where("reason is not null").select(*RUN, number.alias("exclusion_no"), "document_id", "chunk_id", "reason", field.alias("budget_field"), "detail")


def item_context(number: Column, context: ContextPolicy) -> Column:
    """The text block of one selected item."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c)
    has_hash = F.coalesce("cleaned_text_hash", F.lit("")) != ""
    parts = [
        F.concat(F.lit("[EVIDENCE "), number.cast("string"), F.lit("]")), line("document_id", F.col("document_id")), line("chunk_id", F.col("chunk_id")),
        line("source_path", F.col("source_path")), line("retrieval_rank", F.col("rank").cast("string")), line("retrieval_source", F.col("retrieval_source")),
        line("source_retrievers", F.array_join("source_retrievers", ",")), line("raw_text_hash", F.col("raw_text_hash")),
        F.when(has_hash, line("cleaned_text_hash", F.col("cleaned_text_hash"))), F.lit(""),
    ]
    for on, name, c in ((context.include_raw_text, "RAW_TEXT:", "raw_text"), (context.include_cleaned_text, "CLEANED_TEXT:", "cleaned_text")):
        if on:
            parts += [F.lit(name), F.coalesce(F.col(c), F.lit("")), F.lit("")]
    return F.concat_ws("\n", *parts)


def build_pack(results: DataFrame, selection: SelectionPolicy | None = None, budget: EvidenceBudget | None = None, context: ContextPolicy | None = None) -> DataFrame:
    """One row per run: pack_id, items, context, exclusions and counts."""
    selection, context = selection or SelectionPolicy(), context or ContextPolicy()
    rows = select_items(results, selection, budget, context)
    item = F.struct("rank", "item_no", "document_id", "chunk_id", "source_path", "source_type", "raw_text", "cleaned_text", "raw_text_hash", "cleaned_text_hash", "keyword_score", "vector_score", "hybrid_score", "retrieval_source", "source_retrievers", "matched_fields")
    late = (~F.startswith(F.col("reason"), F.lit("duplicate"))).cast("int")
    gone = F.struct(late.alias("late"), F.col("rank"), F.col("document_id"), F.col("chunk_id"), F.col("reason"), F.col("detail"))
    chosen = F.col("reason").isNull()
    block = F.struct("item_no", item_context(F.col("item_no"), context).alias("text"))
    packs = rows.groupBy(*RUN).agg(
        F.first("query").alias("query"), F.count(F.lit(1)).alias("total_input_results"),
        F.array_sort(F.collect_list(F.when(chosen, item))).alias("items"), F.array_sort(F.collect_list(F.when(chosen, block))).alias("_blocks"),
        F.array_sort(F.collect_list(F.when(~chosen, gone))).alias("exclusions"),
    )
    pairs = F.transform("items", lambda i: F.concat(i["document_id"], F.lit(":"), i["chunk_id"]))
    return packs.select(
        ids.pack_id(F.col("retrieval_run_id"), F.col("query_hash"), pairs, selection, context, budget).alias("pack_id"), *RUN, "query", "items",
        F.array_join(F.transform("_blocks", lambda b: b["text"]), "\n").alias("context"), "exclusions", "total_input_results",
        F.size("items").alias("total_selected_items"), F.size("exclusions").alias("total_excluded_items"),
    )


def to_json(packs: DataFrame) -> DataFrame:
    """pack_id and the pack as one JSON text; nulls are kept so that it reads back whole."""
    return packs.select("pack_id", F.to_json(F.struct(*packs.columns), {"ignoreNullFields": "false"}).alias("json"))


def from_json(rows: DataFrame, schema: T.StructType, column: str = "json") -> DataFrame:
    """Packs from JSON texts; missing strings and lists take their empty values, other keys null."""
    parsed = rows.select(F.from_json(column, schema).alias("p")).select("p.*")
    defaults = {f.name: F.coalesce(f.name, F.lit("")) for f in schema.fields if isinstance(f.dataType, T.StringType)}
    defaults |= {f.name: F.coalesce(f.name, F.array().cast(f.dataType)) for f in schema.fields if isinstance(f.dataType, T.ArrayType)}
    return parsed.withColumns(defaults)
