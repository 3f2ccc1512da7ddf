"""Rule-based refinement, the no-new-facts check, guardrails, the optional model hook, roll-ups."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.functions import ids, text
from proofmill.operators.replies import ReplyTable, answers

PROMPT_VERSION = "v1.0"


#: White space but single blanks and newlines: a text without a character of the first class, which is wider
#: and quick to look for (Java has one table for single characters, ranges are tried in turn), has none.
_MAYBE_ODD, ODD = r"[\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680-\u3000]", rf"[\t\x0b-\r\x1c-\x1f{text.WIDE_SPACE}]"
#: What else trimming the ends does not refine: runs, a blank before a newline, marks of a protected line.
UNEVEN = ("  ", " \n", "\n\n\n", "|", "---", "===")
#: Where this is not found no line is protected.
EVIDENCE = rf"---|===|\||[:=]{text.SPACE}{{2}}|(?:^|{text.LINE_ENDS})(?:    |\t)"


def protected(line: Column) -> Column:
    """Lines whose inner white space is evidence: rules, tables, key/value and assignment columns, code."""
    marks = lambda bare: (bare != "") & (F.startswith(bare, F.lit("---")) | F.startswith(bare, F.lit("===")) | F.startswith(bare, F.lit("|")) | F.endswith(bare, F.lit("|")))
    wide = F.rlike(line, F.lit(rf"[:=]{text.SPACE}{{2,}}"))
    code = F.startswith(line, F.lit("    ")) | F.startswith(line, F.lit("\t"))
    return text.let(text.strip(line), lambda bare: marks(bare) | ((bare != "") & (wide | code)))


def uneven(raw: Column) -> Column:
    """Whether a text may have something inside that refine() changes, or a protected line."""
    odd = F.rlike(raw, F.lit(_MAYBE_ODD)) & F.rlike(raw, F.lit(ODD))
    return reduce(lambda a, b: a | b, [F.contains(raw, F.lit(x)) for x in UNEVEN], odd)


def refine(raw: Column) -> Column:
    """Trim, collapse runs of newlines to two, collapse blanks inside unprotected lines, right-trim lines.

    Most texts have nothing inside to collapse and no protected line, which uneven() tells.
    """
    raw = F.coalesce(raw, F.lit(""))
    return F.when(~uneven(raw), text.trimmed(raw)).otherwise(_refine_lines(raw))


def _refine_lines(raw: Column) -> Column:
    maybe = F.rlike(raw, F.lit(EVIDENCE))
    has_evidence = maybe & F.exists(F.split(raw, text.LINE_ENDS), protected)
    bare = F.when(has_evidence, F.regexp_replace(raw, r"^\n+|\n+\z", "")).otherwise(text.strip(raw))
    lines = F.split(F.regexp_replace(bare, r"\n{3,}", "\n\n"), "\n")

    def squeeze(line: Column) -> Column:
        lead = F.regexp_extract(line, rf"^({text.SPACE}*)", 1)
        return F.concat(lead, F.regexp_replace(F.substr(line, F.length(lead) + 1), rf"{text.SPACE}{{2,}}", " "))

    wide = lambda line: F.when(F.rlike(line, F.lit(rf"{text.SPACE}{{2}}")), squeeze(line)).otherwise(line)
    kept = F.transform(lines, lambda line: text.rstrip(F.when(protected(line), line).otherwise(wide(line))))
    return F.array_join(F.when(maybe, kept).otherwise(F.transform(lines, lambda line: text.rstrip(wide(line)))), "\n")


def added_words(raw: Column, cleaned: Column, least: int = 3) -> Column:
    stop = F.array(*[F.lit(w) for w in text.STOP_WORDS])
    new = F.array_except(F.array_except(text.word_set(cleaned), text.word_set(raw)), stop)
    return F.array_sort(F.filter(new, lambda w: F.length(w) >= least))


def added_numbers(raw: Column, cleaned: Column) -> Column:
    return F.array_sort(F.array_except(text.number_set(cleaned), text.number_set(raw)))


def expansion(raw: Column, cleaned: Column) -> Column:
    """Percent by which the cleaned text is longer; 0 if it is not."""
    grown = (F.length(cleaned) - F.length(raw)) / F.length(raw) * 100
    return F.when((F.length(raw) > 0) & (F.length(cleaned) > F.length(raw)), grown).otherwise(F.lit(0.0))


def check_facts(raw: Column, cleaned: Column) -> Column:
    """struct(added_words, added_numbers, length_expansion, empty_cleaned, excessive_changes).

    A text that was only trimmed has the words and numbers it had: they are looked for in others alone."""
    some = (raw != "") & (cleaned != text.trimmed(raw))
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(some, added_words(raw, cleaned)).otherwise(none).alias("added_words"),
        F.when(some, added_numbers(raw, cleaned)).otherwise(none).alias("added_numbers"),
        expansion(raw, cleaned).alias("length_expansion"),
        ((raw != "") & (cleaned == "")).alias("empty_cleaned"),
        (expansion(raw, cleaned) > 20).alias("excessive_changes"),
    )


def _messages(*found: tuple[Column, Column]) -> Column:
    return F.filter(F.array(*[F.when(on, said) for on, said in found]), lambda m: m.isNotNull())


def _percent(c: Column) -> Column:
    """One decimal, half to even on the exact value, as Python prints it."""
    return F.format_string("%.1f%%", c)


def fact_warnings(facts: Column) -> Column:
    words, numbers = facts["added_words"], facts["added_numbers"]
    return _messages(
        (F.size(words) > 0, F.concat(F.lit("added_words: "), text.python_list(F.slice(words, 1, 5)))),
        (F.size(numbers) > 0, F.concat(F.lit("added_numbers: "), text.python_list(F.slice(numbers, 1, 5)))),
        (facts["empty_cleaned"], F.lit("empty_cleaned_from_nonempty_raw")),
        (facts["excessive_changes"], F.concat(F.lit("excessive_length_expansion: "), _percent(facts["length_expansion"]))),
    )


def guardrails(raw: Column, cleaned: Column, max_expansion: float = 20.0, max_compression: float = 30.0, loss_threshold: float = 0.0) -> Column:
    """struct(passed, violations, cleaned_text): whether a model's text may replace the raw one."""
    empty = (raw != "") & (cleaned == "")
    none = F.array().cast("array<string>")
    same = (cleaned == raw) | (cleaned == text.trimmed(raw))  # then nothing is added or lost
    unless = lambda c: F.when(same, none).otherwise(c)
    words, numbers = unless(added_words(raw, cleaned, 4)), unless(added_numbers(raw, cleaned))
    critical = unless(text.critical_set(raw))
    lost = unless(F.array_sort(F.array_except(critical, text.critical_set(cleaned))))
    loss = F.when(F.size(critical) > 0, F.size(lost) / F.size(critical) * 100).otherwise(F.lit(0.0))
    shrunk = F.when(F.length(raw) > 0, (F.length(raw) - F.length(cleaned)) / F.length(raw) * 100).otherwise(F.lit(0.0))
    grown = expansion(raw, cleaned)
    some = raw != ""
    rest = _messages(
        (some & (F.size(numbers) > 0), F.concat(F.lit("added_numbers: "), text.python_list(F.slice(numbers, 1, 5)))),
        (some & (F.size(words) > 0), F.concat(F.lit("added_words: "), text.python_list(F.slice(words, 1, 5)))),
        ((F.size(lost) > 0) & (loss > loss_threshold), F.concat(F.lit("critical_token_loss: "), text.python_list(F.slice(lost, 1, 5)), F.lit(" ("), _percent(loss), F.lit(" loss)"))),
        (grown > max_expansion, F.concat(F.lit("excessive_expansion: "), _percent(grown), F.lit(f" > {max_expansion}%"))),
        ((grown <= max_expansion) & (shrunk > max_compression), F.concat(F.lit("excessive_compression: "), _percent(shrunk), F.lit(f" > {max_compression}%"))),
    )
    violations = F.when(empty, F.array(F.lit("empty_cleaned_from_nonempty_raw"))).otherwise(rest)
    return F.struct((F.size(violations) == 0).alias("passed"), violations.alias("violations"), F.when(F.size(violations) == 0, cleaned).alias("cleaned_text"))


def strip_fence(reply: Column) -> Column:
    """A reply without the Markdown code fence that models put around JSON."""
    return text.strip(F.regexp_replace(text.strip(reply), r"(?s)^```[A-Za-z]*\s*\n?(.*?)\n?```$", "$1"))


def json_problem(reply: Column) -> Column:
    """Null if a model's reply is an object with a string `cleaned_text`, else what is wrong."""
    parsed = F.try_parse_json(reply)
    kind = F.schema_of_variant(parsed)
    value = F.try_variant_get(parsed, "$.cleaned_text", "variant")
    return (
        F.when(parsed.isNull(), F.lit("Invalid JSON"))
        .when(~F.startswith(kind, F.lit("OBJECT")), F.lit("Not a JSON object"))
        .when(value.isNull(), F.lit("Missing 'cleaned_text' field"))
        .when(F.schema_of_variant(value) != "STRING", F.lit("cleaned_text is not a string"))
    )


def prompt(raw: Column, version: str = PROMPT_VERSION) -> Column:
    """The instruction a model gets for one chunk."""
    head = (
        "Normalize white space and formatting of the text between the rules and keep all content.\n"
        "Keep every fact, number, name, date and id as it is; add, drop, summarize and translate nothing.\n"
        f"Prompt version: {version}\n---\n"
    )
    return F.concat(F.lit(head), raw, F.lit('\n---\nAnswer with one JSON object: {"cleaned_text": "..."}'))


def clean_chunks(chunks: DataFrame) -> DataFrame:
    """Adds cleaned_text and cleaned_text_hash."""
    refined = chunks.withColumn("cleaned_text", refine(F.col("raw_text")))  # a projection, so that who reads ids only is spared it
    return refined.withColumn("cleaned_text_hash", ids.sha(F.col("cleaned_text")))


def refine_chunks(chunks: DataFrame, version: str = PROMPT_VERSION) -> DataFrame:
    """clean_chunks and the refinement record."""
    raw, cleaned = F.col("raw_text"), F.col("cleaned_text")
    done = text.staged(clean_chunks(chunks), _facts=check_facts(raw, cleaned))
    record = F.struct(
        F.lit("rule_based").alias("refinement_method"), F.lit(version).alias("prompt_version"), F.lit(None).cast("string").alias("model_name"),
        fact_warnings(F.col("_facts")).alias("warnings"), (raw != "").alias("no_new_facts_checked"), F.when(raw != "", ids.sha(raw)).alias("source_raw_hash"),
        F.length(raw).alias("raw_text_length"), F.length(cleaned).alias("cleaned_text_length"),
        F.lit(False).alias("model_refinement_attempted"), F.lit(False).alias("model_refinement_accepted"), F.lit(None).cast("string").alias("fallback_reason"),
    )
    return done.withColumn("refinement", record).drop("_facts")


Model = Callable[[Iterator[str]], Iterator[str]]


def refine_with_model(chunks: DataFrame, model: Model | None, model_name: str = "", version: str = PROMPT_VERSION, table: ReplyTable | None = None) -> DataFrame:
    """refine_chunks, then each chunk whose model reply passes JSON check and guardrails takes it.

    `model` maps prompts to JSON replies and gets the prompts of an Arrow batch at once on the
    executors; None, or one whose `available()` says no when the plan is made, is an unavailable
    adapter. A reply that fails keeps the rule-based text and says why; after it, the model goes on
    with the rest of the batch. With a `table`, replies are asked for once, written, and joined.
    """
    base = refine_chunks(chunks, version)
    if model is None or not getattr(model, "available", lambda: True)():
        return base.withColumn("refinement", F.col("refinement").withField("fallback_reason", F.lit("adapter_unavailable")))

    if table is not None:
        table.ask(base.select(prompt(F.col("raw_text"), version).alias("prompt")), model)
        known = table.replies().select(F.col("prompt_hash").alias("_hash"), F.col("reply").alias("_reply"))
        asked = base.withColumn("_hash", ids.sha(prompt(F.col("raw_text"), version))).join(known, "_hash", "left").drop("_hash")
    else:

        @F.pandas_udf("string")
        def ask(batch):
            import pandas as pd

            return pd.Series(answers(model, list(batch)))

        # not deterministic: no second reference may call the model again
        asked = base.withColumn("_reply", ask.asNondeterministic()(prompt(F.col("raw_text"), version)))
    asked = asked.withColumn("_reply", strip_fence(F.col("_reply")))
    asked = asked.withColumns({"_problem": json_problem(F.col("_reply")), "_text": F.get_json_object("_reply", "$.cleaned_text")})
    # the list alone: a struct's fields would each be inlined, the checks with them
    judged = asked.withColumn("_violations", guardrails(F.col("raw_text"), F.coalesce("_text", F.lit("")))["violations"])
    passed = F.size("_violations") == 0
    good = F.col("_problem").isNull() & passed
    reason = F.when(F.col("_problem").isNotNull(), F.concat(F.lit("model_error: "), F.col("_problem"))).when(~passed, F.lit("guardrail_violation"))
    record = (
        F.col("refinement")
        .withField("refinement_method", F.when(good, F.lit("model_based")).otherwise(F.lit("rule_based")))
        .withField("model_name", F.when(good, F.lit(model_name)))
        .withField("model_refinement_attempted", F.lit(True))
        .withField("model_refinement_accepted", good)
        .withField("fallback_reason", reason)
        .withField("warnings", F.when(good, F.array().cast("array<string>")).otherwise(F.concat(F.col("refinement.warnings"), F.when(F.col("_problem").isNull(), F.col("_violations")).otherwise(F.array().cast("array<string>")))))
    )
    out = judged.withColumn("refinement", record).withColumn("cleaned_text", F.when(good, F.col("_text")).otherwise(F.col("cleaned_text")))
    return out.withColumn("cleaned_text_hash", ids.sha(F.col("cleaned_text"))).drop("_reply", "_problem", "_text", "_violations")


def _rollup_parts() -> list[Column]:
    """What a document's chunks add up to."""
    r = F.col("refinement")
    tried, taken = r["model_refinement_attempted"], r["model_refinement_accepted"]
    return [
        F.count(F.lit(1)).alias("total_chunks"),
        F.max("end_offset").cast("long").alias("total_raw_chars"),
        F.sum(F.length("cleaned_text")).alias("total_cleaned_chars"),
        F.count_if(tried).alias("model_attempts"),
        F.count_if(tried & taken).alias("model_accepts"),
        F.count_if(tried & ~taken).alias("model_fallbacks"),
        F.min(r["model_name"]).alias("model_name"),
        F.array_sort(F.collect_set(r["fallback_reason"])).alias("reasons"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(r["warnings"])))).alias("warnings"),
    ]


def _rolled(sums: DataFrame) -> DataFrame:
    """The method, model and reasons of documents whose chunks were added up."""
    all_taken = (F.col("model_attempts") > 0) & (F.col("model_fallbacks") == 0)
    partial = F.concat(F.lit("partial_fallback: "), F.col("model_fallbacks").cast("string"), F.lit("/"), F.col("model_attempts").cast("string"), F.lit(" chunks"))
    reason = F.when(F.array_contains("reasons", "adapter_unavailable"), F.lit("adapter_unavailable")).when(F.size("reasons") > 0, partial)
    return sums.withColumns(
        {
            "refinement_method": F.when(all_taken, F.lit("model_based")).otherwise(F.lit("rule_based")),
            "model_name": F.when(all_taken, F.col("model_name")),
            "fallback_reason": reason,
            "warnings": F.array_sort(F.array_union("warnings", "reasons")),
        }
    ).drop("reasons")


def document_rollup(chunks: DataFrame) -> DataFrame:
    """One row per document over its refined chunks; partial sums before the shuffle.

    A document is model based if every tried chunk took the model's text; else it says why not.
    """
    return _rolled(chunks.groupBy("document_id").agg(*_rollup_parts()))


def result_json(chunks: DataFrame) -> DataFrame:
    """document_id, json: a document's refinement as one JSON text, chunks in order.

    A document is one JSON object, so its chunks meet in one task: they are gathered and added up in one
    grouping, and where the documents were dealt by their id before they were cut, no chunk moves.
    """
    chunk = F.struct("chunk_index", "chunk_id", "raw_text", "cleaned_text", "start_offset", "end_offset", "raw_text_hash", "metadata")
    in_order = F.array_sort(F.collect_list(chunk), lambda a, b: a["chunk_index"] - b["chunk_index"])
    first = F.min_by(F.struct("refinement.prompt_version", "refinement.no_new_facts_checked"), "chunk_index")
    rolled = _rolled(chunks.groupBy("document_id").agg(in_order.alias("chunks"), first.alias("_r"), *_rollup_parts()))
    meta = F.struct(
        "refinement_method", F.col("_r.prompt_version").alias("prompt_version"), "model_name", "warnings", F.col("_r.no_new_facts_checked").alias("no_new_facts_checked"),
        F.col("total_raw_chars").alias("raw_text_length"), F.col("total_cleaned_chars").alias("cleaned_text_length"),
        (F.col("model_attempts") > 0).alias("model_refinement_attempted"), ((F.col("model_attempts") > 0) & (F.col("model_fallbacks") == 0)).alias("model_refinement_accepted"), "fallback_reason",
    ).alias("metadata")
    whole = F.struct("document_id", "chunks", meta, "total_chunks", "total_raw_chars", "total_cleaned_chars")
    return rolled.select("document_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))
