"""Text functions as Column builders. Every regular expression of the engine is here.

Python's `\\s`, `\\b` and `\\d` are Unicode-aware; Java needs `(?U)`. White space is spelled out: a
class of ranges is matched several times faster than `(?U)\\s`, and U+001C..U+001F are white space
in Python only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE_SPACE = r"\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = rf"[\t-\r\x1c-\x20{WIDE_SPACE}]"
#: The characters of SPACE: trimming looks at the ends alone, where an expression tries every position.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"

#: Words that a refinement may add without a warning.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "must", "shall", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "during", "before",
    "after", "above", "below", "between", "under", "again", "further", "then", "once", "and", "but", "or", "nor", "so", "yet", "both", "either",
    "neither", "not", "only", "own", "same", "than", "too", "very", "just", "also", "this", "that", "these", "those", "i", "you", "he", "she", "it",
    "we", "they", "what", "which", "who", "whom",
)

#: Tokens a refinement may not lose (number, date, version, time, UUID, zone id).
NUMBER = r"(?U)\b\d+\.?\d*\b"
CRITICAL = (
    NUMBER,
    r"(?U)\b\d{4}-\d{2}-\d{2}\b",
    r"(?U)\b\d+\.\d+\.\d+\b",
    r"(?U)\b\d{1,2}:\d{2}(?::\d{2})?\b",
    r"(?U)\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
    r"(?U)\b[a-z]+-[a-z]+-\d+-[a-z]+\b",
)


def staged(df, **columns: Column):
    """df with columns that later steps refer to without computing them again.

    The optimizer inlines projections into filters and into each other; a generator's output it
    does not, so an expensive column that is used several times goes through one.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def fold(c: Column) -> Column:
    """Case folded: equal for texts that differ in case only, `ß` and `ss` among them."""
    many = {x: x.casefold() for x in map(chr, range(0x80, 0x10000)) if len(x.casefold()) > 1}  # characters that fold to several
    table = F.create_map(*[F.lit(s) for kv in many.items() for s in kv])
    spelled = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    wide = F.when(F.rlike(c, F.lit(f"[{''.join(many)}]")), spelled).otherwise(c)
    kept = F.translate(wide, "\u0131", "\ue131")  # dotless i has no case partner
    return F.translate(F.lower(F.upper(kept)), "\u03c2\ue131", "\u03c3\u0131")


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def trimmed(c: Column) -> Column:
    """c without blanks and newlines at its ends."""
    return F.trim(c, F.lit(" \n"))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def found(c: Column, pattern: str) -> Column:
    """All matches of a pattern, in order."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


#: Letters and digits one by one, as Java has one table for single characters and tries ranges in turn.
TOKEN = "[0123456789abcdefghijklmnopqrstuvwxyz]"


def tokens(c: Column, lowered: bool = False) -> Column:
    """Lower-cased ASCII letter and digit runs."""
    return found(c if lowered else F.lower(c), f"{TOKEN}+")


def count_tokens(c: Column) -> Column:
    """How many tokens a lower-cased text has."""
    return F.regexp_count(c, F.lit(f"{TOKEN}+"))


def present(c: Column, query_tokens: list[str]) -> Column:
    """The tokens of a lower-cased text that are query tokens, in order; other tokens are not made."""
    return found(c, f"(?<!{TOKEN})(?:{'|'.join(sorted(set(query_tokens)))})(?!{TOKEN})")


def word_set(c: Column) -> Column:
    return F.array_distinct(found(F.lower(c), r"(?U)\b[a-zA-Z]+\b"))


def number_set(c: Column) -> Column:
    return F.array_distinct(found(c, NUMBER))


def critical_set(c: Column) -> Column:
    return F.array_distinct(reduce(lambda a, b: F.concat(a, b), [found(c, p) for p in CRITICAL]))


def search_text(policy: str, raw: Column, cleaned: Column) -> Column:
    raw, cleaned = F.coalesce(raw, F.lit("")), F.coalesce(cleaned, F.lit(""))
    return {"raw_only": raw, "cleaned_only": cleaned}.get(policy, F.concat(raw, F.lit(" "), cleaned))


def searched(policy: str, raw: Column, cleaned: Column) -> tuple[Column, Column]:
    """(lower-cased text, number of times) that a policy searches: texts that differ by their ends'
    white space alone have the same tokens, so both together are one of them twice."""
    whole = F.lower(search_text(policy, raw, cleaned))
    if policy in ("raw_only", "cleaned_only"):
        return whole, F.lit(1)
    same = F.coalesce(trimmed(raw) == cleaned, F.lit(False))
    return F.when(same, F.lower(raw)).otherwise(whole), F.when(same, F.lit(2)).otherwise(F.lit(1))


def let(value: Column, body):
    """body(value) with value computed once, also inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def among(tokens: Column, query_tokens: list[str]) -> Column:
    """The tokens that are query tokens."""
    return F.filter(tokens, lambda t: t.isin(*sorted(set(query_tokens))))


def occurrences(query_tokens: list[str], present: Column) -> Column:
    """How often each query token, in their order, is among a text's tokens."""
    wanted = F.array(*[F.lit(t) for t in query_tokens])
    return F.transform(wanted, lambda q: F.size(F.filter(present, lambda t: t == q)))


def counted_score(counts: Column, length: Column, times: Column | None = None) -> Column:
    """Saturated term frequency over occurrences(), damped by length, at most 1; see term_score."""
    times = F.lit(1) if times is None else times

    def gain(n):
        return F.when(n > 0, n * 1.5 / (n + 0.5)).otherwise(F.lit(0.0))

    total = F.aggregate(F.transform(counts, lambda n: (times * n).cast("double")), F.lit(0.0), lambda acc, n: acc + gain(n))
    return F.least(F.lit(1.0), total / (F.lit(1.0) + times * length * F.lit(0.001)))


def term_score(query_tokens: list[str], present: Column, length: Column, times: Column | None = None) -> Column:
    """Saturated term frequency over query tokens in their order, damped by length, at most 1.

    present: the text's tokens that are query tokens; length: the number of all its tokens; the
    text counts `times` times.
    """
    return counted_score(occurrences(query_tokens, present), length, times)


def hash_score(query: Column, chunk_id: Column) -> Column:
    """Placeholder vector score: the first 32 bits of sha256(`query:chunk_id`) over their maximum."""
    head = F.substring(F.sha2(F.concat(query, F.lit(":"), chunk_id), 256), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(4294967295.0)


def slug(title: Column) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(made == "", F.lit("note")).otherwise(made)


def yaml_scalar(c: Column) -> Column:
    """A string as a double-quoted scalar; null and empty are `""`."""
    out = F.coalesce(c, F.lit(""))
    for plain, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return F.concat(F.lit('"'), out, F.lit('"'))


def python_list(items: Column) -> Column:
    """The text a list of plain words prints as."""
    return F.when(F.size(items) == 0, F.lit("[]")).otherwise(F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']")))


def quoted(c: Column) -> Column:
    """The text a string without quotes or control characters prints as."""
    both = F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"')), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(both)


def blockquote(c: Column) -> Column:
    lines = F.split(F.regexp_replace(c, rf"(?:{LINE_ENDS})\z", ""), LINE_ENDS)
    return F.array_join(F.transform(lines, lambda x: F.when(x == "", F.lit(">")).otherwise(F.concat(F.lit("> "), x))), "\n")
