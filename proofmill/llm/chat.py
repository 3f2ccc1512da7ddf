r"""Chat formatting [native]: a template whose rendered text parses back to its turns.

A turn is rendered as ``### Label: text</turn>\n``. Known roles have a label; any other role
is written ``role=<hex of its UTF-8>``. The control strings inside a text are ``</turn>`` and
``### ``; escaping puts one more backslash into each occurrence (``<\/turn>``, ``##\# ``) and
into occurrences that already hold some, so unescaping takes exactly one away and every text
comes back. A conversation is first rendered with its texts as they are and parsed; where a
turn differs from its source, which any bare control string or look-alike of an escaped one
brings about, the conversation is rendered escaped and parsed again, and a conversation that
still differs stops the job.

Defined cases: null role or text is empty; a very long text is kept whole; turns go by turn, then
role, then text, null turn first, repeated rows stay; null conv_id is one conversation; an empty
table gives no rows; other columns are dropped, whatever their names. A conversation is one
string in the output, so its turns meet in one task, as a document's text does; every step over
the turns is linear in them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template.
LABELS = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
HEAD, COLON, END = "### ", ": ", "</turn>\n"
LOSS_ROLES = ("assistant",)


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*)/turn>", r"<\\$1/turn>"), r"##(\\*)# ", r"##\\$1# ")


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"##\\(\\*)# ", "##$1# "), r"<\\(\\*)/turn>", "<$1/turn>")


def _label(role: Column) -> Column:
    other = F.concat(F.lit("role="), F.lower(F.hex(F.encode(role, "UTF-8"))))
    return reduce(lambda c, kv: F.when(role == kv[0], F.lit(kv[1])).otherwise(c), LABELS.items(), other)


def _role(label: Column) -> Column:
    other = F.decode(F.unhex(F.substr(label, F.lit(len("role=") + 1))), "UTF-8")
    return reduce(lambda c, kv: F.when(label == kv[1], F.lit(kv[0])).otherwise(c), LABELS.items(), other)


def render(turns: Column, body) -> Column:
    """turns: array of struct(role, text)."""
    one = lambda t: F.concat(F.lit(HEAD), _label(t["role"]), F.lit(COLON), body(t["text"]), F.lit(END))
    return F.array_join(F.transform(turns, one), "")


def _segments(formatted: Column) -> Column:
    parts = F.split(formatted, END, -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def parse(formatted: Column) -> Column:
    """The parser: array of struct(role, text), unescaped. It cuts at every end mark; what then
    does not start as a turn, or holds a bare turn head inside its text, reads as a null role."""
    parts = F.split(formatted, END.strip(), -1)
    lines = F.transform(parts, lambda s, i: F.when((i > 0) & F.startswith(s, F.lit("\n")), F.substr(s, F.lit(2))).otherwise(s))
    colon = lambda s: F.instr(s, COLON)
    body = lambda s: F.substr(s, colon(s) + len(COLON))
    whole = lambda s: F.startswith(s, F.lit(HEAD)) & (colon(s) > 0) & ~F.contains(body(s), F.lit(HEAD))
    return F.transform(
        F.slice(lines, F.lit(1), F.size(lines) - 1),
        lambda s: F.struct(
            F.when(whole(s), _role(F.substr(s, F.lit(len(HEAD) + 1), colon(s) - len(HEAD) - 1))).alias("role"),
            unescape(body(s)).alias("text"),
        ),
    )


def loss_mask(formatted: Column, roles: tuple[str, ...] = LOSS_ROLES) -> Column:
    """Array of struct(skip, size), one for each turn: code points of the turn that do not train
    and, from there on, that do; together with what is left of the turn they tile the formatted
    text, so a mask is applied in one pass over the turns."""
    labels = [LABELS.get(r, "role=" + r.encode().hex()) for r in roles]

    def one(s):
        lead = F.instr(s, COLON) + len(COLON) - 1
        trained = F.substr(s, F.lit(len(HEAD) + 1), F.instr(s, COLON) - len(HEAD) - 1).isin(labels)
        return F.struct(F.when(trained, lead).otherwise(F.length(s)).alias("skip"), F.when(trained, F.length(s) - lead).otherwise(F.lit(0)).alias("size"))

    return F.transform(_segments(formatted), one)


def masked(formatted: Column, mask: Column) -> Column:
    """The trained pieces of a formatted text, in order; each turn is cut out once."""
    pieces = F.transform(_segments(formatted), lambda s, i: F.substr(s, F.get(mask, i)["skip"] + 1, F.get(mask, i)["size"]))
    return F.filter(pieces, lambda p: p != "")


def format_conversations(rows: DataFrame, roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """conv_id, formatted, escaped, loss_mask; one row per conversation."""
    clean = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    source = turns.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    plain = source.withColumn("plain", render(F.col("source"), lambda x: x))
    tried = plain.withColumn("escaped", ~parse(F.col("plain")).eqNullSafe(F.col("source")))
    text = F.when(F.col("escaped"), render(F.col("source"), escape)).otherwise(F.col("plain"))
    out = tried.select("conv_id", "source", "escaped", text.alias("formatted"))
    same = parse(F.col("formatted")).eqNullSafe(F.col("source"))
    checked = F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not parse back to its turns")))
    return out.select("conv_id", checked.alias("formatted"), "escaped").withColumn("loss_mask", loss_mask(F.col("formatted"), roles))


def read_back(formatted: DataFrame) -> DataFrame:
    """The digest of what format_conversations wrote, taken from the formatted text and the mask alone."""
    text = F.col("formatted")
    loss = F.array_join(F.transform(masked(text, F.col("loss_mask")), unescape), "")
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = formatted.select("conv_id", "escaped", "formatted", parse(text).alias("turns"), loss.alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escaped",
    )
