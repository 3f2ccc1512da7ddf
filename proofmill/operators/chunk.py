"""Deterministic chunks, row by row.

A chunk ends at most chunk_size characters after its start, before the last newline of the 49
positions ahead of that end, else before the blank that follows the last sentence end there; the
next one starts `overlap` characters ahead of that. Where no such cut can fall on the next start,
one regular expression yields all chunks of a text in one linear pass: a look-ahead captures the
chunk, and what is consumed ends `overlap` characters sooner. Tiny chunks use a fold that carries
the position. No shuffle; empty text has no chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.config import ChunkConfig
from proofmill.functions import ids
from proofmill.functions import text as text_functions

LOOK_BACK = 50
#: Lengths that are summed at once; keeps the work per text near linear.
BLOCK = 256


def _pattern(config: ChunkConfig) -> str:
    """Group 1 is a chunk; the match is its part before the next chunk's start."""
    n, o = config.chunk_size, config.overlap
    first, last = n - LOOK_BACK + 1, n - 1  # lengths that look back to a newline
    pieces, steps = [rf".{{1,{n}}}\z"], [rf".{{1,{n}}}\z"]
    if config.split_on_newline:
        pieces += [rf".{{{first},{last}}}(?=\n)", rf".{{{first - 1},{last - 1}}}[.!?](?=[ \n])"]
        steps += [rf".{{{first - o},{last - o}}}(?=.{{{o}}}\n)", rf".{{{first - o},{last - o}}}(?=.{{{o - 1}}}[.!?][ \n])"]
    pieces.append(rf".{{{n}}}")
    steps.append(rf".{{{n - o}}}")
    return rf"(?s)({'|'.join(pieces)})" if not o else rf"(?s)(?=({'|'.join(pieces)}))(?:{'|'.join(steps)})"


def _before(lengths: Column) -> Column:
    """For each length the sum of those before it, over blocks of BLOCK lengths and inside them."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    starts = F.aggregate(blocks, empty, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
    return text_functions.let(starts, lambda known: F.transform(lengths, lambda _, i: F.get(known, F.floor(i / BLOCK).cast("int")) + total(F.slice(lengths, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))))


def _by_pattern(text: Column, config: ChunkConfig) -> Column:
    """Array of struct(start, piece)."""
    pieces = F.regexp_extract_all(text, F.lit(_pattern(config)), F.lit(1))
    steps = lambda ps: F.transform(ps, lambda p: F.length(p) - F.lit(config.overlap))
    placed = lambda ps: F.zip_with(text_functions.let(steps(ps), _before), ps, lambda at, p: F.struct(at.alias("start"), p.alias("piece")))
    return F.when(F.length(text) > 0, text_functions.let(pieces, placed)).otherwise(F.array().cast("array<struct<start:int,piece:string>>"))


def _by_fold(text: Column, config: ChunkConfig) -> Column:
    size, overlap = config.chunk_size, config.overlap
    length = F.length(text)
    gain = max(1, size - overlap - (LOOK_BACK - 1)) if config.split_on_newline else size - overlap
    steps = F.sequence(F.lit(1), (F.ceil(length / F.lit(gain)) + 1).cast("int"))
    start = F.struct(F.lit(0).alias("pos"), (length == 0).alias("done"), F.array().cast("array<struct<start:int,piece:string>>").alias("out"))

    def found(end: Column, pos: Column) -> Column:
        """The cut before `end`, from one window that starts a character ahead of the look-back."""
        low = F.greatest(F.lit(2), end - (LOOK_BACK - 1))

        def search(w: Column) -> Column:
            newline = F.when(F.contains(F.substr(w, F.lit(2)), F.lit("\n")), low + F.length(F.regexp_extract(w, r"(?s)^.(.*)\n", 1)))
            sentence = F.length(F.regexp_extract(w, r"(?s)^(.*[.!?])[ \n]", 1))
            return F.coalesce(newline, F.when(sentence > 0, low - 1 + sentence), end)

        at = text_functions.let(F.substr(text, low, end - low + 1), search)
        return F.when(end < length, text_functions.let(at, lambda c: F.when(c > pos + overlap, c).otherwise(end))).otherwise(end)

    def step(acc, _):
        hard = F.least(acc["pos"] + size, length)
        cut = found(hard, acc["pos"]) if config.split_on_newline else hard

        def extend(end):
            piece = F.struct(acc["pos"].alias("start"), F.substr(text, acc["pos"] + 1, end - acc["pos"]).alias("piece"))
            return F.struct(F.greatest(F.lit(0), end - overlap).alias("pos"), (end == length).alias("done"), F.concat(acc["out"], F.array(piece)).alias("out"))

        return F.when(acc["done"], acc).otherwise(text_functions.let(cut, extend))

    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def chunk_array(text: Column, config: ChunkConfig | None = None) -> Column:
    config = config or ChunkConfig()
    text = F.coalesce(text, F.lit(""))
    simple = not config.split_on_newline or config.chunk_size - config.overlap > LOOK_BACK
    return _by_pattern(text, config) if simple else _by_fold(text, config)


def chunk(docs: DataFrame, config: ChunkConfig | None = None, text: str = "raw_text") -> DataFrame:
    """docs (document_id, ...) -> one row per chunk; the text column becomes the chunk's raw text."""
    keep = [c for c in docs.columns if c != text]
    rows = docs.select(*keep, F.posexplode(chunk_array(F.col(text), config)).alias("chunk_index", "_c"))
    return rows.select(
        *keep, "chunk_index", ids.chunk_id(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"), F.col("_c.piece").alias("raw_text"),
        F.col("_c.start").alias("start_offset"), (F.col("_c.start") + F.length("_c.piece")).alias("end_offset"), ids.sha(F.col("_c.piece")).alias("raw_text_hash"),
    )
