"""Filter interaction audit: what each filter removes, alone, after others and on average.

Five filters judge a document: four by its own text (too short, repetitive, too many capitals,
symbols), one by the table (an earlier copy exists). All a text filter says is a bit of a mask,
so the 120 orders in which five filters can be applied need no pass each: the numbers of
documents with each of the 32 masks give every order's every step.

The copies are found by a fingerprint-routed RDD. Each map task keeps collision chains
(fingerprint -> list of full text, minimum id, rows), so a text with very many copies leaves a
task as one candidate; what is not the task's minimum is known to be a copy there and then and
travels without its text, dealt by its id. Candidates go to the partition that their xxhash
fingerprint names, where chains are merged: the minimum id of each full text stays, the others are
emitted. Equal fingerprints of different texts share a chain and are told apart by the text. A
map task sends its chains on when their texts reach CHAIN_BYTES, so its memory is bounded, and
reduce partitions are as many as keep their texts near ROUTED_BYTES.

Labels are joined to the narrow rows by id; combineByKey then merges mask count vectors (number,
good, toxic documents of each mask) a part, one vector a part and task.

Defined cases: null text reads as empty, which fails A alone; very long texts are judged whole; a null doc_id has no place in the order of ids: such a row is
never an earlier copy of others nor has one, and no label; rows that repeat a doc_id are each
counted, and copies of one id are none of each other's earlier copies; a doc_id that labels
repeat is good or toxic where any of its rows says so; a null part is the empty string; an empty
table gives no rows; other columns are not read, whatever their names. doc_id holds integers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import UPPER, Workspace, partitions

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
SYMBOLS = re.compile(rb"[#$%&*|]")
#: Texts of a map task's chains, and (about) of a reduce partition's.
CHAIN_BYTES, ROUTED_BYTES = 64 << 20, 64 << 20
_COPY = 1 << FILTERS.index("E")
STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a UTF-8 text fails."""
    words = text.split()  # bytes: at ASCII white space only
    points = len(text) - len(text.translate(None, bytes(range(0x80, 0xC0)))) if not text.isascii() else 0
    capitals = len(text) - len(text.translate(None, UPPER.encode()))
    fails = (len(words) < LEAST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * len(words), 100 * capitals > MOST_CAPITALS * (len(text) - points), SYMBOLS.search(text) is not None)
    return sum(fail << k for k, fail in enumerate(fails))


class Chains:
    """fingerprint -> chain of [full text, minimum id, mask, {part: rows of that id}]."""

    def __init__(self) -> None:
        self.table: dict[int, list[list]] = {}
        self.bytes = 0

    def add(self, mark: int, text: bytes, doc_id: int, mask: int, rows: dict[str, int]) -> list[tuple]:
        """Takes a candidate in; (doc_id, part, mask, rows) of what turns out to be a copy."""
        chain = self.table.setdefault(mark, [])
        for link in chain:
            if link[0] == text:
                break
        else:
            chain.append([text, doc_id, mask, dict(rows)])
            self.bytes += len(text) + 200
            return []
        if doc_id == link[1]:
            for part, n in rows.items():
                link[3][part] = link[3].get(part, 0) + n
            return []
        later = (doc_id, rows)
        if doc_id < link[1]:
            later, link[1], link[3] = (link[1], link[3]), doc_id, dict(rows)
        return [(later[0], part, mask | _COPY, n) for part, n in later[1].items()]

    def drain(self) -> Iterator[tuple[int, list]]:
        found, self.table, self.bytes = self.table, {}, 0
        for mark, chain in found.items():
            for link in chain:
                yield mark, link


def _local(rows) -> Iterator[tuple[int, tuple]]:
    """(routing number, candidate with its text) or (routing number, settled row) of a map task."""
    from xxhash import xxh64_intdigest

    chains, nameless = Chains(), {}
    for doc_id, part, text in rows:
        text, part = bytes(text or b""), part or ""
        mask = text_mask(text)
        if doc_id is None:
            nameless[part, mask] = nameless.get((part, mask), 0) + 1
            continue
        for row in chains.add(xxh64_intdigest(text), text, doc_id, mask, {part: 1}):
            yield xxh64_intdigest(str(row[0])), row
        if chains.bytes > CHAIN_BYTES:
            for mark, link in chains.drain():
                yield mark, (mark, *link)
    for mark, link in chains.drain():
        yield mark, (mark, *link)
    for (part, mask), n in nameless.items():
        yield mask, (None, part, mask, n)


def _routed(rows) -> Iterator[tuple]:
    """(doc_id, part, mask, rows): settled rows pass, candidates' chains are merged."""
    chains = Chains()
    for _, row in rows:
        if len(row) == 4:
            yield row
        else:
            yield from chains.add(*row)
    for _, (_, doc_id, mask, parts) in chains.drain():
        yield from ((doc_id, part, mask, n) for part, n in parts.items())


def document_masks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part, mask, n: the filters that each document fails; equal rows are counted in n."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(partitions(docs), -(-size // ROUTED_BYTES))
    rows = docs.select(F.col("doc_id").cast("long"), F.col(f"`{part}`").cast("string"), F.encode("text", "UTF-8")).rdd
    settled = rows.mapPartitions(_local).partitionBy(n, lambda mark: mark % n).mapPartitions(_routed)
    return docs.sparkSession.createDataFrame(settled, "doc_id long, part string, mask int, n long", verifySchema=False)


def copies(docs: DataFrame) -> DataFrame:
    """doc_id of every document whose text one with a smaller id has."""
    return document_masks(docs).where(F.col("mask").bitwiseAND(F.lit(_COPY)) != 0).select("doc_id")


def steps(part: str, vector: list[int]) -> Iterator[tuple]:
    """The result rows of a part from its mask counts: 32 numbers of documents, 32 good, 32 toxic."""
    bits = {f: 1 << k for k, f in enumerate(FILTERS)}
    size = 1 << len(FILTERS)
    count, good, toxic = vector[:size], vector[size : 2 * size], vector[2 * size :]
    plans, shares = [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        before = 0
        for number, f in enumerate(order, 1):
            first = [m for m in range(size) if m & bits[f] and not m & before]  # fail here, not earlier
            removed = sum(count[m] for m in first)
            again = sum(count[m] for m in range(size) if m & bits[f] and m & before)
            before |= bits[f]
            kept = sum(count[m] for m in range(size) if not m & before)
            shares[f] += removed
            plans.append(("".join(order), number, f, kept, removed, again, sum(good[m] for m in first), sum(toxic[m] for m in first)))
    for order, number, f, kept, removed, again, lost_good, lost_toxic in plans:
        yield part, order, number, kept, removed, again, count[bits[f]], lost_good, lost_toxic, shares[f]


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Every part's every order's every step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley."""
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("long")), F.lit(0)).alias(c)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(flag("quality"), flag("toxic"))
    masks = Workspace(docs.sparkSession, "audit").save(document_masks(docs, part), "masks")
    named, nameless = masks.where("doc_id is not null"), masks.where("doc_id is null")
    judged = named.join(known, F.col("doc_id") == F.col("_id"), "left").select("part", "mask", "n", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("bad"))
    judged = judged.unionByName(nameless.select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("bad")))
    size = 1 << len(FILTERS)

    def add(vector: list[int], row) -> list[int]:
        mask, n, good, bad = row
        for k, times in enumerate((1, good, bad)):
            vector[k * size + mask] += n * times
        return vector

    def merge(a: list[int], b: list[int]) -> list[int]:
        return [x + y for x, y in zip(a, b, strict=True)]

    vectors = judged.rdd.map(lambda r: (r[0], (r[1], r[2], r[3], r[4]))).combineByKey(lambda row: add([0] * (3 * size), row), add, merge)
    return docs.sparkSession.createDataFrame(vectors.flatMap(lambda v: steps(*v)), STEPS, verifySchema=False)
