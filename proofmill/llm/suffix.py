"""Suffix-array dedup: bytes covered by a LENGTH-byte string that starts anywhere else.

Texts are UTF-8 bytes; strings never cross texts, are judged on the input, and overlapping
occurrences in one text count. Sorting every suffix of the corpus together would move each byte
LENGTH times, so suffixes are first dealt out exactly, and equal pieces are collapsed:

1. Byte-equal whole texts are one class with a count: every byte of such a text from LENGTH
   bytes on goes, and one text stands for the class in what follows.
2. A window of LENGTH bytes is anchored at its smallest GRAM-byte hash, so equal windows have
   equal anchors. Neighbouring window starts with one anchor form a run (about 1 row for 85
   bytes). Equal runs of a batch of texts are repeats: their spans come out at once and one of
   them goes on, so neither a passage that very many texts share nor a text of one repeated
   character makes many rows. Equal runs of different batches are collapsed with counts next.
3. Runs whose anchor hash is nowhere else hold no repeat, and where an anchor has one kind of run
   there is nothing to order. The suffixes of an anchor's differing runs meet in one task with
   their bytes and are put in order by deep-shallow sorting: a multikey quicksort on 8-byte
   characters to SHALLOW bytes, then blind tries, which order the groups with longer common
   prefixes. Neighbours in that order that agree to LENGTH bytes are repeats.
4. An anchor with more than HOT kinds of runs is not gathered: each of its runs is cut where the
   distance to the anchor reaches a multiple of CUTS[0], and such a shorter run is dealt by the
   bytes that all its windows share, which again keeps equal windows together. Steps 2 and 3 are
   repeated on them, then with the next of CUTS. With cuts of one window a group holds equal
   windows only, so this ends.

Result of `repeated_spans`: byte spans to remove. `remove_repeats` applies them.
Defined cases: null text is empty; texts under LENGTH bytes have no window; a very long text is
read whole, in pieces that overlap; equal texts remove each other whole from LENGTH bytes on; rows
that repeat a doc_id, and rows without one, are texts of their own; an empty table gives no rows;
other columns are not read, whatever their names. doc_id holds integers; other values stop the job.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import Workspace, release

LENGTH, GRAM = 200, 32
WINDOW = LENGTH - GRAM + 1
SHALLOW, HOT, CUTS = 16, 20_000, (24, 4, 1)
#: Copies of whole texts whose keys are broadcast at most; beyond, a shuffled join.
BROADCAST_IDS = 500_000
RUN = "anchor long, content long, key long, start long, size int, lead int, weight int"
#: Bytes hashed at once; a longer text is cut into pieces that overlap by LENGTH - 1.
PIECE = 1 << 19
PIECE_BITS = 22
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def gram_hashes(data):
    """64-bit hash of every GRAM-byte string of a uint8 array, by doubling."""
    import numpy as np

    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(MIX[0])
    size = 1
    while size < GRAM:
        h ^= h >> np.uint64(29)
        h = h[:-size] * np.uint64(MIX[1]) + h[size:]
        size *= 2
    h *= np.uint64(MIX[2])
    h ^= h >> np.uint64(32)
    return h


def sliding_least(keys, width: int):
    """Minimum of every `width` neighbours (block prefixes and suffixes)."""
    import numpy as np

    n = len(keys)
    pad = -n % width
    grid = np.concatenate([keys, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchor_runs(data, ends):
    """Runs of window starts that share an anchor: (anchor hash, start, size, anchor position).

    data: texts joined, uint8; ends: each text's end. A window of LENGTH bytes is anchored at
    its smallest gram hash, the leftmost of equal ones, so equal windows have equal anchors.
    """
    import numpy as np

    hashes = gram_hashes(data)
    low = np.uint64((1 << PIECE_BITS) - 1)
    keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (sliding_least(keys, WINDOW) & low).astype(np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    # valid starts of each text
    lengths = np.maximum(ends - begins - LENGTH + 1, 0)
    starts = np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z, z, z
    own = anchor[starts]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    sizes = np.diff(np.concatenate([first, [len(starts)]]))
    return hashes[own[first]], starts[first], sizes, own[first]


def pieces(texts: list[bytes]):
    """Batches of (text number, offset, bytes) of at most about PIECE bytes."""
    batch, size = [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), PIECE):
            part = text[at : at + PIECE + LENGTH - 1]
            if size + len(part) > 2 * PIECE and batch:
                yield batch
                batch, size = [], 0
            batch.append((k, at, part))
            size += len(part)
    if batch:
        yield batch


def text_runs(texts: list[bytes]):
    """(text number, anchor hash, hash of the run's bytes, start, size, distance from the start to
    the anchor) arrays for a list of texts."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    for batch in pieces(texts):
        joined = b"".join(p for _, _, p in batch)
        if len(joined) < LENGTH:
            continue
        ends = np.cumsum([len(p) for _, _, p in batch])
        anchors, starts, sizes, at = anchor_runs(np.frombuffer(joined, np.uint8), ends)
        view = memoryview(joined)
        content = np.array([xxh3_64_intdigest(view[a:b]) for a, b in zip(starts.tolist(), (starts + sizes + LENGTH - 1).tolist(), strict=True)], dtype=np.uint64)
        piece = np.searchsorted(ends, starts, side="right")
        shift = np.array([at for _, at, _ in batch]) - (ends - np.array([len(p) for _, _, p in batch]))
        yield np.array([k for k, _, _ in batch])[piece], anchors, content, starts + shift[piece], sizes, at - starts


def collapsed(owner, anchors, content, starts, sizes):
    """(runs to keep, their weights, spans of the equal ones as (owner, start, end) arrays).

    Of equal runs the first is kept, with weight 2: it is a repeat and needs no span any more.
    """
    import numpy as np

    order = np.lexsort((content, anchors))
    differ = (anchors[order][1:] != anchors[order][:-1]) | (content[order][1:] != content[order][:-1])
    kind = np.cumsum(np.concatenate([[False], differ]))
    many = np.bincount(kind)[kind] > 1
    equal = np.sort(order[many])
    equal = equal[np.lexsort((starts[equal], owner[equal]))]
    lows, highs, own = starts[equal], starts[equal] + sizes[equal] + LENGTH - 1, owner[equal]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (lows[1:] > highs[:-1])]) if len(equal) else np.zeros(0, bool)
    last = np.concatenate([new[1:], [True]]) if len(equal) else new
    first = order[np.concatenate([[True], differ])]
    weights = np.where(many[np.concatenate([[True], differ])], 2, 1)
    return first, weights, (own[new], lows[new], highs[last])


def multikey(data, starts, groups):
    """Order suffixes by (group, first SHALLOW bytes), one 8-byte character after the other and
    only inside ties; returns (order, tie number of each ordered suffix)."""
    import numpy as np

    order = np.argsort(groups, kind="stable")
    ties = np.cumsum(np.concatenate([[False], groups[order][1:] != groups[order][:-1]]))
    words = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    for depth in range(0, SHALLOW, 8):
        open_ = np.bincount(ties)[ties] > 1
        spots = np.flatnonzero(open_)
        if not len(spots):
            break
        char = np.ascontiguousarray(words[starts[order[spots]] + depth]).view(">u8").ravel().astype(np.uint64)
        inner = np.lexsort((char, ties[spots]))
        order[spots] = order[spots][inner]
        char = char[inner]
        full = np.zeros(len(order), np.uint64)
        full[spots] = char
        parted = np.concatenate([[False], (ties[1:] != ties[:-1]) | (open_[1:] & open_[:-1] & (full[1:] != full[:-1]))])
        ties = np.cumsum(parted)
    return order, ties


def blind_tries(data, starts, order, ties):
    """Order the suffixes of each tie on to LENGTH bytes; returns (order, ties) as multikey does.

    A round is one level of all ties' tries. A tie's first suffix is its leader, and of a node
    only the place where the others leave it (depth, byte) is kept: those below the leader come
    in order of depth, those above it in the reverse, equal ones beside it. What leaves at the
    same node goes on as a tie of its own.
    """
    import numpy as np

    size = LENGTH - SHALLOW
    rows = np.lib.stride_tricks.as_strided(data[SHALLOW:], (max(0, len(data) - LENGTH + 1), size), (1, 1))
    settled, middle = np.zeros(len(order), bool), size * 256
    while True:
        spots = np.flatnonzero((np.bincount(ties, minlength=1)[ties] > 1) & ~settled)
        if not len(spots):
            return order, ties
        group = ties[spots]
        leader = spots[np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))]
        lead = leader[np.cumsum(np.concatenate([[False], group[1:] != group[:-1]]))]
        key = np.empty(len(spots), np.int64)
        for k in range(0, len(spots), 1 << 15):
            part = slice(k, k + (1 << 15))
            own, first = rows[starts[order[spots[part]]]], rows[starts[order[lead[part]]]]
            differ = own != first
            at = differ.argmax(axis=1)
            n = np.arange(len(at))
            mine, its = own[n, at].astype(np.int64), first[n, at].astype(np.int64)
            key[part] = np.where(mine < its, at * 256 + mine, np.where(mine > its, middle + 1 + (size - 1 - at) * 256 + mine, middle))
        inner = np.lexsort((key, group))
        order[spots] = order[spots][inner]
        key = key[inner]
        settled[spots] = key == middle
        full = np.zeros(len(order), np.int64)
        full[spots] = key
        parted = np.concatenate([[False], (ties[1:] != ties[:-1]) | (full[1:] != full[:-1])])
        ties = np.cumsum(parted)


def repeats_in(contexts: list[bytes], groups):
    """For each context (the bytes of a run's windows) the starts whose window is in another
    place of the same group, as an array of flags."""
    import numpy as np

    sizes = np.array([len(c) - LENGTH + 1 for c in contexts])
    data = np.frombuffer(b"".join(contexts) + bytes(8), np.uint8)
    begins = np.cumsum([0, *map(len, contexts[:-1])])
    firsts = np.cumsum(sizes) - sizes
    starts = np.repeat(begins - firsts, sizes) + np.arange(sizes.sum())
    order, ties = blind_tries(data, starts, *multikey(data, starts, np.repeat(np.asarray(groups), sizes)))
    agree = ties[1:] == ties[:-1]  # neighbours with a common prefix of LENGTH bytes
    flags = np.zeros(len(starts), bool)
    flags[order] = np.concatenate([[False], agree]) | np.concatenate([agree, [False]])
    return [flags[f : f + n] for f, n in zip(firsts.tolist(), sizes.tolist(), strict=True)]


def flag_spans(flags):
    """(first, last) of each stretch of set flags."""
    import numpy as np

    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edges[::2].tolist(), (edges[1::2] - 1).tolist()


def keyed(space: Workspace, docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """key, doc_id, text with a key of each row: doc_id itself where it is a key, else one written down."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.groupBy("doc_id").count().where("doc_id is null or count > 1")
    if not ids.limit(1).count():
        return rows.select(F.col("doc_id").alias("key"), "doc_id", "text")
    return space.save(rows.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"), "keyed")


def _batch(keys, found, weight=None):
    """RUN rows of a batch, and its spans as rows without an anchor (start, and the end as content)."""
    import numpy as np
    import pyarrow as pa

    owner, anchors, content, starts, sizes, leads = (np.concatenate(x) for x in zip(*found, strict=True))
    keep, weights, (own, lows, highs) = collapsed(owner, anchors, content, starts, sizes)
    if weight is not None:
        weights = np.maximum(weights, weight[owner[keep]])
    none = np.zeros(len(own), np.int64)
    join = lambda a, b, kind: pa.array(np.concatenate([a, b]), kind)
    arrays = [
        pa.array(np.concatenate([anchors[keep].view(np.int64), none]), pa.int64(), mask=np.arange(len(keep) + len(own)) >= len(keep)),
        join(content[keep].view(np.int64), highs, pa.int64()), join(keys[owner[keep]], keys[own], pa.int64()), join(starts[keep], lows, pa.int64()),
        join(sizes[keep], none, pa.int32()), join(leads[keep], none, pa.int32()), join(weights, none, pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in RUN.split(", ")])


def _runs(rows: DataFrame) -> DataFrame:
    """rows: key, text, weight (2 for a text that stands for several)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keys, weight = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            found = list(text_runs(batch.column(1).cast(pa.binary()).to_pylist()))
            if found:
                yield _batch(keys, found, np.asarray(weight))
        release()

    return rows.select("key", "text", "weight").where(F.octet_length("text") >= LENGTH).mapInArrow(run, RUN)


def _contexts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted runs: anchor, key, start, lead, own, bytes. One join on the text's key."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("anchor", "start", "size", "lead", "own")).alias("runs"))

    def run(batches):
        import pyarrow as pa

        names, kinds = ["anchor", "key", "start", "lead", "own", "bytes"], (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                out = [[] for _ in names]
                for key, text, runs in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                    for r in runs:
                        row = (r["anchor"], key, r["start"], r["lead"], r["own"], text[r["start"] : r["start"] + r["size"] + LENGTH - 1])
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    joined = rows.select("key", "text").join(lists, "key").select("key", "text", "runs")
    return joined.mapInArrow(run, "anchor long, key long, start long, lead int, own boolean, bytes binary")


def shorter_runs(anchor: int, context: bytes, lead: int, cut: int):
    """(group, hash of the bytes, first window, windows, lead) of a run's parts: the windows whose
    distances to the anchor lie between the same multiples of `cut`, dealt by the bytes that all
    windows at such distances share."""
    from xxhash import xxh3_64_intdigest

    size = len(context) - LENGTH + 1
    at = 0
    while at < size:
        block = (lead - at) // cut  # distances block * cut to block * cut + cut - 1
        last = min(size - 1, lead - block * cut)
        low, high = lead - block * cut, lead - (block * cut + cut - 1) + LENGTH  # from the latest start to the earliest end
        group = xxh3_64_intdigest(context[low:high], seed=(anchor * 31 + block) & 0xFFFFFFFFFFFFFFFF)
        yield group, xxh3_64_intdigest(context[at : last + LENGTH]), at, last - at + 1, lead - at
        at = last + 1


def _shorter(contexts: DataFrame, cut: int) -> DataFrame:
    """RUN rows of the parts of hot anchors' runs."""

    def run(batches):
        import numpy as np

        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                anchor, key, start, lead, own, data = (part.column(c).to_pylist() for c in range(6))
                rows = [(n, *r) for n in range(part.num_rows) for r in shorter_runs(anchor[n], data[n], lead[n], cut)]
                owner, groups, content, at, sizes, leads = (np.array(x) for x in zip(*rows, strict=True))
                starts, weight = np.array(start)[owner] + at, np.where(own, 1, 2)
                # equal parts of one text differ in their start only, so a row is a text of its own here
                yield _batch(np.array(key), [(owner, groups.astype(np.uint64), content.astype(np.uint64), starts, sizes, leads)], weight)
        release()

    return contexts.mapInArrow(run, RUN)


def _sorted_spans(contexts: DataFrame) -> DataFrame:
    """key, start, end of the repeats among the suffixes of each anchor."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

        def settle(rows):
            flags = repeats_in([r[4] for r in rows], [r[0] for r in rows])
            out = []
            for (_, key, start, own, _), f in zip(rows, flags, strict=True):
                if own and f.any():
                    out += [{"key": key, "start": start + a, "end": start + b + LENGTH} for a, b in zip(*flag_spans(f), strict=True)]
            return pa.RecordBatch.from_pylist(out, schema=schema)

        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > PIECE and row[0] != held[-1][0]:  # whole anchors only
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield settle(held)
        release()

    dealt = contexts.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.select("anchor", "key", "start", "own", "bytes").mapInArrow(run, "key long, start long, end long")


def _level(space: Workspace, rows: DataFrame, runs: DataFrame, hot: int, name: str):
    """(spans of one level as written tables, the contexts of its hot anchors or None)."""
    keep = lambda df, what: space.save(df, f"{name}-{what}")
    spans = [runs.where("anchor is null").select("key", "start", F.col("content").alias("end"))]
    runs = runs.where("anchor is not null")
    # written, so that the joins have an exchange on both sides and a hot anchor can be split
    shared = keep(runs.groupBy("anchor").agg(F.sum("weight").alias("n")).where("n > 1").select("anchor"), "shared")
    met = keep(runs.join(shared, "anchor"), "met")
    kinds = met.groupBy("anchor", "content").agg(F.sum("weight").alias("n"), F.min(F.struct("key", "start", "size", "lead")).alias("one"))
    kinds = keep(kinds.select("anchor", "content", "n", "one.*"), "kinds")
    whole = met.where("weight = 1").join(kinds.where("n > 1").select("anchor", "content"), ["anchor", "content"])
    spans.append(keep(whole.select("key", "start", (F.col("start") + F.col("size") + LENGTH - 1).alias("end")), "whole"))
    mixed = keep(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1"), "mixed")
    space.drop(f"{name}-shared")
    space.drop(f"{name}-met")
    wanted = kinds.join(mixed.select("anchor", "kinds"), "anchor").select("anchor", "key", "start", "size", "lead", (F.col("n") == 1).alias("own"), (F.col("kinds") > hot).alias("hot"))
    wanted = keep(wanted, "wanted")
    space.drop(f"{name}-kinds")
    contexts = keep(_contexts(rows, wanted.where("not hot")), "contexts")
    spans.append(keep(_sorted_spans(contexts), "sorted"))
    space.drop(f"{name}-contexts")
    if not mixed.where(F.col("kinds") > hot).limit(1).count():
        return spans, None
    return spans, keep(_contexts(rows, wanted.where("hot")), "hot")


def repeated_spans(space: Workspace, rows: DataFrame, hot: int = HOT) -> DataFrame:
    """key, start, end: the bytes to remove, overlapping spans not yet merged. rows: key, text, weight."""
    runs, out = space.save(_runs(rows), "runs"), None
    for n, cut in enumerate((*CUTS, 0)):
        spans, left = _level(space, rows, runs, hot, f"level-{n}")
        for s in spans:
            out = s if out is None else out.unionByName(s)
        if left is None:
            return out
        runs = space.save(_shorter(left, cut), f"runs-{n + 1}")
    raise RuntimeError("groups of equal windows did not settle")


def whole_copies(space: Workspace, rows: DataFrame) -> DataFrame:
    """key, first, n_bytes of every text that is byte-equal to another; `first` stands for its class."""
    marked = space.save(rows.where(F.octet_length("text") >= LENGTH).select("key", F.md5("text").alias("mark"), F.octet_length("text").alias("n_bytes")), "marks")
    classes = space.save(marked.groupBy("mark").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("mark", "least"), "classes")
    return space.save(marked.join(classes, "mark").select("key", (F.col("key") == F.col("least")).alias("first"), "n_bytes"), "copies")


def cut(text: bytes, starts, ends) -> tuple[bytes, int, int]:
    """(kept bytes, bytes removed, maximal removed runs)."""
    import numpy as np

    if not len(starts):
        return text, 0, 0
    order = np.argsort(starts, kind="stable")
    starts, ends = np.asarray(starts)[order], np.maximum.accumulate(np.asarray(ends)[order])
    first = np.concatenate([[True], starts[1:] > ends[:-1]])
    lows, highs = starts[first].tolist(), ends[np.concatenate([first[1:], [True]])].tolist()
    kept = b"".join([text[a:b] for a, b in zip([0, *highs], [*lows, len(text)], strict=True)])
    return kept, len(text) - len(kept), len(lows)


def remove_repeats(docs: DataFrame, hot: int = HOT, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes), or with `digest` kept_sha256."""
    space = Workspace(docs.sparkSession, "suffix")
    rows = keyed(space, docs)
    copies = whole_copies(space, rows)
    few = copies.count() <= BROADCAST_IDS
    marked = rows.join(F.broadcast(copies.select("key", "first")) if few else copies.select("key", "first"), "key", "left")
    classes = marked.where("first is null or first").select("key", "text", F.when(F.col("first"), F.lit(2)).otherwise(F.lit(1)).alias("weight"))
    gone = copies.select("key", F.lit(0).cast("long").alias("start"), F.col("n_bytes").cast("long").alias("end"))
    spans = space.save(repeated_spans(space, classes, hot).unionByName(gone), "spans")
    lists = spans.groupBy("key").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    last = ("kept_sha256", "string") if digest else ("kept", "binary")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = part.column(1).cast(pa.binary()).to_pylist()
                found = [cut(t, a or (), b or ()) for t, a, b in zip(texts, part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                out = [hashlib.sha256(f[0]).hexdigest() for f in found] if digest else [f[0] for f in found]
                arrays = [part.column(0), *(pa.array(c, pa.int64()) for c in ([len(t) for t in texts], [f[1] for f in found], [f[2] for f in found])), pa.array(out, pa.string() if digest else pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", last[0]])

    joined = rows.join(lists, "key", "left").select("doc_id", "text", "starts", "ends")
    return joined.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last[0]} {last[1]}")
