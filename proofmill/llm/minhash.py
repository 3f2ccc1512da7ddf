"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star edges.

A document's set is its distinct 5-word shingles (64-bit hashes; ASCII-lower-cased words); with
fewer words the whole sequence is the one shingle. Steps:

1. One narrow pass hashes each whole text to its set, one-permutation bins (empty bins borrow
   from a hash-chosen full one) and band keys. Rows with equal sets become one class, whose
   smallest doc_id stands for it, so copies never meet pairwise.
2. Classes that share a band key form a bucket. Each bucket gives star edges only: its smallest
   class to every other one. The sets of the classes concerned are written once; a centre's set
   is shipped once for SPREAD of its leaves, which stream past it. Links on full sets give
   components.
3. A bucket of three or more whose classes are still in several components may hide a link that
   does not touch its centre. Among all classes of such buckets an exact prefix filter finds the
   pairs that are left: two sets at the threshold share a shingle of their prefixes, which are the
   n - ceil(t * n) + 1 rarest shingles of each, counted among these classes. Passages that very many of
   them hold come last in that order, so classes meet only where they share rare shingles. The
   classes of a prefix shingle are dealt into chunks of about CHUNK classes and CHUNK_ITEMS
   shingles, those of its largest component into chunks of their own, which need not meet each
   other. Two chunks meet in one task, which counts what their full sets share, and only links
   come out, no more than join the task's classes: never a candidate pair. Groups of the same
   classes are settled once. So no link between candidates is lost, and sets are shipped by shared
   rare shingles, not by the square of a bucket.

The chance that a pair at the threshold shares no bucket is below 1e-6 (see `banding`).

Defined cases: null text, or one without words: empty set, linked with nothing, its own
component. A very long text is one set and read whole. Equal sets go by the smallest doc_id. Rows
that repeat a doc_id count as separate documents of that id. A null doc_id joins its class under
the class's smallest doc_id, and without one its component is null. An empty table gives no
rows; other columns are not read, whatever their names. doc_id holds integers; other values stop
the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofmill.llm.common import Workspace, partitions, release
from proofmill.llm.components import components
from proofmill.llm.simhash import MIX, mix64, word_hashes

WORDS, PERCENT, STAGE_PERCENT = 5, 85, 80
#: Leaves that meet one copy of their centre's set.
SPREAD = 128
#: Classes and shingles of a chunk, about; two chunks meet in a task.
CHUNK, CHUNK_ITEMS = 512, 1 << 20
#: Shingles of up to FEW classes are counted by pairs, others by blocks of a table of BLOCK shingles.
FEW, BLOCK = 8, 4096
#: Ids that are broadcast at most to fetch texts; beyond, a shuffled semi-join.
BROADCAST_IDS = 500_000


def banding(percent: int) -> tuple[int, int]:
    """(rows, bands): a pair at the threshold misses all bands with chance (1 - s**rows)**bands."""
    return (6, 32) if percent >= 85 else (5, 38)


def shingles(text: bytes):
    """Sorted distinct 64-bit shingle hashes."""
    import numpy as np

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    step = np.uint64(MIX[0])
    if len(words) < WORDS:
        out = np.array([len(words)], np.uint64)
        for k in range(len(words)):
            out = mix64(out * step + h[k : k + 1])
        return out
    out = h[: len(h) - WORDS + 1]
    for k in range(1, WORDS):
        out = mix64(out * step + h[k : len(h) - WORDS + 1 + k])
    return np.unique(out)


def bins(items, count: int):
    """One-permutation minima of a sorted set, empty bins filled by optimal densification."""
    import numpy as np

    at = ((items >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
    edges = np.searchsorted(at, np.arange(count, dtype=np.uint64))
    full = edges < len(items)
    full[full] = at[edges[full]] == np.flatnonzero(full).astype(np.uint64)
    out = np.zeros(count, np.uint64)
    out[full] = items[edges[full]]
    empty, attempt = np.flatnonzero(~full), 0
    while len(empty):  # bin b tries bins h(b, 1), h(b, 2) ... until a full one
        attempt += 1
        probe = (mix64(empty.astype(np.uint64) * np.uint64(MIX[1]) + np.uint64(attempt * MIX[2] % (1 << 64))) % np.uint64(count)).astype(np.int64)
        hit = full[probe]
        out[empty[hit]] = out[probe[hit]]
        empty = empty[~hit]
    return out


def band_keys(items, rows: int, bands: int):
    import numpy as np

    grid = bins(items, rows * bands).reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        key = mix64(key * np.uint64(MIX[0]) + grid[:, k])
    return key.view(np.int64)


def _hash_rows(docs: DataFrame, percent: int) -> DataFrame:
    rows, bands = banding(percent)

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                found = [shingles(t or b"") for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([len(s) for s in found], pa.int64()),
                        pa.array([xxh3_128_digest(s.tobytes()) if len(s) else None for s in found], pa.binary()),
                        pa.array([band_keys(s, rows, bands) if len(s) else None for s in found], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n", "set_hash", "keys"],
                )
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, set_hash binary, keys array<long>")


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, items: the sorted shingle hashes of the classes in `nodes`."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                found = [shingles(t or b"").tobytes() for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["node", "items"])
        release()

    ids = nodes.select(F.col("node").alias("doc_id")).distinct()
    few = ids.count() <= BROADCAST_IDS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    return rows.mapInArrow(run, "node long, items binary")


def _confirm(space: Workspace, sets: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """The edges (u, v) whose full sets reach the threshold."""
    centers = space.save(stars.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("parts")), "centers")
    leaves = stars.join(centers, "u").select("u", F.pmod(F.xxhash64("v"), F.col("parts").cast("long")).cast("int").alias("part"), F.lit(1).alias("kind"), F.col("v").alias("node"))
    heads = centers.select("u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("u").alias("node"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        at, own = None, []
        for batch in batches:
            out_u, out_v = [], []
            u, part, kind, node = (batch.column(k).to_pylist() for k in range(4))
            for k in range(batch.num_rows):
                items = np.frombuffer(batch.column(4)[k].as_buffer(), np.uint64)
                if (u[k], part[k]) != at:
                    at, own = (u[k], part[k]), []
                if not kind[k]:
                    own.append(items.copy())
                elif any(linked(center, items, percent) for center in own):
                    out_u.append(u[k])
                    out_v.append(node[k])
            yield pa.RecordBatch.from_arrays([pa.array(out_u, pa.int64()), pa.array(out_v, pa.int64())], names=["u", "v"])

    rows = leaves.unionByName(heads).join(sets, "node").select("u", "part", "kind", "node", "items")
    return rows.repartition("u", "part").sortWithinPartitions("u", "part", "kind").mapInArrow(run, "u long, v long").distinct()


def linked(a, b, percent: int) -> bool:
    import numpy as np

    least, most = sorted((len(a), len(b)))
    if 100 * least < percent * most:
        return False
    # both are sorted and distinct: what repeats in the merged array is shared
    merged = np.sort(np.concatenate([a, b]), kind="stable")
    shared = int((merged[1:] == merged[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def cell_links(comps, sides, sets, percent: int) -> list[tuple[int, int]]:
    """Links between rows of different components and, if two chunks meet, of different sides;
    of them, as many as join the rows that they link."""
    import numpy as np

    comps, sides, n = np.asarray(comps), np.asarray(sides), len(sets)
    sizes = np.array([len(s) for s in sets])
    allowed = comps[:, None] != comps[None, :]
    if sides.any():
        allowed &= sides[:, None] != sides[None, :]
    allowed &= 100 * np.minimum(sizes[:, None], sizes[None, :]) >= percent * np.maximum(sizes[:, None], sizes[None, :])
    if not allowed.any():
        return []
    rows = np.repeat(np.arange(n), sizes)
    _, token, having = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(token, kind="stable")
    rows, token = rows[order], token[order]
    shared = np.zeros((n, n))
    few = (having[token] > 1) & (having[token] <= FEW)
    r, t = rows[few], token[few]
    pairs = [(r[:-k] * n + r[k:])[t[:-k] == t[k:]] for k in range(1, min(FEW, len(r)))]
    if pairs:
        keys, counts = np.unique(np.concatenate(pairs), return_counts=True)
        shared.flat[keys] += counts
        shared += shared.T
    many = having[token] > FEW
    r, t = rows[many], token[many]
    t = np.cumsum(np.concatenate([[0], t[1:] != t[:-1]])) if len(t) else t
    for low in range(0, int(t[-1]) + 1 if len(t) else 0, BLOCK):
        a, b = np.searchsorted(t, (low, low + BLOCK))
        table = np.zeros((n, BLOCK), np.float32)
        table[r[a:b], t[a:b] - low] = 1
        shared += table @ table.T
    adjacent = allowed & (100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared))
    out, seen = [], np.zeros(n, bool)
    for root in np.flatnonzero(adjacent.any(axis=1)).tolist():
        if seen[root]:
            continue
        seen[root], todo = True, [root]
        while todo:
            x = todo.pop()
            new = np.flatnonzero(adjacent[x] & ~seen).tolist()
            seen[new] = True
            out += [(x, y) for y in new]
            todo += new
    return out


def _mixed(members: DataFrame) -> DataFrame:
    """node, n, component of the classes in buckets of three or more that hold several components."""
    per = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("rows"))
    buckets = per.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("rows").alias("size")).where("size > 2 and parts > 1")
    return members.join(buckets.select("key"), "key", "left_semi").select("node", "n", "component").distinct()


def prefixes(space: Workspace, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """key, node, n, component: the prefix shingles of nodes' sets that other nodes hold too."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                items = np.frombuffer(batch.column(1)[k].as_buffer(), np.int64)
                for low in range(0, len(items), 1 << 16):
                    part = items[low : low + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), batch.column(0)[k].as_py(), np.int64)), pa.array(part)], names=["node", "key"])

    held = space.save(sets.join(nodes.select("node"), "node", "left_semi").select("node", "items").mapInArrow(run, "node long, key long"), "held")
    shared = space.save(held.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared")  # others are in one set alone
    own = Window.partitionBy("node")
    ordered = held.join(shared, "key").withColumn("_r", F.row_number().over(own.orderBy("df", "key"))).withColumn("_shared", F.count(F.lit(1)).over(own))
    length = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1
    return ordered.join(nodes, "node").where(F.col("_r") <= length - (F.col("n") - F.col("_shared"))).select("key", "node", "n", "component")


def _rest(space: Workspace, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between members (key, node, n, component) of one key and several components."""
    marks = [F.bit_xor(F.xxhash64("node")).alias("mark"), F.sum(F.xxhash64(F.lit(1), "node").cast("decimal(38,0)")).alias("mark_2")]
    per = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("items"), *marks)
    most = F.max(F.struct("rows", "items", "component"))
    marks = [F.bit_xor("mark").alias("mark"), F.sum("mark_2").alias("mark_2")]
    buckets = per.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("rows").alias("size"), F.sum("items").alias("items"), most.alias("big"), *marks)
    chunks = lambda n, items: F.greatest(F.lit(1), F.ceil(n / CHUNK), F.ceil(items / CHUNK_ITEMS)).cast("int")
    split = F.struct("key", F.col("big.component").alias("big"), chunks(F.col("big.rows"), F.col("big.items")).alias("c"), chunks(F.col("size") - F.col("big.rows"), F.col("items") - F.col("big.items")).alias("d"))
    mixed = buckets.where("parts > 1").groupBy("size", "items", "mark", "mark_2").agg(F.min(split).alias("one"))  # the same classes once
    mixed = space.save(mixed.select("one.*"), "mixed")
    own = F.pmod(F.xxhash64("node", F.lit(2)), F.when(F.col("component") == F.col("big"), F.col("c")).otherwise(F.col("d")).cast("long")).cast("int")
    rows = members.join(mixed, "key").withColumn("_big", F.col("component") == F.col("big")).withColumn("chunk", F.when(F.col("_big"), own).otherwise(F.col("c") + own))
    other = F.explode(F.sequence(F.when(F.col("_big"), F.col("c")).otherwise(F.lit(0)), F.col("c") + F.col("d") - 1)).alias("other")
    cells = rows.select("key", "node", "component", "chunk", other)
    cells = cells.select("key", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), (F.col("chunk") > F.col("other")).cast("int").alias("side"), "node", "component")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

        def settle(cell):
            nodes, comps, sides, own = zip(*cell, strict=True)
            return [{"u": nodes[i], "v": nodes[j]} for i, j in cell_links(comps, sides, own, percent)] if len(set(comps)) > 1 else []

        at, cell, out = None, [], []
        for batch in batches:
            key, a, b, side, node, comp = (batch.column(k).to_pylist() for k in range(6))
            for k, where in enumerate(zip(key, a, b, strict=True)):
                if where != at:
                    out += settle(cell) if cell else []
                    at, cell = where, []
                    if len(out) > 4096:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out = []
                cell.append((node[k], comp[k], side[k], np.frombuffer(batch.column(6)[k].as_buffer(), np.uint64)))
        out += settle(cell) if cell else []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        release()

    dealt = cells.join(sets, "node").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return dealt.select("key", "a", "b", "side", "node", "component", "items").mapInArrow(run, "u long, v long").distinct()


def near_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per input row."""
    space = Workspace(docs.sparkSession, "minhash")
    hashed = space.save(_hash_rows(docs, percent), "hashed")
    full = hashed.where("set_hash is not null")
    classes = full.groupBy("set_hash").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = space.save(classes.where("node is not null"), "classes")
    bands = classes.select("node", "n", F.explode("keys").alias("key"))
    # written, like each aggregate that is joined back: a hot key can then be split in the join
    buckets = bands.groupBy("key").agg(F.min(F.struct("node", "n")).alias("c"), F.max("node").alias("last")).where("c.node != last")
    buckets = space.save(buckets.select("key", F.col("c.node").alias("center"), F.col("c.n").alias("center_n")), "buckets")
    members = space.save(bands.join(buckets, "key"), "members")
    possible = 100 * F.least("n", "center_n") >= percent * F.greatest("n", "center_n")
    stars = space.save(members.where("node != center").where(possible).select(F.col("center").alias("u"), F.col("node").alias("v")).distinct(), "stars")
    sets = space.save(_sets(docs, members), "sets")
    links = space.save(_confirm(space, sets, stars, percent), "links")
    found = space.save(components(space, links, "first"), "components")
    placed = members.join(found, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
    mixed = space.save(_mixed(placed), "mixed-nodes")
    rare = space.save(prefixes(space, mixed, sets, percent), "prefixes")
    space.drop("held")
    more = space.save(_rest(space, rare, sets, percent), "more")
    if more.limit(1).count():
        found = space.save(components(space, links.unionByName(more), "second"), "components-2")
    for done in ("members", "stars", "sets", "links", "buckets", "centers", "shared", "prefixes", "mixed", "mixed-nodes"):
        space.drop(done)
    by_set = classes.join(found, "node", "left").select("set_hash", F.coalesce("component", "node").alias("component"))
    out = hashed.select("doc_id", "n", "set_hash").join(by_set, "set_hash", "left")
    component = F.when(F.col("set_hash").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near(docs: DataFrame, percent: int = STAGE_PERCENT) -> DataFrame:
    """docs with one document of each near-duplicate group: the one with the smallest doc_id.

    Where doc_ids repeat or are missing, rows are told apart by a key of their own: of a group's
    rows with a doc_id the first by doc_id and text stays, and of its rows without one the first
    by text, so rows of different texts that share a doc_id all stay unless they are near copies.
    Rows without a shingle are in no group; those that repeat a doc_id are one document.
    """
    space = Workspace(docs.sparkSession, "minhash-drop")
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        return _drop_near_rows(space, docs, percent)
    groups = space.save(near_groups(docs, percent), "groups")
    gone = groups.where("not kept").select("doc_id")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _drop_near_rows(space: Workspace, docs: DataFrame, percent: int) -> DataFrame:
    """drop_near by row: keys in the order of (doc_id, text), written so that they stay the same."""
    by_id = F.col("doc_id").asc_nulls_last()
    dealt = docs.repartitionByRange(partitions(docs), by_id, F.substring("text", 1, 64)).sortWithinPartitions(by_id, "text")
    keyed = space.save(dealt.withColumn("_row", F.monotonically_increasing_id()), "rows")
    own = keyed.select(F.col("doc_id").alias("_id"), "_row")
    groups = near_groups(keyed.select(F.col("_row").alias("doc_id"), "text"), percent).withColumnRenamed("doc_id", "_row")
    placed = space.save(groups.select("_row", "component_id", "n_shingles").join(own, "_row"), "placed")
    wordless = F.col("n_shingles") == 0
    group = [F.when(~wordless, F.col("component_id")), F.when(wordless, F.col("_id")), F.when(wordless & F.col("_id").isNull(), F.col("_row")), F.col("_id").isNull()]
    kept = placed.groupBy(*[g.alias(f"_g{k}") for k, g in enumerate(group)]).agg(F.min("_row").alias("_row")).select("_row")
    return keyed.join(kept, "_row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
