"""Token-ID / binary output: shards of byte-plane-shuffled, zstandard-compressed id blocks.

Documents are range-partitioned and sorted by doc_id (then text); each task encodes its range
and streams one shard file into the shared folder. A shard holds blocks of BLOCK ids; a block
is transposed into its four byte planes and every plane is a zstandard frame of its own. The
footer stores the chunk index (offset, ids and plane sizes of each block) and the document
table (doc_id, ids). Layout, little-endian:

    b"PMTB" u32 version | frames ... | zstd(footer json) | u64 footer offset, u32 footer size, b"PMTB"

A task writes under a name of its own and renames at the end, so a retry or a second attempt
leaves the same bytes under the same name. The manifest (one row per shard) gives the shards'
bases; readers take one shard per task and hold one block at a time.

Tokens: words (runs between ASCII white space) are encoded through a bounded cache. That
equals encoding the whole text, as the vocabulary lower-cases, drops white space, and its
pre-tokenizer and normalizer never look across it. Words that hold `<|` are not lower-cased
first, as special tokens are matched by case before the normalizer.

Defined cases: null or empty text has only the end id; null doc_id sorts first; rows that
repeat a doc_id stay and are ordered by text (null first); a very long text is encoded whole and
lies in as many blocks as it takes; an empty table gives no rows; other columns are not read,
whatever their names. doc_id holds integers; other values stop the job. A tokenizer whose words
cannot be encoded one by one is refused.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofmill.llm.common import Workspace, partitions, release

BLOCK, END_ID, LEVEL, MAGIC, VERSION = 1 << 16, 1, 1, b"PMTB", 1
#: Words kept by a worker's cache; longer words than CACHE_CHARS are never kept.
CACHE_WORDS, CACHE_CHARS = 250_000, 40


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A letter, and the ASCII marks that end its word: two pre-tokens, which a space may part.
MARKS = r"([a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])([!-/:-@\[-`{-~]+(?:[ \n]|$))"


#: Texts that a tokenizer must encode as it encodes their words.
PROBES = ("the quick  brown\tfox, isn't it?", "a\n\nb 12 3.5 (x) É ß", " lead and trail ")


class WordEncoder:
    """bytes of a text -> little-endian u32 ids.

    Lower-cased words are looked up, without the marks that end them. Unknown words of plain
    Latin letters are one pre-token each, so they are encoded as one text and cut after each
    token that ends a word; others are encoded one by one.
    """

    def __init__(self, blob: str):
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(blob)
        for text in PROBES:
            parts = [i for w in text.split() for i in self._ids(w)]
            if parts != self._ids(text):
                raise ValueError("the tokenizer looks across white space, so words cannot be encoded one by one")
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[k for token, k in vocab.items() if token.endswith("</w>")]] = True
        self.plain = re.compile("[a-zÀ-ÖØ-öø-ÿ]+").fullmatch
        self.cache: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def learn(self, words: list[bytes], into: dict[bytes, bytes]) -> None:
        import numpy as np

        plain = [w for w in words if self.plain(w.decode())]
        for k in range(0, len(plain), 4096):
            part = plain[k : k + 4096]
            ids = np.array(self._ids(b" ".join(part).decode()), dtype="<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) == len(part):
                data, at = ids.tobytes(), 0
                for w, cut in zip(part, cuts.tolist(), strict=True):
                    into[w] = data[at:cut]
                    at = cut
        for w in words:
            if w not in into:
                into[w] = np.array(self._ids(w.decode()), dtype="<u4").tobytes()

    def look_up(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words, lower-cased but for those that hold `<|`."""
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        found = list(map(cache.get, words))
        if None not in found:
            return found
        new = [w for w, i in zip(words, found, strict=True) if i is None]
        rare: dict[bytes, bytes] = {}
        self.learn([w for w in new if len(w) <= CACHE_CHARS], cache)
        self.learn([w for w in new if len(w) > CACHE_CHARS], rare)
        return [(cache[w] if w in cache else rare[w]) if i is None else i for w, i in zip(words, found, strict=True)]

    def batch(self, texts):
        """(ids of an Arrow string array's texts in one array, each text's first position and the end).

        Words are split and numbered by Arrow, so only a batch's distinct words reach Python.
        """
        import numpy as np
        import pyarrow.compute as pc

        given = pc.fill_null(texts, "")
        texts = pc.ascii_lower(given)
        special = pc.any(pc.match_substring(given, "<|")).as_py()
        if not special:  # no special token can be cut
            texts = pc.replace_substring_regex(texts, MARKS, r"\1 \2")
        split = pc.ascii_split_whitespace(texts)
        offsets = split.offsets.to_numpy()
        words = split.values
        if special:  # special tokens are matched by case, so their words stay as given
            own = pc.ascii_split_whitespace(given).values
            words = pc.if_else(pc.match_substring(own, "<|"), own, words)
        words = words.dictionary_encode()
        codes = words.indices.to_numpy()
        ids = self.look_up([w.encode() for w in words.dictionary.to_pylist()])
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        size = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(size)])
        return flat[np.repeat(starts[codes] - ends[:-1], size) + np.arange(ends[-1])], ends[offsets]


def worker_encoder(blob: str) -> WordEncoder:
    """One encoder for all tasks that a Python worker runs."""
    kept = sys.__dict__.setdefault("_proofmill_encoders", {})
    key = zlib.crc32(blob.encode())
    if key not in kept:
        kept[key] = WordEncoder(blob)
    return kept[key]


def filesystem(path: str):
    """(pyarrow file system, path inside it) of a folder that driver and executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def pack_planes(ids: bytes, compressor) -> list[bytes]:
    """One block of u32 ids as four compressed byte planes."""
    import numpy as np

    planes = np.frombuffer(ids, dtype=np.uint8).reshape(-1, 4).T
    return [compressor.compress(planes[k].tobytes()) for k in range(4)]


def unpack_planes(planes: list[bytes], decompressor) -> bytes:
    import numpy as np

    parts = [np.frombuffer(decompressor.decompress(p), dtype=np.uint8) for p in planes]
    return np.stack(parts, axis=1).tobytes()


class ShardWriter:
    def __init__(self, folder: str, shard: int, attempt: int):
        import zstandard

        self.fs, root = filesystem(folder)
        self.fs.create_dir(root, recursive=True)
        self.temp, self.final = f"{root}/.writing-{shard:06d}-{attempt}", f"{root}/shard-{shard:06d}.pmtb"
        self.out = self.fs.open_output_stream(self.temp)
        self.out.write(MAGIC + struct.pack("<I", VERSION))
        self.at, self.pending, self.size = 8, [], 0
        self.blocks, self.doc_ids, self.counts = [], [], []
        self.zstd = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.pending.append(ids)
        self.size += len(ids)
        if self.size >= 4 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        data = b"".join(self.pending)
        cut = len(data) if last else len(data) - len(data) % (4 * BLOCK)
        for k in range(0, cut, 4 * BLOCK):
            block = data[k : min(cut, k + 4 * BLOCK)]
            planes = pack_planes(block, self.zstd)
            self.blocks.append([self.at, len(block) // 4, *map(len, planes)])
            for p in planes:
                self.out.write(p)
                self.at += len(p)
        self.pending, self.size = [data[cut:]], len(data) - cut

    def close(self) -> tuple[str, int, int]:
        self._flush(True)
        footer = self.zstd.compress(json.dumps({"blocks": self.blocks, "doc_ids": self.doc_ids, "counts": self.counts}).encode())
        self.out.write(footer + struct.pack("<QI", self.at, len(footer)) + MAGIC)
        self.out.close()
        self.fs.move(self.temp, self.final)
        return self.final, len(self.counts), sum(self.counts)


def read_shard(folder: str, path: str):
    """Yields (doc_id, local start, ids as little-endian u32 chunks) in the file's order."""
    import zstandard

    fs, _ = filesystem(folder)
    zstd = zstandard.ZstdDecompressor()
    with fs.open_input_file(path) as f:
        f.seek(f.size() - 16)
        tail = f.read(16)
        offset, size = struct.unpack("<QI", tail[:12])
        if tail[12:] != MAGIC:
            raise ValueError(f"{path} is not a whole shard")
        f.seek(offset)
        footer = json.loads(zstd.decompress(f.read(size)))
        blocks, have, start = iter(footer["blocks"]), b"", 0
        for doc_id, n in zip(footer["doc_ids"], footer["counts"], strict=True):
            left, parts = 4 * n, []
            while left:
                if not have:
                    at, _, *sizes = next(blocks)
                    f.seek(at)
                    have = unpack_planes([f.read(s) for s in sizes], zstd)
                take = have[:left]
                have, left = have[len(take) :], left - len(take)
                parts.append(take)
            yield doc_id, start, parts
            start += n


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, doc_id: str = "doc_id") -> DataFrame:
    """Writes the shards; returns the lazy manifest: shard, path, n_docs, n_tokens (running it writes)."""
    with open(tokenizer or default_tokenizer()) as f:
        blob = docs.sparkSession.sparkContext.broadcast(f.read())

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        writer, encoder, end = None, worker_encoder(blob.value), struct.pack("<I", END_ID)
        for batch in batches:
            writer = writer or ShardWriter(folder, task.partitionId(), task.taskAttemptId())
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                ids, at = encoder.batch(part.column(1))
                for d, i, j in zip(part.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    writer.add(d, ids[i:j].tobytes() + end)
        release()
        if writer:
            path, n, tokens = writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "path": path, "n_docs": n, "n_tokens": tokens}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), "text")
    ranged = rows.repartitionByRange(partitions(docs), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return ranged.mapInArrow(write, "shard int, path string, n_docs long, n_tokens long")


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shard files."""
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def read(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                for doc_id, start, parts in read_shard(folder, row["path"]):
                    crc = 0
                    for p in parts:
                        crc = zlib.crc32(p, crc)
                    out.append({"doc_id": doc_id, "start": row["base"] + start, "n_tokens": sum(map(len, parts)) // 4, "ids_crc32": crc})
                    if len(out) >= 4096:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    dealt = based.select("path", "base").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Encode, write, read back."""
    space = Workspace(docs.sparkSession, "tokens")
    folder = f"{space.path}/shards"
    manifest = space.save(write_shards(docs, folder, tokenizer), "manifest")
    return read_documents(manifest, folder)
