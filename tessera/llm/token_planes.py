"""Operator 1: token ids in a binary format of byte or bit planes.

A shard file holds the ids of its documents in one row. The row is cut into blocks of ``block`` ids; each block, as
little-endian 32-bit integers, is transposed into 4 byte planes or 32 bit planes, each plane is compressed with
zstandard on its own, and a chunk index (offset and sizes of each block's planes) and a document index (doc_id, ids)
stand at the end of the file. High planes of a vocabulary under 2**16 are all zero and take a few bytes.

Shards are ranges of (doc_id, hash of the text), so they ascend, and rows that share a doc_id still spread. A task
writes a file of its own name; only files that the manifest names count, so a repeated or lost task does no harm.

Null text is the empty text, null doc_id sorts first and is kept, repeated rows are encoded again, an empty table
gives an empty manifest, and other columns are ignored.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_bytes, file_system, fresh_path, slices, split_words, text_of

MAGIC = b"TSPLANE1"
BLOCK = 1 << 16
#: Words, and pieces of words, in each of the two generations whose ids a worker keeps. This bounds memory, not what is encoded.
CACHED = 250_000
#: Words that are learned, and words whose ids are placed, at once.
LEARNED, PLACED = 20_000, 1 << 16
#: Bytes of text of a batch for Python, and of what is encoded at once; a longer row alone.
BATCH = 4 << 20
MANIFEST = "part int, path string, n_docs long, n_ids long"


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Byte planes (4) or bit planes (32, least significant first) of a block of 32-bit ids."""
    raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if not bits:
        return [raw[:, k].tobytes() for k in range(4)]
    return [np.packbits((raw[:, k // 8] >> (k % 8)) & 1).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The inverse of ``to_planes``."""
    raw = np.zeros((n, 4), np.uint8)
    if len(planes) == 4:
        for k, plane in enumerate(planes):
            raw[:, k] = np.frombuffer(plane, np.uint8)
    else:
        for k, plane in enumerate(planes):
            raw[:, k // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n) << (k % 8)
    return raw.reshape(-1).view("<u4")


def _ipc(table: pa.Table) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return out.getvalue()


class ShardWriter:
    """Writes one shard: blocks as they fill, the indexes at the end."""

    def __init__(self, sink, block: int = BLOCK, bits: bool = False, level: int = 3):
        self.sink, self.block, self.bits = sink, block, bits
        self.zip = zstandard.ZstdCompressor(level=level)
        self.pending: list[np.ndarray] = []
        self.held = self.n_ids = self.at = 0
        self.chunks: list[tuple[int, int, list[int]]] = []
        self.docs: list[tuple[list, np.ndarray]] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append((doc_ids, sizes))
        at = 0
        while self.held + len(ids) - at >= self.block:
            stop = at + self.block - self.held
            self._chunk(np.concatenate([*self.pending, ids[at:stop]]))
            self.pending, self.held, at = [], 0, stop
        self.pending.append(ids[at:].copy())
        self.held += len(ids) - at

    def _chunk(self, ids: np.ndarray) -> None:
        planes = [self.zip.compress(p) for p in to_planes(ids, self.bits)]
        self.chunks.append((self.at, len(ids), [len(p) for p in planes]))
        self.n_ids += len(ids)
        for p in planes:
            self._put(p)

    def close(self) -> None:
        if self.held:
            self._chunk(np.concatenate(self.pending))
        chunks = pa.table({"offset": pa.array([c[0] for c in self.chunks], pa.int64()), "n_ids": pa.array([c[1] for c in self.chunks], pa.int64()), "planes": pa.array([c[2] for c in self.chunks], pa.list_(pa.int32()))})
        docs = pa.table({"doc_id": pa.array([x for d, _ in self.docs for x in d], pa.int64()), "n_ids": pa.array(np.concatenate([s for _, s in self.docs] or [np.zeros(0, np.int64)]), pa.int64())})
        a, b = _ipc(chunks), _ipc(docs)
        self._put(a + b + struct.pack("<QQ", len(a), len(b)) + MAGIC)


class ShardReader:
    """Reads a shard back: its indexes, and its ids block by block."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        tail = source.read_at(24, end - 24)
        if tail[16:] != MAGIC or source.read_at(8, 0) != MAGIC:
            raise ValueError("not a shard of token planes, or cut short")
        a, b = struct.unpack("<QQ", tail[:16])
        at = end - 24 - a - b
        self.chunks = pa.ipc.open_stream(pa.BufferReader(source.read_at(a, at))).read_all()
        self.docs = pa.ipc.open_stream(pa.BufferReader(source.read_at(b, at + a))).read_all()

    def blocks(self) -> Iterator[np.ndarray]:
        unzip = zstandard.ZstdDecompressor()
        for row in self.chunks.to_pylist():
            data, planes, k = self.source.read_at(sum(row["planes"]), row["offset"]), [], 0
            for n in row["planes"]:
                planes.append(unzip.decompress(data[k : k + n]))
                k += n
            yield from_planes(planes, row["n_ids"])


def byte_letters() -> dict[int, str]:
    """The letter for each byte in byte-level vocabularies: printable Latin-1 as it is, others from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(rest)}


LETTERS = byte_letters()


class WordEncoder:
    """Encodes texts by their words, where the vocabulary's tokens never span white space.

    Words that weren't met lately are cut into pieces in one pass, and each distinct piece goes through the model's merges
    once. A word of characters up to U+017F (the dotted capital I aside) has the same lower case and pieces under
    Python's rules as under the tokenizer's; any other word, or one that holds a special token, goes through the whole
    tokenizer. So do whole texts, where the file's normaliser and splitter aren't the ones that are coded here.
    """

    PLAIN = r"[\x00-įı-ſ]*"
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: What stands in the file of a vocabulary that is cut like this.
    NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    SPLITTERS = [{"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]

    def __init__(self, path: str, cached: int = CACHED):
        import regex  # here, so that whoever only reads shards needn't load either library
        from tokenizers import Tokenizer

        self.plain, self.cut = regex.compile(self.PLAIN).fullmatch, regex.compile(rf"{self.PIECES}|\n").findall
        self.whole = Tokenizer.from_file(path)
        shape = json.loads(self.whole.to_str())
        self.by_words = (shape["normalizer"] or {}).get("normalizers") == self.NORMALIZERS and (shape["pre_tokenizer"] or {}).get("pretokenizers") == self.SPLITTERS
        self.by_words &= shape["model"]["type"] == "BPE" and not shape["model"].get("dropout") and not shape["post_processor"]
        self.by_words &= all(not t[k] for t in shape["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self.merge = self.whole.model.tokenize
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.cached = cached
        self.words, self.old_words = {}, {}  # ids as 32-bit numbers, of words met lately and of the generation before
        self.parts, self.old_parts = {"\n": b""}, {}  # and of pieces

    def _pieces(self, pieces: set[str]) -> None:
        """Learns pieces."""
        if len(self.parts) > self.cached:
            self.parts, self.old_parts = {"\n": b""}, self.parts
        known, old, merge = self.parts, self.old_parts.get, self.merge
        for p in pieces.difference(known):
            if (found := old(p)) is None:
                letters = p if p.isascii() and p.isprintable() else "".join([LETTERS[b] for b in p.encode()])
                found = array("I", [t.id for t in merge(letters)]).tobytes()
            known[p] = found

    def _learn(self, words: list[str]) -> None:
        """Learns words, none of which holds white space."""
        odd = [w for w in words if not w.isascii() and not self.plain(w)]
        joined = "\n".join(words)
        if any(t in joined for t in self.special):
            odd += [w for w in words if any(t in w for t in self.special)]
        if odd:
            self.words.update((w, array("I", e.ids).tobytes()) for w, e in zip(odd, self.whole.encode_batch_fast(odd, add_special_tokens=False), strict=True))
            words = [w for w in words if w not in self.words]
            joined = "\n".join(words)
        if not words:
            return
        pieces = self.cut(f"{joined.lower()}\n")
        self._pieces(set(pieces))
        ids = list(map(self.parts.__getitem__, pieces))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        data, ends = b"".join(ids), np.cumsum(sizes)[sizes == 0].tolist()  # only the ends of words have no ids
        self.words.update(zip(words, [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has; ``end_id`` ends each."""
        if not self.by_words:
            end = [] if end_id is None else [end_id]
            rows = [np.array(e.ids + end, np.uint32) for e in self.whole.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *rows]), np.array([len(x) for x in rows], np.int64)
        distinct, index, ends = split_words(texts)
        words = distinct.to_pylist()
        if len(self.words) > self.cached:
            self.words, self.old_words = {}, self.words
        known, missing = self.words, []
        for w in words:
            if w not in known:
                if (found := self.old_words.get(w)) is None:
                    missing.append(w)
                else:
                    known[w] = found
        for k in range(0, len(missing), LEARNED):
            self._learn(missing[k : k + LEARNED])
        ids = list(map(known.__getitem__, words))
        if end_id is not None:  # the end of a text is one more word, the last
            index = np.insert(index, ends[1:], len(ids))
            ends = ends + np.arange(len(ends))
            ids.append(array("I", [end_id]).tobytes())
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        flat, starts = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(sizes, dtype=np.int32) - sizes
        upto = np.concatenate([[0], np.cumsum(sizes[index])])
        out = np.empty(upto[-1], np.uint32)
        for k in range(0, len(index), PLACED):
            run, before = index[k : k + PLACED], upto[k : k + PLACED + 1]
            place = np.repeat((starts[run] - before[: len(run)] + before[0]).astype(np.int32), sizes[run])  # ids of a slice of texts: fewer than 2**31
            place += np.arange(len(place), dtype=np.int32)
            out[before[0] : before[len(run)]] = flat[place]
        return out, np.diff(upto[ends])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str, cached: int = CACHED) -> WordEncoder:
    """One encoder for each worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    _ENCODERS[path].cached = cached
    return _ENCODERS[path]


def write_token_planes(docs: DataFrame, tokenizer_path: str, out: str | None = None, *, key: str = "doc_id", text: str = "text", end_id: int | None = 1, block: int = BLOCK, bits: bool = False, batch: int = BATCH, cached: int = CACHED) -> str:
    """Encodes ``docs`` in ascending ``key`` order into shard files under ``out``; returns ``out``.

    The files are complete when the manifest table ``out``/manifest is there. Less of ``batch`` (bytes) and ``cached``
    (words) takes less of a worker's memory and more time; the ids are the same.
    """
    spark = docs.sparkSession
    out = out or fresh_path(spark, "token-planes")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        files, base = file_system(out)
        name = f"{base}/shards/shard-{part:06d}-{uuid.uuid4().hex}.planes"
        writer = sink = None
        n_docs = 0
        enc = encoder(tokenizer_path, cached)
        for rows in batches:
            if writer is None:
                files.create_dir(f"{base}/shards", recursive=True)
                sink = files.open_output_stream(name)
                writer = ShardWriter(sink, block, bits)
            for piece in slices(rows, "_text", batch):
                ids, sizes = enc.encode(piece.column("_text"), end_id)
                writer.add(piece.column("_key").to_pylist(), sizes, ids)
                n_docs += piece.num_rows
                del ids
                pa.default_memory_pool().release_unused()  # else Arrow keeps the most that it ever took
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{out}/shards/{name.rsplit('/', 1)[1]}"], "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([writer.n_ids], pa.int64())})

    rows = docs.select(F.col(key).cast("long").alias("_key"), text_of(docs, text).alias("_text")).withColumn("_tie", F.xxhash64("_text"))
    with arrow_bytes(spark, batch):
        rows.repartitionByRange("_key", "_tie").sortWithinPartitions("_key", "_tie").drop("_tie").mapInArrow(write, MANIFEST).write.parquet(f"{out}/manifest")
    return out


def shard_starts(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """The shard files in order, each with the ids of all shards before it: one entry for each file."""
    out, start = [], 0
    for row in spark.read.schema(MANIFEST).parquet(f"{path}/manifest").orderBy("part").collect():
        out.append((row["path"], start))
        start += row["n_ids"]
    return out


def documents_of(uri: str, before: int) -> Iterator[pa.RecordBatch]:
    """doc_id, start, n_tokens and ids_crc32 of a shard's documents, from its blocks; one block is held at a time."""
    files, at = file_system(uri)
    with files.open_input_file(at) as source:
        shard = ShardReader(source)
        doc_ids, sizes = shard.docs.column("doc_id").to_pylist(), np.asarray(shard.docs.column("n_ids"))
        starts = np.cumsum(sizes) - sizes
        blocks, held, at = shard.blocks(), np.zeros(0, np.uint32), 0  # held starts at id number ``at``
        rows: list[tuple] = []
        for k, (doc, n) in enumerate(zip(doc_ids, sizes.tolist(), strict=True)):
            crc, left, pos = 0, n, int(starts[k])
            while left:
                if pos >= at + len(held):
                    at, held = at + len(held), next(blocks)
                part = held[pos - at : pos - at + left]
                crc = zlib.crc32(part.tobytes(), crc)
                left, pos = left - len(part), pos + len(part)
            rows.append((doc, before + int(starts[k]), n, crc))
            if len(rows) == 10_000 or k == len(doc_ids) - 1:
                yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(("doc_id", "start", "n_tokens", "ids_crc32"), zip(*rows, strict=True), strict=True)})
                rows = []


def read_token_planes(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before it over all shards), n_tokens, ids_crc32 of every document, a task for each shard."""
    shards = shard_starts(spark, path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                if k < len(shards):
                    yield from documents_of(*shards[k])

    n = max(len(shards), 1)
    return spark.range(0, n, 1, n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """All ids by shard file, for tests and small sets."""
    out = {}
    for row in spark.read.parquet(f"{path}/manifest").orderBy("part").collect():
        files, at = file_system(row["path"])
        with files.open_input_file(at) as source:
            out[row["path"]] = np.concatenate([*ShardReader(source).blocks()] or [np.zeros(0, np.uint32)])
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: encodes every document with the word vocabulary, end id 1, and reads the shards back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_planes(spark, write_token_planes(docs, public_tokenizers.path("word_bpe_49k.json")))
