"""Staged shards and packed exchanges, which the two repeated-substring operators share.

Documents are written once to the shared folder, in files of about ``SHARD`` bytes of text (a longer document alone),
whatever the input's partitions are. From then on a task works on one shard at a time: it reads the files, sends packed
arrays of keys to buckets of the hash space, and gets packed answers back, so no text moves. A shard sends each distinct
key once, so a key that a third of all rows hold costs a bucket one entry per shard. Keys travel as differences in byte
planes under zstandard, and keys that only have to tell "once" from "more often" are cut to as many bits as the size of
the corpus asks for. A written table lists the files; it and the answers are dealt out by shard, so neither the driver nor
a task holds the list. Lost executors cost their tasks and nothing else.

Every shard sends a row to every bucket, so both grow with the square root of the corpus beyond some hundred GB: shards
then take several files, and a row still holds ``ROW`` keys or so.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, file_system, fresh_path, slices, text_of, written

ANSWER = "shard long, level int, bucket int, bits binary"
QUESTION = "bucket int, shard long, data binary, n int"
#: A null id sorts last, and its rows don't shadow each other.
NO_ID = np.iinfo(np.int64).max
#: Bytes of text of a file, and for each bucket; keys that a row should hold.
SHARD, BUCKET, ROW = 12 << 20, 8 << 20, 32
#: Bits of a shortened key beyond those that count the corpus's bytes: a chance meeting for one key in a thousand.
SPARE_BITS = 10
#: Strings that each file shows for the choice of splitters, their length, and the most files that are asked.
SHOWN, SHOWN_BYTES, SHOWING = 64, 20, 4096


@dataclass
class Staged:
    """Documents in files of (doc_id, text); ``table`` has shard, uri and shown; ``buckets`` parts the hash space has."""

    spark: SparkSession
    table: DataFrame
    shards: int
    n_bytes: int
    buckets: int

    @property
    def mask(self) -> np.uint64:
        """Shortens 64-bit keys to the bits that keep chance meetings rare in a corpus of this size."""
        bits = min(64, max(40, self.n_bytes.bit_length() + SPARE_BITS))
        return np.uint64((1 << 64) - (1 << (64 - bits)))


def stage(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shard: int = SHARD, bucket: int = BUCKET) -> Staged:
    spark = docs.sparkSession
    path = fresh_path(spark, "staged")
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = file_system(path)
        files.create_dir(base, recursive=True)
        sink = writer = None
        number, size, shown = 0, 0, []

        def closed() -> pa.RecordBatch:
            writer.close()
            sink.close()
            return pa.RecordBatch.from_pydict({"shard": pa.array([number], pa.int64()), "uri": [f"{path}/{number:016x}"], "n_bytes": pa.array([size], pa.int64()), "shown": pa.array([b"".join(shown)], pa.binary())})

        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                if writer is None:
                    number, size, shown = uuid.uuid4().int >> 65, 0, []
                    sink = files.open_output_stream(f"{base}/{number:016x}")
                    writer = pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                writer.write_batch(pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text")], schema=schema))
                raw, _ = text_bytes(piece.column("text"))
                size += len(raw)
                step = max(shard // SHOWN, 1)
                shown += [raw[k : k + SHOWN_BYTES].tobytes() for k in range((-size) % step, len(raw) - SHOWN_BYTES, step)]
                if size >= shard:
                    yield closed()
                    writer = None
        if writer is not None:
            yield closed()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    with arrow_rows(spark, 1000):
        table = written(rows.mapInArrow(write, "shard long, uri string, n_bytes long, shown binary"), "staged-files")
    count, n_bytes = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    wide = math.isqrt(6 * ROW * n_bytes)  # bytes of text of a shard and a bucket at which a row holds that many keys
    shards = count
    if wide > shard:
        shards = max(1, n_bytes // wide)
        table = table.withColumn("shard", F.pmod(F.xxhash64("uri"), F.lit(shards)))
    return Staged(spark, table, shards, n_bytes, max(1, n_bytes // max(bucket, wide)))


def splitters(staged: Staged, parts: int) -> np.ndarray:
    """Strings of ``SHOWN_BYTES`` bytes, sorted, that cut all such strings into ``parts`` ranges of about one size.

    They come from the strings that up to ``SHOWING`` files show; this sample decides on balance alone.
    """
    rows = staged.table.orderBy(F.xxhash64("uri")).limit(SHOWING).select("shown").collect()
    seen = np.sort(np.frombuffer(b"".join(r["shown"] for r in rows), f"S{SHOWN_BYTES}"))
    at = (np.arange(1, parts) * len(seen)) // max(parts, 1)
    return np.unique(seen[at]) if len(seen) else seen


def read_shard(uris: list[str]) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """doc_ids and texts of a shard, about a MB at a time."""
    for uri in uris:
        files, at = file_system(uri)
        with files.open_input_stream(at) as source:
            for batch in pa.ipc.open_stream(source):
                yield np.asarray(batch.column("doc_id").fill_null(NO_ID)), batch.column("text")


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some texts in a row, and where they start and end in it (one number more than texts)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The part of the hash space that a 64-bit key falls in; ascending with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def cuts(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) over sorted keys."""
    b = bucket_of(keys, buckets)
    edges = [0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)] if len(b) else [0]
    for lo, hi in zip(edges, edges[1:], strict=False):
        yield int(b[lo]), lo, hi


def _plane(x: np.ndarray) -> bytes:
    """An array's bytes by significance, rows of bytes as they are."""
    return x.tobytes() if x.ndim > 1 or x.itemsize == 1 else np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def packed(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted 64-bit keys and further columns (rows along the first axis)."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=3).compress(b"".join(map(_plane, (steps, *columns))))


def unpack(data: bytes, n: int, *kinds) -> list[np.ndarray]:
    """The packed keys and columns again; a kind is a dtype, or a dtype and a row width."""
    raw, out, at = zstandard.ZstdDecompressor().decompress(data), [], 0
    for k, kind in enumerate((np.uint64, *kinds)):
        dtype, width = kind if isinstance(kind, tuple) else (kind, 1)
        size = np.dtype(dtype).itemsize
        a = np.frombuffer(raw, np.uint8, n * width * size, at)
        if width > 1:
            a = a.reshape(n, width)
        else:
            a = np.ascontiguousarray(a.reshape(size, n).T).view(dtype).reshape(-1)
        out.append(np.cumsum(a, dtype=np.uint64) if not k else a)
        at += n * width * size
    return out


def send(shard: int, keys: np.ndarray, buckets: int, *columns: np.ndarray, first: int = 0) -> Iterator[pa.RecordBatch]:
    """One row per bucket of the hash space, numbered from ``first``: the sorted keys and further columns, packed."""
    return sent(shard, ((first + b, packed(keys[lo:hi], *(c[lo:hi] for c in columns)), hi - lo) for b, lo, hi in cuts(keys, buckets)))


def sent(shard: int, rows: Iterator[tuple[int, bytes, int]]) -> Iterator[pa.RecordBatch]:
    """Rows of (bucket, data, n) as batches of a MB or so."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size > 1 << 20:
            yield _question(shard, held)
            held, size = [], 0
    if held:
        yield _question(shard, held)


def _question(shard: int, rows: list[tuple]) -> pa.RecordBatch:
    b, data, n = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array([shard] * len(b), pa.int64()), pa.array(data, pa.binary()), pa.array(n, pa.int32())], names=["bucket", "shard", "data", "n"])


def each_shard(staged: Staged, run: Callable[[int, list[str], dict], Iterator[pa.RecordBatch]], schema: str, answers: DataFrame | None = None) -> DataFrame:
    """run(shard, files, answers by (level, bucket)) for every shard, one at a time in a task; what it yields is handed on."""
    every = staged.table.select("shard", F.lit(-1).alias("level"), F.lit(-1).alias("bucket"), F.col("uri").cast("binary").alias("bits"))
    if answers is not None:
        every = every.union(answers.select("shard", "level", "bucket", "bits"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, uris, got = None, [], {}
        for batch in batches:
            for shard, level, bucket, bits in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if shard != now:
                    if now is not None:
                        yield from run(now, sorted(uris), got)
                    now, uris, got = shard, [], {}
                if level < 0:
                    uris.append(bits.decode())
                else:
                    got[level, bucket] = bits
        if now is not None:
            yield from run(now, sorted(uris), got)

    # The answers are small, the work behind them isn't: a given number of partitions keeps tasks from being drawn together.
    dealt = every.repartition(max(staged.shards, 1), "shard").sortWithinPartitions("shard", "level", "bucket")
    return dealt.mapInArrow(each, schema)


def answer(level: int, bucket: int, shards: list[int], sizes: list[int], flags: np.ndarray) -> pa.Table:
    """Flags of all entries of a bucket, in the order in which the shards sent them, cut and packed by shard."""
    return answers(level, bucket, shards, sizes, flags, lambda x: np.packbits(x).tobytes())


def answers(level: int, bucket: int, shards: list[int], sizes: list[int], values: np.ndarray, pack: Callable[[np.ndarray], bytes]) -> pa.Table:
    """A row for each shard with values that aren't zero."""
    rows, at = [], 0
    for s, n in zip(shards, sizes, strict=True):
        if values[at : at + n].any():
            rows.append((s, level, bucket, pack(values[at : at + n])))
        at += n
    cols = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("shard", "level", "bucket", "bits"), cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)})


def asked(questions: DataFrame, level: int, decide: Callable[[pa.Table], np.ndarray], name: str) -> DataFrame:
    """Answers to questions: ``decide`` flags all entries of a bucket; the answers are a written table."""

    def reduce(key, table):
        table = table.sort_by("shard")
        flags = decide(table)
        return answer(level, key[0].as_py(), table.column("shard").to_pylist(), table.column("n").to_pylist(), flags)

    return written(questions.groupBy("bucket").applyInArrow(reduce, ANSWER), name)


def shared_keys(table: pa.Table) -> np.ndarray:
    """Whether another shard has sent the same key (a shard sends a key once)."""
    keys = np.concatenate([unpack(d, n)[0] for d, n in zip(table.column("data").to_pylist(), table.column("n").to_pylist(), strict=True)])
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    out = np.zeros(len(k), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def flags_of(keys: np.ndarray, buckets: int, answers: dict, level: int) -> np.ndarray:
    """The answers to this shard's sorted keys."""
    out = np.zeros(len(keys), bool)
    for b, lo, hi in cuts(keys, buckets):
        if (bits := answers.get((level, b))) is not None:
            out[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit numbers over the hash space."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolling(x: np.ndarray, size: int, base: int, axis_len: int | None = None) -> np.ndarray:
    """Polynomial hashes of all windows of ``size`` along the last axis, by doubling: a window of 2k is two of k."""
    n = x.shape[-1]
    parts, k, h = [], 1, x  # windows of powers of two, joined for the bits of ``size``
    acc, done = None, 0
    while True:
        if size & k:
            if acc is None:
                acc, done = h, k
            else:  # h's window first, then what is gathered so far
                width = acc.shape[-1] - k
                with np.errstate(over="ignore"):
                    acc = h[..., :width] * np.uint64(pow(base, done, 1 << 64)) + acc[..., k : k + width]
                done += k
        if done == size:
            return acc[..., : n - size + 1]
        with np.errstate(over="ignore"):
            h = h[..., : h.shape[-1] - k] * np.uint64(pow(base, k, 1 << 64)) + h[..., k:]
        k *= 2


def leftmost_least(v: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes, the position of the leftmost smallest, by the hashes' upper 32 bits.

    Hash and position go into one number, so that a few minima of whole rows find all windows' places.
    """
    if len(v) >= 1 << 32:
        raise ValueError("a row has fewer than 2**32 places")
    m, k = (v & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(v), dtype=np.uint64), 1
    while 2 * k <= width:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    if k < width:  # two overlapping windows of a power of two
        n = len(v) - width + 1
        m = np.minimum(m[:n], m[width - k : width - k + n])
    return (m & np.uint64(0xFFFFFFFF)).astype(np.int64)


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, kept for the longest row so far."""
    if len(_POWERS.get("up", ())) < n:
        base = 0x9E3779B97F4A7C15
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            row = np.full(n, b, np.uint64)
            row[0] = 1
            _POWERS[name] = np.cumprod(row, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


_LETTERS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
_BLANK = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))


#: Bytes whose words are hashed at once.
PIECE = 1 << 20


def word_hashes(raw: np.ndarray, ends: np.ndarray, most: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts that lie in a row of bytes, and where each text's words start in them."""
    hashes, firsts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(raw):
        stop = at + most
        while stop < len(raw) and not len(gap := np.flatnonzero(_BLANK[raw[stop : stop + most]])):
            stop += most
        stop = stop + int(gap[0]) if stop < len(raw) else len(raw)  # at white space, so no word is cut
        lo, hi = np.searchsorted(ends, (at, stop))
        h, first = _word_hashes(raw[at:stop], ends[lo:hi] - at)
        hashes.append(h)
        firsts.append(first + at)
        at = stop
    return np.concatenate(hashes), np.searchsorted(np.concatenate(firsts), ends)


def _word_hashes(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and where they start.

    A word's hash is a difference of running sums of powers, brought to a common place by the inverse power.
    """
    n = len(raw)
    blank = _BLANK[raw]
    cut = np.zeros(n + 1, bool)
    cut[ends[(ends < n)]] = True  # a word ends with its text
    begins = ~blank & np.concatenate([[True], blank[:-1] | cut[1:n]])
    stops = ~blank & np.concatenate([blank[1:] | cut[1:n], [True]])
    first, last = np.flatnonzero(begins), np.flatnonzero(stops)
    up, down = _powers(n)
    sums = np.cumsum(_LETTERS[raw] * up, dtype=np.uint64)
    before = np.where(first > 0, sums[np.maximum(first - 1, 0)], np.uint64(0))
    return mixed((sums[last] - before) * down[first] + (last - first).astype(np.uint64)), first
