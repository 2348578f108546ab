"""Operator 2: media columns in archives, and a data source that reads them by byte range.

An archive holds members one after the other (here grey PNG images of 8-bit samples, 64 to a row), then an index of
their keys, offsets and sizes in blocks of ``INDEX_ROWS``, then a directory of the blocks and a footer. ``MediaArchive``
plans partitions as byte ranges over all archives of a directory: a member belongs to the range in which it starts. Ranges
grow with the whole so that there are ``MOST_RANGES`` at most, and one may span several archives. A partition reads the
directory and the blocks of the index that its range touches, reads its members in runs of a few MB, streams them as Arrow batches, and where a run or a member can't be read or decoded, it reads that member again by its own
offset, a few times, before the read fails with the archive, key and offset in the message.

Tasks write archives of their own name; only those in the manifest count, so lost or repeated tasks do no harm.
Null text is the empty text, which is stored as 64 zero samples; a null key is kept; repeated rows are stored again;
an empty table gives no archive; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import file_system, fresh_path, slices, text_of

MAGIC = b"TSMEDIA1"
WIDTH = 64
PNG = b"\x89PNG\r\n\x1a\n"
#: Least bytes of a range, most ranges that are planned, and members in a block of the index.
RANGE_BYTES, MOST_RANGES, INDEX_ROWS = 8 << 20, 100_000, 4096
RUN_BYTES = 4 << 20
RETRIES = 3
MANIFEST = "path string, n_members long, data_bytes long"
INDEX = pa.schema([("key", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("n_bytes", pa.int64())])


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: bytes, level: int = 6) -> bytes:
    """8-bit grey samples, ``WIDTH`` to a row, as a PNG file; the same samples give the same file."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> bytes:
    """The samples of a file of ``encode_png``; raises ValueError where a checksum or the shape is wrong."""
    if data[:8] != PNG:
        raise ValueError("not a PNG file")
    at, body, shape = 8, b"", (0, 0)
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if len(part) != n or struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + part):
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            shape = struct.unpack(">II", part[:8])
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("a PNG row is filtered")
    return lines[:, 1:].tobytes()


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of ``WIDTH``."""
    return data + b"\0" * (max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def average_hash(payload: bytes) -> str:
    """64 bits: whether each column of samples is brighter than the mean; 16 hexadecimal digits."""
    means = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH).mean(axis=0, dtype=np.float64)
    return np.packbits(means > means.mean()).tobytes().hex()


def index_of(rows: list[tuple], at: int) -> bytes:
    """The blocks of the index of an archive whose members end at byte ``at``, their directory, and the footer."""
    out, directory = io.BytesIO(), []
    for k in range(0, len(rows), INDEX_ROWS):
        start = out.tell()
        table = pa.table([pa.array(c, pa.int64()) for c in zip(*rows[k : k + INDEX_ROWS], strict=True)], schema=INDEX)
        with pa.ipc.new_stream(out, INDEX, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(table)
        directory.append((rows[k][1], at + start, out.tell() - start))
    return out.getvalue() + np.array(directory, "<i8").tobytes() + struct.pack("<QQ", at + out.tell(), len(directory)) + MAGIC


def write_media_archives(docs: DataFrame, out: str | None = None, *, key: str = "doc_id", text: str = "text", level: int = 6) -> str:
    """Stores each text's padded bytes as an image member of an archive under ``out``; returns ``out``."""
    out = out or fresh_path(docs.sparkSession, "media")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = file_system(out)
        name, sink, at, rows = f"archive-{uuid.uuid4().hex}.media", None, len(MAGIC), []
        for batch in batches:
            for piece in slices(batch, "_text"):
                for k, data in zip(piece.column("_key").to_pylist(), piece.column("_text"), strict=True):
                    raw = data.as_buffer().to_pybytes()
                    member = encode_png(pad(raw), level)
                    if sink is None:
                        files.create_dir(f"{base}/archives", recursive=True)
                        sink = files.open_output_stream(f"{base}/archives/{name}")
                        sink.write(MAGIC)
                    sink.write(member)
                    rows.append((k, at, len(member), len(raw)))
                    at += len(member)
        if sink is not None:
            sink.write(index_of(rows, at))
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{out}/archives/{name}"], "n_members": pa.array([len(rows)], pa.int64()), "data_bytes": pa.array([at], pa.int64())})

    rows = docs.select(F.col(key).cast("long").alias("_key"), text_of(docs, text).alias("_text"))
    rows.mapInArrow(write, MANIFEST).write.parquet(f"{out}/manifest")
    return out


class _Range(InputPartition):
    def __init__(self, parts: list[tuple[str, int, int]]):
        self.parts = parts  # path, start and end


class _MediaReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.step = int(options.get("rangeBytes", RANGE_BYTES))
        self.most = int(options.get("mostRanges", MOST_RANGES))
        self.retries = int(options.get("retries", RETRIES))

    def partitions(self):
        import pyarrow.dataset as ds

        files, base = file_system(f"{self.path}/manifest")
        table = ds.dataset(base, filesystem=files, format="parquet").to_table(columns=["path", "data_bytes"]).sort_by("path")
        sizes = np.asarray(table.column("data_bytes"))
        return self._ranges(table.column("path"), sizes, max(self.step, -(-int(sizes.sum()) // self.most))) or [_Range([])]

    @staticmethod
    def _ranges(paths, sizes, step):
        """Ranges of ``step`` bytes over all archives in a row."""
        out, parts, room = [], [], step
        for path, size in zip(paths, sizes.tolist(), strict=True):
            at = 0
            while at < size:
                n = min(room, size - at)
                parts.append((str(path), at, at + n))
                at, room = at + n, room - n
                if not room:
                    out.append(_Range(parts))
                    parts, room = [], step
        return [*out, _Range(parts)] if parts else out

    def read(self, partition):
        for path, start, end in partition.parts:
            yield from self._read(path, start, end)

    def _read(self, path, start, end):
        files, at = file_system(path)
        for run in self._runs(self._index(files, at, start, end), start, end):
            first, last = run[0], run[-1]
            try:
                with files.open_input_file(at) as source:
                    data = source.read_at(last["offset"] + last["size"] - first["offset"], first["offset"])
            except OSError:
                data = b""  # each member is read again on its own
            rows = []
            for m in run:
                member = data[m["offset"] - first["offset"] :][: m["size"]]
                rows.append((m["key"], m["n_bytes"], *self._decoded(files, at, m, member)))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], names=["key", "n_bytes", "media", "payload"])

    @staticmethod
    def _index(files, at, start, end):
        """The blocks of the index with the members that start in a range."""
        with files.open_input_file(at) as source:
            size = source.size()
            tail = source.read_at(24, size - 24)
            if tail[16:] != MAGIC:
                raise ValueError(f"{at} is not a media archive, or cut short")
            place, n = struct.unpack("<QQ", tail[:16])
            blocks = np.frombuffer(source.read_at(24 * n, place), "<i8").reshape(n, 3)
            lo = max(int(np.searchsorted(blocks[:, 0], start, side="right")) - 1, 0)
            hi = int(np.searchsorted(blocks[:, 0], end))
            return pa.concat_tables([INDEX.empty_table(), *(pa.ipc.open_stream(pa.BufferReader(source.read_at(b[2], b[1]))).read_all() for b in blocks[lo:hi].tolist())])

    @staticmethod
    def _runs(index, start, end):
        offsets = np.asarray(index.column("offset"))
        lo, hi = np.searchsorted(offsets, [start, end])
        run, held = [], 0
        for m in index.slice(lo, hi - lo).to_pylist():
            if run and held + m["size"] > RUN_BYTES:
                yield run
                run, held = [], 0
            run.append(m)
            held += m["size"]
        if run:
            yield run

    def _decoded(self, files, at, m, member):
        for left in range(self.retries, -1, -1):
            try:
                if len(member) != m["size"]:
                    raise OSError("the member is cut short")
                return member, decode_png(member)
            except (OSError, ValueError, zlib.error, struct.error) as e:
                if not left:
                    raise ValueError(f"{at}: member {m['key']} at byte {m['offset']} can't be read: {e}") from e
            try:
                with files.open_input_file(at) as source:
                    member = source.read_at(m["size"], m["offset"])
            except OSError:
                member = b""
        raise AssertionError


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").load(dir)``: key, n_bytes, media (the stored file) and payload (its samples)."""

    @classmethod
    def name(cls):
        return "media_archive"

    def schema(self):
        return "key long, n_bytes long, media binary, payload binary"

    def reader(self, schema):
        return _MediaReader(self.options)


def read_media_archives(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(path)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes, checksums and the feature of each payload as read back."""
    for batch in batches:
        rows = []
        for key, n, media, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), average_hash(payload)))
        if rows:
            names = [x.split()[0] for x in DIGEST.split(", ")]
            yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: stores every document's bytes as images in archives, reads them by byte range and digests them."""
    path = write_media_archives(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read_media_archives(spark, path).select("key", "n_bytes", "media", "payload").mapInArrow(digests, DIGEST)
