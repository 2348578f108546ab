"""Operator 10: SimHash near-duplicates by tiled exact comparison.

1. Fingerprints: words of the lower-cased text, shingles, XXH64 of each, and a bit for each of 64 positions that is set
   in over half the hashes. Equal fingerprints are one row from here on, with their smallest doc_id.
2. Tiles: distinct fingerprints sorted by their signature (the population counts of their four 16-bit words) and packed,
   at most ``TILE`` to a row. Two fingerprints within r bits have signatures within r of each other (sum of the four
   differences), so a tile meets only tiles of such signatures; all others are skipped, and nothing else is.
3. Comparison: exclusive-or and bit counts of whole tile pairs in numpy. A task hands on a spanning forest of the links
   it found, which keeps every component and grows with the fingerprints, not with the pairs.
4. Components: alternating large and small stars on the forest edges, a written table each round.

A signature has at most 17**4 values, which bounds the set of signatures that is sent to all tasks. Tile pairs grow with
the square of the distinct fingerprints, a twentieth of all pairs being compared: exact at any size, and a cost to know
of beyond some 10**8 distinct fingerprints.

With ``similarity``, links are wider and verified: fingerprints are of the distinct five-word shingles, and two within
the radius link only where the exact Jaccard similarity of their sets of shingle hashes is that high. Only texts of the
same set are one row, by a hash of it; equal fingerprints of different sets are candidates like any other. The sets lie in
files of the shared folder, a file for each task, and a tile says where; tiles lie there too, so that a tile isn't shuffled
once for each signature that it meets. A pair of sets is read only where the sizes of its sets
allow the similarity and the task's forest doesn't hold the link already. Beyond a radius of 4, counts of single words
prune little, and tiles are sorted by the population count of the whole.

Texts without words (null included) have fingerprint 0 and link like any other; a null doc_id never names a component
unless it is alone; repeated rows come out as often as they came in; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, drop_written, file_system, fresh_path, remove, slices, text_of, written

SHINGLE = 3
RADIUS = 3
SEED = 42
TILE = 1024
#: Pairs of tiles in a batch: up to a quarter of a MB each. Pairs for a task where they are places, and most such tasks.
TILE_PAIRS, PAIRS, MOST_PARTS = 100, 500, 100_000
#: Shingle hashes whose bits are counted at once.
COUNTED = 1 << 17
#: Words of a shingle where similarity is asked for.
VERIFIED = 5
#: Bytes of sets, and open files of sets, that a task holds on to.
HELD, OPEN = 16 << 20, 100


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of the space-joined shingles of the lower-cased words; a shorter text is one shingle, no words are none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    row = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(row, SEED)], np.uint64)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    starts = [0, *ends[: len(words) - size]]
    return np.array([digest(row[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :], strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as an unsigned number; zero for none."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), COUNTED):
        part = hashes[k : k + COUNTED].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """The Jaccard similarity of two sets, each sorted and without repeats; two empty ones are alike."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0.0 if len(y) else 1.0
    both = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
    return both / (len(x) + len(y) - both)


class Sets:
    """Reads sets of hashes from the files that ``fingerprints`` wrote to a folder."""

    def __init__(self, folder: str):
        self.files, self.base = file_system(folder)
        self.open: dict = {}
        self.held: dict = {}
        self.bytes = 0

    def read(self, file: int, at: int, n: int) -> np.ndarray:
        got = self.held.get((file, at, n))
        if got is None:
            source = self.open.get(file)
            if source is None:
                if len(self.open) >= OPEN:
                    self.close()
                source = self.open[file] = self.files.open_input_file(f"{self.base}/{file:016x}")
            if self.bytes > HELD:
                self.held, self.bytes = {}, 0
            got = self.held[file, at, n] = np.frombuffer(source.read_at(8 * n, at), "<u8")
            self.bytes += 8 * n
        return got

    def close(self) -> None:
        for source in self.open.values():
            source.close()
        self.open = {}


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SHINGLE, sets: str | None = None) -> DataFrame:
    """doc_id, fp (a 64-bit fingerprint as a signed long), node (what stands for the text: fp), file, at and n (null).

    With ``sets``, a folder, fp is of the distinct shingles, node a hash of their set, and their n sorted hashes lie there,
    in a file from byte at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, sink, end = uuid.uuid4().int >> 65, None, 0
        if sets is not None:
            files, base = file_system(sets)
            files.create_dir(base, recursive=True)
            sink = files.open_output_stream(f"{base}/{file:016x}", buffer_size=1 << 20)
        try:
            for batch in batches:
                for piece in slices(batch, "_text"):
                    fps, nodes, places = [], [], []
                    for t in piece.column("_text"):
                        hashes = shingle_hashes(t.as_buffer().to_pybytes(), size)
                        if sink is not None:
                            hashes = np.unique(hashes)
                            data = hashes.astype("<u8").tobytes()
                            nodes.append(xxhash.xxh64_intdigest(data, SEED))
                            sink.write(data)
                            places.append((file, end, len(hashes)))
                            end += 8 * len(hashes)
                        fps.append(fingerprint(hashes))
                    fp, node = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, nodes or fps))
                    place = zip(*places, strict=True) if places else [[None] * len(fps)] * 3
                    columns = [piece.column("doc_id"), fp, node, *(pa.array(c, pa.int64()) for c in place)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "node", "file", "at", "n"])
        finally:
            if sink is not None:
                sink.close()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(docs, text).alias("_text"))
    return rows.mapInArrow(run, "doc_id long, fp long, node long, file long, at long, n long")


def signature(fp: Column, parts: int) -> Column:
    """The population counts of the fingerprint's 4 words of 16 bits as one number to base 17, or of the whole (1)."""
    if parts == 1:
        return F.bit_count(fp).cast("int")
    out = F.lit(0)
    for k in range(4):
        out = out * 17 + F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF)))
    return out.cast("int")


def near_signatures(sig: int, radius: int, there: set[int], parts: int) -> list[int]:
    """Signatures among ``there`` from ``sig`` upwards whose counts differ from its by ``radius`` at most, in sum."""
    if parts == 1:
        return [s for s in range(sig, sig + radius + 1) if s in there]
    counts = [sig // 17**k % 17 for k in range(4)]
    out = []
    for a in range(-radius, radius + 1):
        for b in range(abs(a) - radius, radius - abs(a) + 1):
            for c in range(abs(a) + abs(b) - radius, radius - abs(a) - abs(b) + 1):
                for d in range(abs(a) + abs(b) + abs(c) - radius, radius - abs(a) - abs(b) - abs(c) + 1):
                    n = [x + y for x, y in zip(counts, (a, b, c, d), strict=True)]
                    s = sum(x * 17**k for k, x in enumerate(n))
                    if s >= sig and s in there and all(0 <= x <= 16 for x in n):
                        out.append(s)
    return out


class Forest:
    """A union-find that hands on only edges that join two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(x, x)) != r:
            up[x] = r
            x = p
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def tiles(distinct: DataFrame, radius: int, *, sets: str | None = None) -> DataFrame:
    """sig, lead (the tile's first node), near (signatures to meet) and packed (its fps).

    With ``sets`` a tile also holds nodes, file, at and n; it is written to that folder, and packed says where it lies, so
    that pairs of tiles are pairs of places.
    """
    parts = 4 if radius <= 4 else 1
    names = ["fp"] if sets is None else ["fp", "node", "file", "at", "n"]
    signed = distinct.select("fp", "node", *names[2:], signature(F.col("fp"), parts).alias("sig"))
    there = {r["sig"] for r in signed.select("sig").distinct().collect()}  # at most 17**4 numbers
    near = distinct.sparkSession.sparkContext.broadcast(there)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, held, file, sink, end = None, [], uuid.uuid4().int >> 65, None, 0
        if sets is not None:
            files, base = file_system(sets)
            files.create_dir(base, recursive=True)
            sink = files.open_output_stream(f"{base}/{file:016x}")

        def row():
            nonlocal end
            data = np.array([x[:-1] for x in held], np.int64).T.tobytes()
            if sink is not None:
                sink.write(data)
                data, end = np.array([file, end, len(data) // 8], np.int64).tobytes(), end + len(data)
            return sig, held[0][-1], near_signatures(sig, radius, near.value, parts), data

        try:
            for batch in batches:
                found = []
                for s, *values in zip(*(batch.column(c).to_pylist() for c in ("sig", *names, "node")), strict=True):
                    if held and (s != sig or len(held) == TILE):
                        found.append(row())
                        held = []
                    sig = s
                    held.append(values)
                if found:
                    yield _tile_batch(found)
            if held:
                yield _tile_batch([row()])
        finally:
            if sink is not None:
                sink.close()

    schema = "sig int, lead long, near array<int>, packed binary"
    return signed.repartitionByRange("sig", "fp", "node").sortWithinPartitions("sig", "fp", "node").mapInArrow(pack, schema)


def _tile_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["sig", "lead", "near", "packed"])


def links(tile_rows: DataFrame, radius: int = RADIUS, similarity: float | None = None, sets: str | None = None) -> DataFrame:
    """a and b: edges that keep the components of all pairs within ``radius`` bits (and of that similarity)."""
    width = 1 if similarity is None else 5

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        store, placed = (None, None) if similarity is None else (Sets(sets), Sets(sets))

        def tile(packed) -> np.ndarray:
            row = np.frombuffer(packed.as_buffer(), np.int64)
            return (row if placed is None else placed.read(*row.tolist()).view(np.int64)).reshape(width, -1)

        for batch in batches:
            found = []
            for la, lb, pa_, pb in zip(*(batch.column(n) for n in ("lead_a", "lead_b", "packed_a", "packed_b")), strict=True):
                a, b = tile(pa_), tile(pb)
                hit = np.bitwise_count(a[0].view(np.uint64)[:, None] ^ b[0].view(np.uint64)[None, :]) <= radius
                if la.as_py() == lb.as_py():
                    hit = np.triu(hit, 1)
                i, j = np.nonzero(hit)
                if store is not None and len(i):
                    x, y = a[4][i], b[4][j]
                    able = np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-6  # else no such similarity
                    i, j = i[able], j[able]
                if len(i):
                    at_a, at_b = (m[2:].T.tolist() for m in (a, b))
                    a, b = (m[min(width - 1, 1)].tolist() for m in (a, b))
                    for p, q in zip(i.tolist(), j.tolist(), strict=True):
                        if forest.root(a[p]) != forest.root(b[q]):
                            if store is None or jaccard(store.read(*at_a[p]), store.read(*at_b[q])) >= similarity:
                                forest.join(a[p], b[q])
                                found.append((a[p], b[q]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])
        if store is not None:
            store.close()
            placed.close()

    left = tile_rows.select(F.col("sig").alias("sig_a"), F.col("lead").alias("lead_a"), F.col("packed").alias("packed_a"), F.explode("near").alias("sig"))
    right = tile_rows.select("sig", F.col("lead").alias("lead_b"), F.col("packed").alias("packed_b"))
    pairs = left.join(right, "sig").where((F.col("sig_a") < F.col("sig")) | (F.col("lead_a") <= F.col("lead_b")))
    pairs = pairs.select("lead_a", "lead_b", "packed_a", "packed_b")
    if similarity is not None:  # pairs of places are small, the work behind them isn't: a number of parts that fits the work
        n = tile_rows.count()
        pairs = pairs.repartition(min(max(int(tile_rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * n // 2 // PAIRS), MOST_PARTS), "lead_a")
    return pairs.mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node it reaches), for all nodes of ``edges`` (a, b).

    A round sends each node's larger neighbours to its smallest one, then each node's smaller neighbours. The number of
    rounds grows with the logarithm of the nodes. Every round is a written table, so a lost executor costs one round.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        old, now = now, written(least.select("u", F.col("m").alias("v")).union(small).distinct(), "cc")
        was, mark = mark, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_written(old)
        if mark == was:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int | None = None, radius: int = RADIUS, similarity: float | None = None) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) of every document."""
    verify = similarity is not None
    sets = fresh_path(docs.sparkSession, "simhash-sets") if verify else None
    rows = written(fingerprints(docs, key=key, text=text, size=size or (VERIFIED if verify else SHINGLE), sets=sets), "simhash")
    place = [F.min(F.struct("file", "at", "n")).alias("place")] if verify else []
    distinct = rows.groupBy("fp", "node").agg(F.min("doc_id").alias("first"), *place)
    distinct = written(distinct.select("fp", "node", "first", *(["place.*"] if verify else [])), "simhash-distinct")
    tile_rows = written(tiles(distinct, radius, sets=sets), "simhash-tiles")
    with arrow_rows(docs.sparkSession, TILE_PAIRS):
        edges = written(links(tile_rows, radius, similarity, sets), "simhash-links")
    drop_written(tile_rows)
    if verify:
        remove(docs.sparkSession, sets)
    found = components(edges).withColumnRenamed("node", "_node")
    roots = found.join(distinct, F.col("_node") == F.col("node")).select("node", "root", "first")
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = roots.join(least, "root").select("node", "component_id")
    named = distinct.join(linked, "node", "left").select("node", F.coalesce("component_id", "first").alias("component_id"))
    named = written(named, "simhash-named")
    return rows.join(named, "node").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, groups: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that name their group; of rows that share that id, one of each text.

    ``groups``: doc_id and component_id. A row without an id can't be told apart and stays.
    """
    # The ids that go are fewer than those that stay; where their table is small, no text is shuffled.
    names = F.count_if(F.col("doc_id") == F.col("component_id"))
    odd = written(groups.where("doc_id IS NOT NULL").groupBy("doc_id").agg(names.alias("names")).where("names <> 1"), "simhash-gone")
    ids = lambda which: odd.where(which).select(F.col("doc_id").alias(key))
    kept = docs.join(ids("true"), key, "left_anti").select(*docs.columns)
    if not odd.where("names > 1").isEmpty():
        kept = kept.unionByName(docs.join(ids("names > 1"), key, "left_semi").select(*docs.columns).dropDuplicates([key, text]))
    return kept


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: fingerprints of all documents and the groups they link into."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
