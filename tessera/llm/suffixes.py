"""Operator 6: removal of repeated byte strings by a suffix sort with a difference cover, to a depth of 50 bytes.

A string of ``LENGTH`` bytes (50) goes where it also starts in a document with a smaller doc_id. Equal strings are equal
beginnings of suffixes, so the suffixes are sorted to that depth and neighbours compared. As in difference-cover suffix
sorting, a sample of suffixes is sorted first: the places whose position in their document, modulo ``PERIOD`` (31), is in
a perfect difference set (6 of 31). Any two places have a common distance to sampled places of at most 30.

1. Discarding. Sampled tuples of ``TUPLE`` (20) bytes, cut to short hashes, meet in buckets; nothing repeated starts
   around a tuple that is sampled once in the corpus. The other sampled places go on, each with as many bytes to the left
   and right as strings around it reach (30 and 50 at most).
2. Sorting sampled tuples. What is left is dealt out by ranges of the tuple's bytes, sorted, and named by rank.
3. Recursion on names. Places whose names tie are ranked by the pair of their name and the name of the next tuple, until
   ranks reach the depth or none tie.
4. Merging. For each distance from 0 to 30, the suffixes that start so far before a sampled place are ordered by the bytes
   before it and the sampled rank. Neighbours with a common prefix of 50 bytes are equal strings, and all but those of the
   smallest doc_id are marked. Comparisons are of bytes, not of hashes.
5. The marks go back to the shards, which cut the bytes they cover.

Steps 2 to 5 run twice. The first round takes one residue of the cover alone, which finds the copies that lie at equal
distances from the starts of their documents. Strings that go by it are done: the one that stays speaks for them. The
second round takes all residues, over what is left, so that a text copied many times is sent once and not by every shard.

A shard sends equal surroundings once, for their smallest doc_id. Tuples that many shards hold (over ``CROWD``) would
gather in one range; their strings are dealt out by the hash of the whole string instead (96 bits), once for each shard.
Both ways give the same result.

A shard of n bytes takes some 30 n bytes of memory at its peak, and surroundings are made ``AT_ONCE`` at a time.

Null text is the empty text; a null doc_id counts as the largest; rows that share a doc_id don't count as earlier than
each other; shorter documents stay whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ragged, written
from .exchange import ANSWER, NO_ID, QUESTION, answer, answers, cuts, each_shard, flags_of, mixed, packed, read_shard, rolling, send, sent, splitters, stage, text_bytes, unpack
from .repeats import smaller_elsewhere

LENGTH, TUPLE, PERIOD = 50, 20, 31
#: A perfect difference set modulo 31: every difference occurs once.
COVER = (1, 5, 11, 24, 25, 27)
BASE, OTHER = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
CROWD = 512
BEFORE = PERIOD - 1
AROUND = BEFORE + LENGTH
#: Places whose bytes are compared, and surroundings that are made at once.
COPIED, AT_ONCE = 20_000, 200_000
#: Numbers of the first levels of both rounds of answers.
FIRST_ROUND, SECOND_ROUND = 5, 1 << 20
_NUMBERS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(OTHER))


def words_of(rows: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as columns of numbers that sort like them, the first column first."""
    n, width = rows.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = rows
    return list(wide.view(">u8").astype(np.uint64).T)


def names(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks of rows of numbers, equal for equal rows, the first column weighing most."""
    order = np.lexsort(columns[::-1])
    first = np.zeros(len(order), bool)
    for c in columns:
        first[1:] |= c[order[1:]] != c[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(first)
    return out


def ranks(rows: np.ndarray) -> np.ndarray:
    """Ranks of rows of bytes by tuples: names of the first tuples, then of pairs of names as long as some tie."""
    found = names(*words_of(rows[:, :TUPLE]))
    for k in range(TUPLE, rows.shape[1], TUPLE):
        if found.max(initial=-1) == len(found) - 1:
            break
        found = names(found, names(*words_of(rows[:, k : k + TUPLE])))
    return found


def common(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many leading bytes each row in ``order`` shares with the one before it."""
    out = np.zeros(len(order), np.int16)
    for k in range(1, len(order), COPIED):
        a, b = rows[order[k : k + COPIED]], rows[order[k - 1 : k - 1 + len(order[k : k + COPIED])]]
        other = a != b
        out[k : k + COPIED] = np.where(other.any(1), other.argmax(1), rows.shape[1])
    return out


def marks(around: np.ndarray, left: np.ndarray, right: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each surrounding a bit for each distance: the string there has a smaller doc_id among the surroundings."""
    out = np.zeros(len(owner), np.uint32)
    name = names(*words_of(around[:, BEFORE : BEFORE + TUPLE]))
    some = np.flatnonzero(np.bincount(name, minlength=1)[name] > 1)  # names of one entry have nothing to meet
    if not len(some):
        return out
    around, left, right, owner, name = around[some], left[some].astype(np.int64), right[some].astype(np.int64), owner[some], name[some]
    ahead = np.ascontiguousarray(around[:, BEFORE:])
    behind = np.ascontiguousarray(around[:, :BEFORE][:, ::-1])
    by_suffix = np.argsort(ranks(ahead), kind="stable")
    by_prefix = np.lexsort((*words_of(behind)[::-1], name))
    alike, before = common(ahead, by_suffix), common(behind, by_prefix)
    before[np.flatnonzero(np.diff(name[by_prefix])) + 1] = -1
    n = len(some)
    suffix_class, prefix_class = np.empty(n, np.uint64), np.empty(n, np.uint64)
    for j in range(PERIOD):  # the suffixes that start j bytes before the sampled places
        suffix_class[by_suffix] = np.cumsum(alike < LENGTH - j)
        prefix_class[by_prefix] = np.cumsum(before < j)
        there = np.flatnonzero((left >= j) & (right >= LENGTH - j))
        if len(there) < 2:
            continue
        place = prefix_class[there] * np.uint64(n + 1) + suffix_class[there]
        order = np.argsort(place)
        there, place = there[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        least = np.repeat(np.minimum.reduceat(owner[there], first), np.diff(np.append(first, len(there))))
        hit = there[owner[there] > least]
        out[some[hit]] |= np.uint32(1 << j)
    return out


class Shard:
    """The bytes of a shard in one row, and its sampled places."""

    def __init__(self, uris: list[str], mask: np.uint64):
        ids, rows, ends, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)], [np.zeros(1, np.int64)], 0
        for doc_ids, texts in read_shard(uris):
            raw, stops = text_bytes(texts)
            rows.append(raw)
            ids.append(doc_ids)
            ends.append(stops[1:] + at)
            at += len(raw)
        self.mask, self.ids, self.ends = mask, np.concatenate(ids), np.concatenate(ends)
        self.padded = np.concatenate([np.zeros(BEFORE, np.uint8), *rows, np.zeros(LENGTH, np.uint8)])
        self.raw = self.padded[BEFORE : len(self.padded) - LENGTH]
        self._sample()

    def _sample(self) -> None:
        """Sampled places, the distinct hashes of their tuples, and the number of each place's hash."""
        sizes = np.diff(self.ends)
        last = np.where(sizes >= LENGTH, sizes - TUPLE + 1, 0)  # places from which a tuple fits
        many = last // PERIOD * len(COVER) + np.searchsorted(COVER, last % PERIOD)
        nth = ragged(np.zeros(len(many), np.int64), many)
        self.place = np.repeat(self.ends[:-1], many) + nth // len(COVER) * PERIOD + np.array(COVER)[nth % len(COVER)]
        codes = np.concatenate([np.zeros(0, np.uint64), *(self._codes(self.place[k : k + AT_ONCE]) for k in range(0, len(self.place), AT_ONCE))])
        order = np.argsort(codes)
        codes = codes[order]
        first = np.ones(len(codes), bool)
        first[1:] = codes[1:] != codes[:-1]
        self.keys = codes[first]
        self.key_of = np.empty(len(order), np.int32)
        self.key_of[order] = np.cumsum(first) - 1
        self.repeated = np.diff(np.append(np.flatnonzero(first), len(codes))) > 1

    def _codes(self, at: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.zeros(0, np.uint64)
        x = np.lib.stride_tricks.sliding_window_view(self.raw, TUPLE)[at].view("<u4").astype(np.uint64)
        h = mixed(x[:, 0] | x[:, 1] << np.uint64(32))
        h = mixed(h + (x[:, 2] | x[:, 3] << np.uint64(32)) * np.uint64(BASE))
        return mixed(h ^ x[:, 4] * np.uint64(OTHER)) & self.mask

    def survive(self, answers: dict, buckets: int) -> None:
        """The sampled places whose tuples occur again, with the bytes on each side that strings around them reach."""
        live = (self.repeated | flags_of(self.keys, buckets, answers, 1))[self.key_of]
        self.crowded = flags_of(self.keys, buckets, answers, 2)[self.key_of[live]]
        self.code = self.keys[self.key_of[live]]
        self.at = self.place[live]
        doc = np.searchsorted(self.ends, self.at, side="right") - 1
        self.owner = self.ids[doc]
        self.aligned = (self.at - self.ends[doc]) % PERIOD == COVER[0]
        self.first = np.maximum(self.at - BEFORE, self.ends[doc])  # starts of the first and the last string around a place
        self.last = np.minimum(self.at, self.ends[doc + 1] - LENGTH)
        self.gone = np.zeros(len(self.raw) + 1, bool)  # starts of strings that go

    def narrow(self, answers: dict, cut: np.ndarray) -> None:
        """Takes the first round's answers; places keep the strings around them that may still stay."""
        self.take(answers, cut, FIRST_ROUND, np.flatnonzero(self.aligned & ~self.crowded))
        edges = np.flatnonzero(np.diff(self.gone.view(np.int8), prepend=0))
        begin, end = edges[::2], edges[1::2]
        if not len(begin):
            return
        k = np.searchsorted(begin, self.first, side="right") - 1
        self.first = np.where((k >= 0) & (self.first < end[k]), end[k], self.first)
        k = np.searchsorted(begin, self.last, side="right") - 1
        self.last = np.where((k >= 0) & (self.last < end[k]), begin[k] - 1, self.last)

    def reach(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes before and from the places that the strings around them reach."""
        return (self.at[which] - self.first[which]).astype(np.uint8), (self.last[which] + LENGTH - self.at[which]).astype(np.uint8)

    def around(self, which: np.ndarray) -> np.ndarray:
        """The bytes around places, zero beyond what their strings reach."""
        out = np.lib.stride_tricks.sliding_window_view(self.padded, AROUND)[self.at[which]]
        left, right = self.reach(which)
        short = np.flatnonzero((left < BEFORE) | (right < LENGTH))
        steps = np.arange(-BEFORE, LENGTH, dtype=np.int16)
        for k in range(0, len(short), COPIED):
            part = short[k : k + COPIED]
            out[part] *= (steps >= -left[part, None].astype(np.int16)) & (steps < right[part, None].astype(np.int16))
        return out

    def surroundings(self, which: np.ndarray, cut: np.ndarray) -> Iterator[Surroundings]:
        """Equal surroundings of some places together, ``AT_ONCE`` places at a time by their hashes."""
        which = which[self.first[which] <= self.last[which]]
        which = which[np.argsort(self.code[which], kind="stable")]
        code, k = self.code[which], 0
        while k < len(which):
            j = int(np.searchsorted(code, code[min(k + AT_ONCE, len(which)) - 1], side="right"))  # whole hashes
            yield Surroundings(self, which[k:j], cut)
            k = j

    def take(self, answers: dict, cut: np.ndarray, round_: int, which: np.ndarray) -> None:
        """Marks the strings around some places that go by a round's answers."""
        for level, s in enumerate(self.surroundings(which, cut), round_):
            found = np.zeros(len(s.lead), np.uint32)
            for b, lo, hi in s.ranges():
                if (data := answers.get((level, b))) is not None:
                    found[lo:hi] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint32)
            at, owner, (left, right) = self.at[s.which], self.owner[s.which], self.reach(s.which)
            larger, found = owner > s.owner[s.group], found[s.group]
            some = np.flatnonzero(larger | (found > 0))
            at, left, right, larger, found = at[some], left[some], right[some], larger[some], found[some]
            for j in range(PERIOD):
                self.gone[at[(left >= j) & (right >= LENGTH - j) & (larger | (found >> np.uint32(j) & 1).astype(bool))] - j] = True

    def crowds(self) -> None:
        """The full strings around crowded places, sorted by hash and doc_id."""
        which = np.flatnonzero(self.crowded & (self.first <= self.last))
        starts, owners, keys, more = ([np.zeros(0, t)] for t in (np.int64, np.int64, np.uint64, np.uint32))
        for k in range(0, len(which), COPIED):
            part = which[k : k + COPIED]
            x, c = _NUMBERS[self.around(part)], np.arange(PERIOD)
            left, right = self.reach(part)
            e, c = np.nonzero((left[:, None] >= BEFORE - c) & (right[:, None] >= LENGTH - (BEFORE - c)))
            start, one = np.unique(self.at[part][e] - BEFORE + c, return_index=True)  # a string may lie around several places
            e, c = e[one], c[one]
            starts.append(start)
            owners.append(self.owner[part][e])
            keys.append(mixed(rolling(x, LENGTH, BASE)[e, c]))
            more.append((mixed(rolling(x, LENGTH, OTHER)[e, c]) >> np.uint64(32)).astype(np.uint32))
        start, one = np.unique(np.concatenate(starts), return_index=True)
        owner, key, extra = (np.concatenate(x)[one] for x in (owners, keys, more))
        order = np.lexsort((owner, extra, key))
        self.w_start, self.w_owner, self.w_key, self.w_more = start[order], owner[order], key[order], extra[order]
        self.w_first = np.ones(len(order), bool)
        self.w_first[1:] = (self.w_key[1:] != self.w_key[:-1]) | (self.w_more[1:] != self.w_more[:-1])
        self.w_group = np.cumsum(self.w_first) - 1

    def covered(self, answers: dict, buckets: int, cut: np.ndarray) -> np.ndarray:
        """Which bytes go."""
        self.survive(answers, buckets)
        self.narrow(answers, cut)
        self.take(answers, cut, SECOND_ROUND, np.flatnonzero(~self.crowded))
        self.crowds()
        if len(self.w_key):
            w = flags_of(self.w_key[self.w_first], buckets, answers, 4)[self.w_group] | (self.w_owner > self.w_owner[self.w_first][self.w_group])
            self.gone[self.w_start[w]] = True
        starts = np.flatnonzero(self.gone)
        step = np.zeros(len(self.raw) + 1, np.int8)
        if len(starts):
            apart = np.flatnonzero(np.diff(starts) > LENGTH)
            step[starts[np.concatenate([[0], apart + 1])]] += 1
            step[starts[np.concatenate([apart, [len(starts) - 1]])] + LENGTH] -= 1
        return np.cumsum(step[:-1], dtype=np.int8) > 0


class Surroundings:
    """Some places of a shard by range and surroundings: equal ones that meet are a group, with their smallest doc_id.

    Places are ordered by range, the first bytes of the tuple, and a hash of the surroundings. Where a chance meeting
    parts equal ones they are two groups, which costs a row and changes nothing.
    """

    def __init__(self, shard: Shard, which: np.ndarray, cut: np.ndarray):
        around, (left, right) = shard.around(which), shard.reach(which)
        words = np.column_stack([around, left, right, np.zeros((len(which), -(AROUND + 2) % 8), np.uint8)]).view(np.uint64)
        whole = np.zeros(len(which), np.uint64)
        for k in range(words.shape[1]):
            whole = mixed(whole * np.uint64(BASE) + words[:, k])
        tuples = np.ascontiguousarray(around[:, BEFORE : BEFORE + TUPLE])
        range_ = np.searchsorted(cut, tuples.view(f"S{TUPLE}").reshape(-1), side="right")
        order = np.argsort((tuples[:, :8].copy().view(">u8").reshape(-1).astype(np.uint64) & np.uint64((1 << 64) - (1 << 24))) | whole >> np.uint64(40))
        order = order[np.argsort(range_[order].astype(np.uint16 if len(cut) < 1 << 16 else np.int64), kind="stable")]
        self.which, words = which[order], words[order]
        first = np.ones(len(order), bool)
        first[1:] = (words[1:] != words[:-1]).any(1)
        self.group, self.lead = np.cumsum(first) - 1, order[first]
        self.owner = np.minimum.reduceat(shard.owner[self.which], np.flatnonzero(first))
        self.left, self.right, self.bytes, self.range = left[self.lead], right[self.lead], around[self.lead], range_[self.lead]

    def ranges(self) -> Iterator[tuple[int, int, int]]:
        """(range, from, to) over the groups."""
        edges = [0, *(np.flatnonzero(np.diff(self.range)) + 1).tolist(), len(self.range)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            yield int(self.range[lo]), lo, hi


def remove_shared(docs: DataFrame, *, key: str = "doc_id", text: str = "text", crowd: int = CROWD, **sizes: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every document."""
    spark = docs.sparkSession
    staged = stage(docs, key=key, text=text, **sizes)
    buckets, mask = staged.buckets, staged.mask
    shared_cut = spark.sparkContext.broadcast(splitters(staged, buckets))  # TUPLE bytes for each bucket

    def tuples(shard, uris, _):
        return send(shard, Shard(uris, mask).keys, buckets)

    def tuple_answers(key, table):
        table, bucket = table.sort_by("shard"), key[0].as_py()
        found = np.concatenate([unpack(d, n)[0] for d, n in zip(table.column("data").to_pylist(), table.column("n").to_pylist(), strict=True)])
        _, back, counts = np.unique(found, return_inverse=True, return_counts=True)
        shards, sizes = table.column("shard").to_pylist(), table.column("n").to_pylist()
        return pa.concat_tables([answer(level, bucket, shards, sizes, counts[back] > least) for level, least in ((1, 1), (2, crowd))])

    def questions(shard, level, s):
        """A level is a slice of a round; its number stands where keys stand elsewhere."""
        level_of = np.full(len(s.lead), level, np.uint64)
        return sent(shard, ((b, packed(level_of[lo:hi], s.left[lo:hi], s.right[lo:hi], s.bytes[lo:hi], s.owner[lo:hi]), hi - lo) for b, lo, hi in s.ranges()))

    def first_round(shard, uris, got):
        s = Shard(uris, mask)
        s.survive(got, buckets)
        for level, x in enumerate(s.surroundings(np.flatnonzero(s.aligned & ~s.crowded), shared_cut.value), FIRST_ROUND):
            yield from questions(shard, level, x)

    def second_round(shard, uris, got):
        s = Shard(uris, mask)
        s.survive(got, buckets)
        s.narrow(got, shared_cut.value)
        for level, x in enumerate(s.surroundings(np.flatnonzero(~s.crowded), shared_cut.value), SECOND_ROUND):
            yield from questions(shard, level, x)
        s.crowds()
        yield from send(shard, s.w_key[s.w_first], buckets, s.w_more[s.w_first], s.w_owner[s.w_first], first=buckets)

    def string_answers(key, table):
        bucket = key[0].as_py()
        if bucket >= buckets:
            table = table.sort_by("shard")
            return answer(4, bucket - buckets, table.column("shard").to_pylist(), table.column("n").to_pylist(), smaller_elsewhere(table))
        rows = [unpack(d, n, np.uint8, np.uint8, (np.uint8, AROUND), np.int64) for d, n in zip(table.column("data").to_pylist(), table.column("n").to_pylist(), strict=True)]
        level, left, right, around, owner = (np.concatenate(c) for c in zip(*rows, strict=True))
        found, at, out = marks(around, left, right, owner), 0, []
        for shard, n in zip(table.column("shard").to_pylist(), table.column("n").to_pylist(), strict=True):
            out.append(answers(int(level[at]), bucket, [shard], [n], found[at : at + n], lambda x: zstandard.ZstdCompressor().compress(x.tobytes())))
            at += n
        return pa.concat_tables(out)

    def finish(shard, uris, got):
        s = Shard(uris, mask)
        gone, k = s.covered(got, buckets, shared_cut.value), 0
        for doc_ids, _ in read_shard(uris):
            rows = []
            for d in range(k, k + len(doc_ids)):
                lo, hi = int(s.ends[d]), int(s.ends[d + 1])
                lost = gone[lo:hi]
                removed = int(np.count_nonzero(lost))
                spans = int(lost[0]) + int(np.count_nonzero(lost[1:] & ~lost[:-1])) if removed else 0
                kept = s.raw[lo:hi][~lost] if removed else s.raw[lo:hi]
                rows.append((None if s.ids[d] == NO_ID else int(s.ids[d]), hi - lo, removed, spans, kept.tobytes()))
            k += len(doc_ids)
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    found = written(each_shard(staged, tuples, QUESTION).groupBy("bucket").applyInArrow(tuple_answers, ANSWER), "suffixes-1")
    for k, ask in enumerate((first_round, second_round), 2):
        found = found.union(written(each_shard(staged, ask, QUESTION, found).groupBy("bucket").applyInArrow(string_answers, ANSWER), f"suffixes-{k}"))
    return each_shard(staged, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: removes strings of 50 bytes that also start in a document with a smaller doc_id."""
    out = remove_shared(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], length: int = LENGTH) -> dict[int, tuple[int, int, int, bytes]]:
    """The same by looking at every string, for tests."""
    docs = {d: (t or "").encode() for d, t in rows}
    seen: dict[bytes, int] = {}
    for d in sorted(docs):
        for i in range(len(docs[d]) - length + 1):
            seen.setdefault(docs[d][i : i + length], d)
    out = {}
    for d, b in docs.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out
