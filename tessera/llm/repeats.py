"""Operator 5: removal of repeated passages of words, by level-wise doubling.

A window is ``window`` consecutive words of one document (20). Level 1 looks at windows of a quarter of that: every long
window is stood for by the one of its short windows with the smallest hash (equal long windows pick it at the same
place), so a sixth or so of all places are looked at and none is lost. Long windows whose stand-in occurs nowhere else
are done. Level 2 doubles: it looks at the window of half the length that holds the stand-in. Level 3 doubles again, to
the full windows of what is left, with 96-bit hashes, and finds for each the smallest doc_id that holds it.

A word goes if a window over it also starts earlier: in a smaller doc_id, or earlier in the same document. Null text has
no words; a null doc_id counts as the largest; rows that share a doc_id are judged as separate documents, neither of
which is earlier; documents shorter than a window stay whole; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exchange import NO_ID, QUESTION, asked, each_shard, flags_of, leftmost_least, mixed, read_shard, rolling, send, shared_keys, stage, text_bytes, unpack, word_hashes

WINDOW = 20
BASE, OTHER = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class Shard:
    """Word hashes of a shard in one row, and the windows of each level."""

    def __init__(self, uris: list[str], window: int, mask: np.uint64):
        ids, rows, ends, at = [], [], [np.zeros(1, np.int64)], 0
        for doc_ids, texts in read_shard(uris):
            raw, stops = text_bytes(texts)
            hashes, stops = word_hashes(raw, stops)
            rows.append(hashes)
            ids.append(doc_ids)
            ends.append(stops[1:] + at)
            at += len(hashes)
        self.window, self.mask = window, mask
        self.ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        self.ends = np.concatenate(ends)  # document k has the words ends[k] to ends[k + 1]
        self.words = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
        sizes = np.diff(self.ends)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)  # of each word
        n = len(self.words) - window + 1
        self.starts = np.flatnonzero(np.repeat(self.ends[1:], sizes)[: max(n, 0)] >= np.arange(max(n, 0)) + window)  # of windows inside a document

    def level1(self) -> None:
        """The stand-in of each long window, and the distinct keys of the stand-ins."""
        short = max(self.window // 4, 1)
        if not len(self.starts):
            self.anchor = np.zeros(0, np.int64)
            self.keys1, self.own1 = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            self.repeated1 = np.zeros(0, bool)
            return
        v = mixed(rolling(self.words, short, BASE)) & self.mask
        self.anchor = leftmost_least(v, self.window - short + 1)[self.starts]
        places = np.flatnonzero(np.bincount(self.anchor, minlength=len(v)))
        self.keys1, back, counts = np.unique(v[places], return_inverse=True, return_counts=True)
        self.repeated1 = counts > 1
        self.own1 = np.zeros(len(v), np.int64)  # key number by place
        self.own1[places] = back

    def level2(self, answers: dict, buckets: int) -> None:
        """Narrows the windows to those whose stand-in occurs again, and takes the half windows over the stand-ins."""
        self.level1()
        half, short = max(self.window // 2, 1), max(self.window // 4, 1)
        if len(self.starts):
            live = (self.repeated1 | flags_of(self.keys1, buckets, answers, 1))[self.own1[self.anchor]]
            self.starts, self.anchor = self.starts[live], self.anchor[live]
        if not len(self.starts):
            self.keys2, self.repeated2, self.own2 = np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64)
            return
        g = rolling(self.words, half, BASE)
        ahead = self.anchor - self.starts <= self.window - half  # the half window starts with the stand-in, or ends with it
        place = np.where(ahead, self.anchor, self.anchor + short - half)
        places = np.unique(place)
        self.keys2, back, counts = np.unique(mixed(g[places]) & self.mask, return_inverse=True, return_counts=True)
        self.repeated2 = counts > 1
        self.own2 = back[np.searchsorted(places, place)]

    def level3(self, answers: dict, buckets: int) -> None:
        """Narrows again, and sorts the full windows: by hash, doc_id, document and start."""
        self.level2(answers, buckets)
        if len(self.starts):
            live = (self.repeated2 | flags_of(self.keys2, buckets, answers, 2))[self.own2]
            self.starts = self.starts[live]
        at = self.starts
        if not len(at):
            self.key, self.more = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
            self.owner, self.first, self.group = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
            return
        key = mixed(rolling(self.words, self.window, BASE)[at])
        more = (mixed(rolling(self.words, self.window, OTHER)[at]) >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((at, self.ids[self.doc[at]], more, key))
        self.starts, self.key, self.more = at[order], key[order], more[order]
        self.owner = self.ids[self.doc[self.starts]]
        self.first = np.ones(len(order), bool)
        self.first[1:] = (self.key[1:] != self.key[:-1]) | (self.more[1:] != self.more[:-1])
        self.group = np.cumsum(self.first) - 1

    def covered(self, answers: dict, buckets: int) -> np.ndarray:
        """Which words go."""
        self.level3(answers, buckets)
        n = len(self.words)
        if not len(self.starts):
            return np.zeros(n, bool)
        earlier = flags_of(self.key[self.first], buckets, answers, 3)[self.group]  # another shard has a smaller doc_id
        earlier |= self.owner > self.owner[self.first][self.group]
        d = self.doc[self.starts]
        again = np.zeros(len(d), bool)  # the same document has it earlier: it follows in the sorted order
        again[1:] = ~self.first[1:] & (d[1:] == d[:-1])
        gone = self.starts[earlier | again]
        depth = np.bincount(gone, minlength=n + 1) - np.bincount(gone + self.window, minlength=n + 1)[: n + 1]
        return np.cumsum(depth)[:n] > 0


def smaller_elsewhere(table: pa.Table) -> np.ndarray:
    """Whether another entry of the bucket has the same window and a smaller doc_id."""
    cols = [unpack(d, n, np.uint32, np.int64) for d, n in zip(table.column("data").to_pylist(), table.column("n").to_pylist(), strict=True)]
    key, more, owner = (np.concatenate(c) for c in zip(*cols, strict=True))
    order = np.lexsort((owner, more, key))
    k, m, o = key[order], more[order], owner[order]
    first = np.ones(len(k), bool)
    first[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
    least = o[first][np.cumsum(first) - 1]
    out = np.zeros(len(k), bool)
    out[order] = o > least
    return out


RESULT = "doc_id long, n_words long, n_removed long, kept string"


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the remaining words, one space apart) of every document."""
    if window < 4:
        raise ValueError("a window has four words at least")
    staged = stage(docs, key=key, text=text)
    buckets, mask = staged.buckets, staged.mask

    def ask1(shard, uris, answers):
        s = Shard(uris, window, mask)
        s.level1()
        return send(shard, s.keys1, buckets)

    def ask2(shard, uris, answers):
        s = Shard(uris, window, mask)
        s.level2(answers, buckets)
        return send(shard, s.keys2, buckets)

    def ask3(shard, uris, answers):
        s = Shard(uris, window, mask)
        s.level3(answers, buckets)
        return send(shard, s.key[s.first], buckets, s.more[s.first], s.owner[s.first])

    def finish(shard, uris, answers):
        s = Shard(uris, window, mask)
        gone = s.covered(answers, buckets)
        k = 0
        for doc_ids, texts in read_shard(uris):
            rows = []
            for doc_id, value in zip(doc_ids.tolist(), texts, strict=True):
                words = value.as_buffer().to_pybytes().split()
                lost = gone[s.ends[k] : s.ends[k + 1]]
                removed = int(lost.sum())
                if removed:
                    words = [words[i] for i in np.flatnonzero(~lost).tolist()]
                rows.append((None if doc_id == NO_ID else doc_id, len(lost), removed, b" ".join(words).decode()))
                k += 1
            a, b, c, d = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    found = asked(each_shard(staged, ask1, QUESTION), 1, shared_keys, "repeats-1")
    found = found.union(asked(each_shard(staged, ask2, QUESTION, found), 2, shared_keys, "repeats-2"))
    found = found.union(asked(each_shard(staged, ask3, QUESTION, found), 3, smaller_elsewhere, "repeats-3"))
    return each_shard(staged, finish, RESULT, found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: removes passages of 20 words that start earlier too, from all documents."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """The same by comparing every window with all before it, for tests."""
    seen: dict[tuple, tuple] = {}
    docs = {d: (t or "").encode().split() for d, t in rows}
    for d in sorted(docs):
        for i in range(len(docs[d]) - window + 1):
            seen.setdefault(tuple(docs[d][i : i + window]), (d, i))
    out = {}
    for d, w in docs.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] < (d, i):
                gone.update(range(i, i + window))
        out[d] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    return out


