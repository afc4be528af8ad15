"""Operator 8, byte-level BPE encoding and decoding in length-bucketed padded numpy matrices.

Pre-tokens (the matches of the pattern) that a worker hasn't met yet are put into matrices of byte ids, one for each range
of lengths, padded with -1. Each round every row looks its adjacent pairs up in a hash table of pairs (open addressing, in
numpy), merges its leftmost pair of least rank and closes the gap; rows without a pair drop out. Rows of over LONG bytes
would cost the square of their length that way; the same merges are found for them with a heap. A pre-token that is
itself in the vocabulary is one id, as in tiktoken.

Null texts are empty texts: no ids. Repeated rows are encoded each; there are no ties, as equal ranks are merged leftmost
first. An empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, record_batch, slices
from .tokens import public

RANKS = "byte_bpe_multi_50k.tiktoken"
LONG = 512
CACHE_ENTRIES = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class PairTable:
    """Hash table from a pair of ids to the id of their joined bytes, which is its rank too."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64)
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, np.uint64(2**64 - 1)), np.full(1 << bits, -1, np.int32)
        todo, values, at = keys, np.array(merged, np.int32), self.slot(keys)
        self.probes = 0
        while len(todo):
            free = self.keys[at] == np.uint64(2**64 - 1)
            first = np.zeros(len(at), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.ranks[at[put]] = todo[put], values[put]
            todo, values, at = todo[~put], values[~put], (at[~put] + 1) & self.mask
            self.probes += 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks; -1 where a pair isn't in the table."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = self.slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.ranks[at], -1)
        todo = np.flatnonzero((there != keys) & (there != np.uint64(2**64 - 1)))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            there = self.keys[at[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (there != np.uint64(2**64 - 1))]
        return out


NONE = np.int32(2**31 - 1)


class Bpe:
    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = read_ranks(path)
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([k])] for k in range(256)], np.int32)
        self.pairs = PairTable(self.ranks)
        self.find = regex.compile(pattern).findall
        self.cache: dict[str, tuple[int, str, bytes]] = {}

    def merge_matrix(self, rows: list[bytes]) -> list[list[int]]:
        """Ids of pre-tokens of about the same length."""
        width = max(map(len, rows))
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        ids = np.full((len(rows), width), -1, np.int32)
        inside = np.arange(width) < lengths[:, None]
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(rows), np.uint8)]
        rank = np.full((len(rows), width), NONE, np.int32)  # of the pair that starts here
        both = inside[:, 1:]
        found = self.pairs.look_up(ids[:, :-1][both], ids[:, 1:][both])
        rank[:, :-1][both] = np.where(found < 0, NONE, found)
        out: list = [None] * len(rows)
        which = np.arange(len(rows))
        columns = np.arange(width)
        while len(which):
            at = rank.argmin(axis=1)  # the first of the least: leftmost
            line = np.arange(len(which))
            least = rank[line, at]
            over = least == NONE
            if over.any():
                for i in np.flatnonzero(over).tolist():
                    out[which[i]] = ids[i, : lengths[i]].tolist()
                stay = ~over
                which, ids, rank, lengths, at, least = which[stay], ids[stay], rank[stay], lengths[stay], at[stay], least[stay]
                if not len(which):
                    break
                width = int(lengths.max())  # compaction: no column beyond the longest row
                ids, rank, columns = ids[:, :width], rank[:, :width], columns[:width]
                line = np.arange(len(which))
            ids[line, at] = least
            lengths = lengths - 1
            after = columns[:-1] > at[:, None]
            np.copyto(ids[:, :-1], ids[:, 1:].copy(), where=after)
            np.copyto(rank[:, :-1], rank[:, 1:].copy(), where=after)
            ids[line, lengths], rank[line, lengths] = -1, NONE
            for where, valid in ((at, at + 1 < lengths), (at - 1, at > 0)):  # the two pairs that the new id is in
                i, k = line[valid], where[valid]
                found = self.pairs.look_up(ids[i, k], ids[i, k + 1])
                rank[i, k] = np.where(found < 0, NONE, found)
            ended = at + 1 >= lengths
            rank[line[ended], at[ended]] = NONE
        return out

    def merge_long(self, raw: bytes) -> list[int]:
        """The same merges in the same order, by a heap of (rank, place)."""
        ids = [int(self.byte_ids[b]) for b in raw]
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        joined = lambda i: self.ranks.get(self.bytes_of[ids[i]] + self.bytes_of[ids[after[i]]]) if after[i] < n else None
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := joined(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            if not alive[i] or ids[i] != a or after[i] >= n or ids[after[i]] != b:
                continue
            gone = after[i]
            ids[i], alive[gone], after[i] = r, False, after[gone]
            if after[i] < n:
                before[after[i]] = i
            for k in (i, before[i]):
                if k >= 0 and (r := joined(k)) is not None:
                    heapq.heappush(heap, (r, k, ids[k], ids[after[k]]))
        return [x for x, ok in zip(ids, alive, strict=True) if ok]

    def pieces(self, raws: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(raws)
        buckets: dict[int, list[int]] = {}
        for i, raw in enumerate(raws):
            if (own := self.ranks.get(raw)) is not None:
                out[i] = [own]
            elif len(raw) > LONG:
                out[i] = self.merge_long(raw)
            else:
                buckets.setdefault(len(raw) if len(raw) <= 16 else 16 * (1 << (len(raw) // 16).bit_length()), []).append(i)
        for width, rows in buckets.items():
            most = max(16, 400_000 // width)
            for at in range(0, len(rows), most):
                some = rows[at : at + most]
                for i, ids in zip(some, self.merge_matrix([raws[i] for i in some]), strict=True):
                    out[i] = ids
        return out

    def learn(self, words: set[str]) -> None:
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        new = [w for w in words if w not in self.cache]
        bytes_of = self.bytes_of
        for w, ids in zip(new, self.pieces([w.encode("utf-8", "replace") for w in new]), strict=True):
            self.cache[w] = len(ids), ",".join(map(str, ids)), b"".join([bytes_of[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        words = self.find(text)
        self.learn(set(words))
        return [int(i) for w in words for i in self.cache[w][1].split(",")]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def digests(self, texts: list[str | None]):
        """n_tokens, the ids in decimal, the decoded bytes of each text; a group of texts at a time."""
        group: list[list[str]] = []
        size = 0
        for k, text in enumerate(texts):
            group.append(self.find(text or ""))
            size += len(group[-1])
            if size > 150_000 or k == len(texts) - 1:
                self.learn(set().union(*group))
                get = self.cache.__getitem__
                for words in group:
                    got = list(map(get, words))
                    yield sum([g[0] for g in got]), ",".join([g[1] for g in got]), b"".join([g[2] for g in got])
                group, size = [], 0


_ENCODERS: dict[tuple[str, str], Bpe] = {}


def bpe(path: str | None = None, pattern: str | None = None) -> Bpe:
    """One for each worker process."""
    import public_tokenizers

    key = path or public(RANKS), pattern or public_tokenizers.PATTERN
    if key not in _ENCODERS:
        _ENCODERS[key] = Bpe(*key)
    return _ENCODERS[key]


def encoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of every row."""
    out = "doc_id long, ids array<int>"

    def run(parts):
        schema, own = batches(out), bpe(path)
        for part in slices(parts):
            yield record_batch(schema, [part.column(0), [own.encode(t or "") for t in part.column(1).to_pylist()]])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, out)


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    from .common import table

    def run(parts):
        schema, own = batches(DIGEST), bpe()
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for part in slices(parts):
            rows = [(n, sha(ids.encode()), sha(raw)) for n, ids, raw in own.digests(part.column(1).to_pylist())]
            yield record_batch(schema, [part.column(0), *(zip(*rows, strict=True) if rows else ([], [], []))])

    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, DIGEST)
