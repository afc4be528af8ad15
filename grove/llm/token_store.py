"""Operator 9, token ids in binary shards with a minimal perfect hash index.

Format: two Parquet tables, written by Spark, so that lost executors and repeated tasks leave no half files. `shards` is in
ascending doc_id order; a shard's row holds

* payload: the ids of its documents one after the other, little-endian unsigned 32-bit, each document closed with END;
* index: a minimal perfect hash over its keys (levels of bit arrays; a key's slot is the rank of its bit);
* fingerprints, starts, lengths: by slot; 32 bits of another hash of the key, the first id in the payload and the count.

`directory` has a row for each shard: its first and last key, and the file it is in. A keyed read finds the one shard whose
keys enclose the key there (the bounds are pushed down to the directory's row groups), opens that file, of whose row groups
(one for about ROW_GROUP bytes) only the shard's is read, and asks the shard's perfect hash: neither depends on how many
documents the store holds, but for the directory's pruned scan.

A key is a doc_id and its occurrence (0 for the first row with that doc_id), so repeated rows are kept and found each.
Rows are dealt to ranges of doc_id whose bounds are quantiles of a sample by hash, sorted there, and cut into shards as they
stream past: memory holds one shard. Null texts are documents of the END id alone; null doc_ids come first. Very long texts
are encoded whole; a shard is closed after the text that fills it. An empty table gives no shards. Rows with equal doc_id are
in the order of their text, and so in one range. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, fresh_path, record_batch, slices
from .tokens import public, word_encoder

TOKENIZER = "word_bpe_49k.json"
END = 1
SHARD_IDS = 1 << 20
SHARD_DOCS = 4096
#: Ranges hold so many documents, until there are RANGES of them, which bounds the splits that go to driver and tasks.
RANGE_DOCS = 4096
RANGES = 65_536
#: doc_ids that are sampled for each range, about.
SAMPLED = 16
ROW_GROUP = 1 << 22


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser; a bijection for each seed."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


NULL = np.uint64(0x8000000000000001)


def keys_of(docs: list[int | None], occurrences: list[int]) -> np.ndarray:
    ids = np.array([int(NULL) if d is None else d % 2**64 for d in docs], np.uint64)
    return mix(ids, 1) ^ mix(np.array(occurrences, np.uint64), 2) if any(occurrences) else mix(ids, 1) ^ mix(np.zeros(len(ids), np.uint64), 2)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 77) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Level by level: keys whose bit no other key shares are placed, the others go on to the next level."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.ranks = [np.cumsum(x) - x for x in levels]

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        if len(np.unique(keys)) != len(keys):
            raise ValueError("keys must differ")
        levels, left = [], keys
        while len(left):
            size = 2 * len(left)
            at = (mix(left, 100 + len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 where no level has a bit for it (then it isn't there)."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = (mix(keys[todo], 100 + k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[todo[hit]] = self.before[k] + self.ranks[k][at[hit]]
            todo = todo[~hit]
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.levels), *(len(x) for x in self.levels)], "<u4").tobytes()
        return head + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def load(cls, raw: bytes) -> PerfectHash:
        n = int(np.frombuffer(raw, "<u4", 1)[0])
        at, levels = 4 * (n + 1), []
        for size in np.frombuffer(raw, "<u4", n, 4).tolist():
            packed = np.frombuffer(raw, np.uint8, -(-size // 8), at)
            levels.append(np.unpackbits(packed, count=size).astype(bool))
            at += len(packed)
        return cls(levels)


class Shard:
    """Keyed access to one shard's row."""

    def __init__(self, payload: bytes, index: bytes, prints: bytes, starts: bytes, lengths: bytes):
        self.payload, self.hash = payload, PerfectHash.load(index)
        self.prints, self.starts, self.lengths = (np.frombuffer(x, "<u4") for x in (prints, starts, lengths))

    def find(self, docs: list[int | None], occurrences: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each is there, its first id's place and its count."""
        keys = keys_of(docs, occurrences)
        slot = self.hash.slots(keys)
        there = slot >= 0
        there[there] = self.prints[slot[there]] == fingerprints(keys[there])
        at = np.where(there, slot, 0)
        return there, self.starts[at] if len(self.starts) else at, self.lengths[at] if len(self.lengths) else at

    def ids(self, doc: int | None, occurrence: int = 0) -> np.ndarray | None:
        there, start, length = self.find([doc], [occurrence])
        return np.frombuffer(self.payload, "<u4", int(length[0]), 4 * int(start[0])) if there[0] else None


SHARD = "range_id int, shard int, first_doc long, first_time int, last_doc long, last_time int, n_docs long, n_ids long, docs array<long>, occurrences array<int>, payload binary, index binary, fingerprints binary, starts binary, lengths binary"


def _shard_row(range_id: int, shard: int, docs: list, occurrences: list[int], parts: list[bytes]) -> tuple:
    lengths = np.array([len(p) // 4 for p in parts], np.int64)
    starts = np.cumsum(lengths) - lengths
    keys = keys_of(docs, occurrences)
    index = PerfectHash.of(keys)
    slot = index.slots(keys)
    by_slot = lambda x: (out := np.zeros(len(docs), "<u4"), out.__setitem__(slot, x))[0].tobytes()
    return range_id, shard, docs[0], occurrences[0], docs[-1], occurrences[-1], len(docs), int(lengths.sum()), docs, occurrences, b"".join(parts), index.dump(), by_slot(fingerprints(keys)), by_slot(starts), by_slot(lengths)


def write(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> None:
    """Writes the table of shards."""
    tokenizer = tokenizer or public(TOKENIZER)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n = rows.select("doc_id").count()
    ranges = int(min(RANGES, max(1, n // RANGE_DOCS)))
    splits = np.zeros(0, np.int64)
    if ranges > 1:
        share = max(1, n // (SAMPLED * ranges))
        sample = rows.select("doc_id").where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0))
        found = np.sort(sample.limit(4 * SAMPLED * ranges).toArrow()["doc_id"].to_numpy())
        if len(found):
            splits = np.unique(found[np.arange(1, ranges) * len(found) // ranges])
    spark = docs.sparkSession

    def search(parts):
        import pyarrow as pa

        for part in parts:
            known = part.column(0).is_valid().to_numpy(zero_copy_only=False)
            at = np.searchsorted(splits, part.column(0).fill_null(0).to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([pa.array(np.where(known, at, 0).astype(np.int32)), *part.columns], names=["range_id", "doc_id", "text"])

    def run(parts):
        schema, encode, end = batches(SHARD), word_encoder(tokenizer).encode, np.array([END], "<u4").tobytes()
        now, shard, last = None, 0, None
        ids: list = []
        times: list[int] = []
        payload: list[bytes] = []
        size = 0
        seen = 0
        for part in slices(parts):
            for range_id, doc, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), encode(part.column(2).to_pylist()), strict=True):
                if ids and (range_id != now or size >= SHARD_IDS or len(ids) >= SHARD_DOCS):
                    yield record_batch(schema, [[x] for x in _shard_row(now, shard, ids, times, payload)])
                    shard = shard + 1 if range_id == now else 0
                    ids, times, payload, size = [], [], [], 0
                seen = seen + 1 if (range_id, doc) == last else 0
                last, now = (range_id, doc), range_id
                ids.append(doc)
                times.append(seen)
                payload.append(own + end)
                size += len(payload[-1]) // 4
        if ids:
            yield record_batch(schema, [[x] for x in _shard_row(now, shard, ids, times, payload)])

    parts = max(1, min(len(splits) + 1, max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(splits) // 8)))
    ranged = rows.mapInArrow(search, "range_id int, doc_id long, text string") if len(splits) else rows.select(F.lit(0).alias("range_id"), "doc_id", "text")
    dealt = ranged.repartition(parts, "range_id").sortWithinPartitions("range_id", F.col("doc_id").asc_nulls_first(), "text").select("range_id", "doc_id", "text")
    writer = dealt.mapInArrow(run, SHARD).write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP)
    writer.option("parquet.block.size.row.check.min", 1).option("parquet.block.size.row.check.max", 1).parquet(f"{path}/shards")
    bounds = spark.read.parquet(f"{path}/shards").select("first_doc", "first_time", "last_doc", "last_time", "range_id", "shard", "n_ids", F.input_file_name().alias("file"))
    files = max(1, n // (SHARD_DOCS * 100_000))
    bounds.repartitionByRange(files, F.col("first_doc").asc_nulls_first()).sortWithinPartitions(F.col("first_doc").asc_nulls_first(), "first_time").write.parquet(f"{path}/directory")


DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read(spark, path: str) -> DataFrame:
    """DIGEST of every document, each looked up by its key in the written shards."""
    shards = spark.read.parquet(f"{path}/shards")
    sizes = spark.read.parquet(f"{path}/directory").select("range_id", "shard", "n_ids")
    totals = sizes.groupBy("range_id").agg(F.sum("n_ids").alias("n"))  # RANGES rows at most
    before = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("range_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_range"))
    within = Window.partitionBy("range_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("range_id", "shard", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("_shard")).join(F.broadcast(totals), "range_id")
    starts = starts.select("range_id", "shard", (F.col("_range") + F.col("_shard")).alias("first"))

    def run(parts):
        schema = batches("range_id int, shard int, doc_id long, place long, n_tokens long, ids_crc32 long")
        for part in slices(parts, 1):
            for range_id, number, docs, times, *raw in zip(*(part.column(k).to_pylist() for k in range(9)), strict=True):
                shard = Shard(*raw)
                there, place, length = shard.find(docs, times)
                if not there.all():
                    raise ValueError("a key that its shard's index doesn't know")
                view = memoryview(shard.payload)
                crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(place.tolist(), length.tolist(), strict=True)]
                yield record_batch(schema, [[range_id] * len(docs), [number] * len(docs), docs, place.astype(np.int64), length.astype(np.int64), crc])

    found = shards.select("range_id", "shard", "docs", "occurrences", "payload", "index", "fingerprints", "starts", "lengths").mapInArrow(run, "range_id int, shard int, doc_id long, place long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["range_id", "shard"]).select("doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def shard_of(spark, path: str, doc_id: int | None, occurrence: int = 0) -> DataFrame:
    """The row of the one shard whose keys enclose this key, from its file; no row where none does."""
    if doc_id is None:  # null keys come before all others
        starts, ends = F.col("first_doc").isNull() & (F.col("first_time") <= occurrence), F.col("last_doc").isNotNull() | (F.col("last_time") >= occurrence)
    else:
        starts = F.col("first_doc").isNull() | (F.col("first_doc") < doc_id) | ((F.col("first_doc") == doc_id) & (F.col("first_time") <= occurrence))
        ends = (F.col("last_doc") > doc_id) | ((F.col("last_doc") == doc_id) & (F.col("last_time") >= occurrence))
    at = spark.read.parquet(f"{path}/directory").where(starts & ends).select("file", "range_id", "shard").first()
    if at is None:
        return spark.createDataFrame([], spark.read.parquet(f"{path}/shards").schema)
    return spark.read.parquet(at["file"]).where((F.col("range_id") == at["range_id"]) & (F.col("shard") == at["shard"]))


def get(spark, path: str, doc_id: int | None, occurrence: int = 0):
    """One document's ids, or None."""
    row = shard_of(spark, path, doc_id, occurrence).select("payload", "index", "fingerprints", "starts", "lengths").first()
    return None if row is None else Shard(*map(bytes, row)).ids(doc_id, occurrence)


def op9_token_store(spark, sf_dir: str) -> DataFrame:
    from .common import table

    path = fresh_path(spark, "token-shards")
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path)
