"""Operator 6, shortest-pack-first packing over the length histogram.

1. Every document is encoded and closed with END; it is cut into pieces of CONTEXT ids and a rest (each id in one piece).
2. The pieces' length histogram (CONTEXT rows at most) goes to the driver. Lengths are placed longest first, each copy into
   the pack with the smallest total that still has room, whole groups of packs at a time; what comes out are packing patterns
   with counts.
3. Each pattern takes a range of ranks of each of its lengths; pieces find their sequence and offset by length and rank.
   Ranks within one length come from counts of (length, bucket of doc_id), so that one common length isn't ranked in one task.

Null and empty texts are documents of the END id alone. Repeated rows are packed each. Very long texts are encoded whole, a
few rows at a time, and give as many pieces as they need. Ties: pieces of one length are ranked by bucket, doc_id, start and
checksum; pieces that agree in all of these are interchangeable. An empty table gives no pieces. Columns other than doc_id
and text are not read. A null doc_id is carried as null.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, cut, record_batch, slices
from .tokens import public, rank_encoder

TOKENIZER = "byte_bpe_50k.json"
CONTEXT = 2048
END = 1
#: Rows of one length that are ranked together, about.
RANKED_ROWS = 500

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", context: int = CONTEXT, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """PIECE of every piece, and its ids as little-endian unsigned 32-bit bytes if asked for."""
    path = path or public(TOKENIZER)
    out = PIECE + (", ids binary" if with_ids else "")

    def run(parts):
        schema, encode, end = batches(out), rank_encoder(path).encode, np.array([END], "<u4").tobytes()
        for part in slices(parts):
            columns: list[list] = [[] for _ in schema]
            for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, context):
                    own = ids[4 * start : 4 * (start + context)]
                    for column, value in zip(columns, (doc, start, len(own) // 4, zlib.crc32(own), n, own), strict=False):
                        column.append(value)
            yield record_batch(schema, columns)

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, out)


def shortest_pack_first(histogram: dict[int, int], context: int = CONTEXT) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((length, copies), ...) in order of placing, and how many packs follow each.

    Copy by copy, longest first, each would go into the shortest pack that has room, or else into a new one. All packs of the
    shortest total take a copy each before any takes a second, so a whole group of packs moves on at once.
    """
    by_total: dict[int, dict[tuple, int]] = {}

    def add(total: int, pattern: tuple, packs: int):
        group = by_total.setdefault(total, {})
        group[pattern] = group.get(pattern, 0) + packs

    def taking(pattern: tuple, length: int, copies: int) -> tuple:
        if pattern and pattern[-1][0] == length:
            return (*pattern[:-1], (length, pattern[-1][1] + copies))
        return (*pattern, (length, copies))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= context:
            raise ValueError(f"a piece of {length} doesn't fit {context}")
        while left:
            totals = sorted(t for t in by_total if t + length <= context)[:2]
            if not totals:  # new packs: a copy more goes into the newest, the one pack with room, as long as it fits
                each = context // length
                for copies, packs in ((each, left // each), (left % each, 1)):
                    if copies and packs:
                        add(copies * length, ((length, copies),), packs)
                break
            total = totals[0]
            group = by_total.pop(total)
            # copies that each pack takes until it isn't the shortest any more, or has no room
            copies = min(-(-(totals[1] - total) // length) if len(totals) > 1 else context, (context - total) // length)
            packs = sum(group.values())
            copies = min(copies, max(1, left // packs))
            for pattern, n in group.items():
                used = min(n, left // copies)
                if used:
                    add(total + copies * length, taking(pattern, length, copies), used)
                    left -= used * copies
                if n > used:
                    add(total, pattern, n - used)
    return [(pattern, packs) for total in sorted(by_total, reverse=True) for pattern, packs in sorted(by_total[total].items())]


def slots(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, np.ndarray]:
    """For each length: rows of (first rank, first sequence, offset), by first rank; a rank's sequence is as far from the first as the rank is."""
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, packs in patterns:
        offset = 0
        for length, copies in pattern:
            for _ in range(copies):
                found[length].append((used[length], sequence, offset))
                used[length] += packs
                offset += length
        sequence += packs
    return {length: np.array(rows, np.int64).T.copy() for length, rows in found.items()}


def place(cut_pieces: DataFrame, context: int = CONTEXT) -> DataFrame:
    """The pieces with sequence_id and offset. cut_pieces is read twice, so it should be a stored table."""
    length = F.col("length")
    histogram = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # context rows at most
    at = slots(shortest_pack_first(histogram, context))
    buckets = int(min(4096, max(1, max(histogram.values(), default=0) // RANKED_ROWS)))
    bucketed = cut_pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    counts = bucketed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy(F.col("doc_id").asc_nulls_first(), "start", "ids_crc32")
    ranked = bucketed.withColumn("_row", F.row_number().over(within)).join(counts, ["length", "_bucket"])
    columns = list(cut_pieces.columns)
    ddl = ", ".join([f"`{c}` {cut_pieces.schema[c].dataType.simpleString()}" for c in columns] + ["sequence_id long", "offset long"])

    def run(parts):
        import pyarrow as pa

        for part in parts:
            lengths, ranks = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for value in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == value)
                first, base, where = at[value]
                slot = np.searchsorted(first, ranks[rows], "right") - 1
                sequence[rows], offset[rows] = base[slot] + ranks[rows] - first[slot], where[slot]
            yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    return ranked.select(length, (F.col("_before") + F.col("_row") - 1).alias("_rank"), *[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(columns)]).mapInArrow(run, ddl)


def pack(docs: DataFrame, context: int = CONTEXT, path: str | None = None) -> DataFrame:
    """PIECE, sequence_id and offset of every piece."""
    return place(cut(pieces(docs, context=context, path=path)), context)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id and its ids, from place() over pieces(with_ids=True)."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    return placed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"))


def op6_packing(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return pack(table(spark, sf_dir, "documents"))
