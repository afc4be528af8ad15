"""Operator 10, SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 bit positions gets a nonzero vector of RADIUS + 1 bits; each nonzero vector v of RADIUS + 1 bits is a mask
of the positions whose inner product with v is 1. Positions in which two fingerprints differ span RADIUS dimensions at
most, so some v is orthogonal to all of them: under that mask the two are equal. Every pair within RADIUS thus collides in
some of the 2^(RADIUS+1) - 1 tables, and a collision is only a candidate: the bits decide.

Equal fingerprints are one node from the start, so copies, however many, cost one row. A table's groups stream past in
order; groups of up to GROUP fingerprints are compared as bit matrices, and give a forest of their links instead of all
pairs. Larger groups are dealt anew, under a further family of masks, until they are small; no pair is lost, as each
family covers every pair. Groups of over HOT_GROUP of a family's rows are known from counts beforehand and go on to the next
family where they are, so that no task meets them whole. Links join into components in rounds over tables; nothing of them comes to the driver.

Null and empty texts have the fingerprint zero. Repeated rows get a row each, of one component. Rows without doc_id take
part in linking and never name a component unless no other can (then component_id is null). Very long texts count whole.
An empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.operators.components import connected_components

from .common import batches, cut, record_batch, slices, utf8

WIDTH = 3
RADIUS = 3
SEED = 42
GROUP = 1024
HOT_SHARE = 0.001
#: Share of a family's rows from which a group isn't sent to one task, not even as a stream; at most 1 / HOT_GROUP groups are such.
HOT_GROUP = 0.0001
#: Bins of the first count; what shares none with a large group needs no count of its own.
BINS = 65_536
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Unsigned; shingles are space-joined words of the text with A-Z in lower case."""
    import xxhash

    words = utf8(text).translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends - 1)[width - 1 :].tolist(), strict=False)], "<u8")
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        some = hashes[at : at + 65_536]
        count += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, hashed: bool = False) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row; if asked for, h and g, two hashes of the text."""
    out = "doc_id long, fp long" + (", h long, g long" if hashed else "")

    def run(parts):
        schema = batches(out)
        for part in slices(parts):
            fps = np.array([fingerprint(t, width) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
            yield record_batch(schema, [part.column(0), fps, *part.columns[2:]])

    own = _hashes(F.col(text)) if hashed else []
    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string"), *own).mapInArrow(run, out)


def _hashes(text) -> list:
    """Null and empty texts differ in h; 128 bits together."""
    known = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(text.isNull(), known).alias("h"), F.xxhash64(F.lit(1), known).alias("g")]


def covering_masks(radius: int = RADIUS, bits: int = 64, family: int = 0) -> list[int]:
    """2^(radius+1) - 1 masks; whichever radius positions differ, one mask holds none of them."""
    size = 1 << (radius + 1)
    vectors = [1 + k % (size - 1) for k in range(bits)]
    np.random.default_rng([family, radius, bits]).shuffle(vectors)
    return [sum(1 << i for i, x in enumerate(vectors) if bin(x & v).count("1") % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the components of links among these fingerprints: each but the smallest of a component to another of it."""
    n = len(fps)
    link = np.empty((n, n), bool)
    for at in range(0, n, 128):
        link[at : at + 128] = np.bitwise_count(fps[at : at + 128, None] ^ fps[None]) <= radius
    label = np.arange(n, dtype=np.int32)
    while True:
        new = np.where(link, label[None], np.int32(n)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return fps[moved], fps[label[moved]]


def _links(keyed: DataFrame, radius: int, group: int) -> DataFrame:
    """From (a, key, fp) rows: (u, v, null) for links, and (null, null, fp, a, key) for the rows of groups that are too large."""
    out = "u long, v long, fp long, a long, key long"

    def run(parts):
        schema = batches(out)
        held: list = []  # arrays of fps of the group that is still open
        size, big, now = 0, False, None

        def rest(a, key, fps):
            n = len(fps)
            none = [None] * n
            return record_batch(schema, [none, none, fps, np.full(n, a), np.full(n, key)])

        def close():
            if size > 1 and not big:
                u, v = forest(np.concatenate(held).view(np.uint64), radius)
                if len(u):
                    none = [None] * len(u)
                    yield record_batch(schema, [u.view(np.int64), v.view(np.int64), none, none, none])

        for part in parts:
            a, key, fp = (part.column(k).to_numpy() for k in range(3))
            n = len(a)
            if not n:
                continue
            start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (key[1:] != key[:-1])]))
            ends = np.append(start[1:], n)
            few = (ends - start == 1) & (ends < n) & (start > 0)  # whole groups of one: nothing to link
            for s, e in zip(start[~few].tolist(), ends[~few].tolist(), strict=True):
                if now != (a[s], key[s]):
                    yield from close()
                    held, size, big, now = [], 0, False, (a[s], key[s])
                size += e - s
                if big:
                    yield rest(*now, fp[s:e])
                    continue
                held.append(fp[s:e].copy())
                if size > group:
                    yield rest(*now, np.concatenate(held))
                    held, big = [], True
        yield from close()

    dealt = keyed.repartition("a", "key").sortWithinPartitions("a", "key").select("a", "key", "fp")
    return dealt.mapInArrow(run, out)


def _hot_groups(rows: DataFrame, least: int) -> DataFrame:
    """(a, key) of the groups of over least rows (stored): bins first, whose counts combine before the exchange, then the groups in full bins."""
    count = F.count("*").alias("n")
    binned = rows.select("a", "key", F.pmod(F.xxhash64("a", "key"), F.lit(BINS)).alias("bin"))
    full = binned.groupBy("bin").agg(count).where(F.col("n") > least).select("bin")
    groups = binned.join(F.broadcast(full), "bin").groupBy("a", "key").agg(count)
    return cut(groups.where(F.col("n") > least).select("a", "key"), 1)


def links(distinct: DataFrame, radius: int = RADIUS, group: int = GROUP, hot: float = HOT_GROUP) -> DataFrame:
    """(u, v) between distinct fingerprints (column fp), whose components are those of all pairs within the radius.

    What no further family divides differs in radius positions or few more, so group must be above 2 ** (radius + 1).
    """
    if group < 2 ** (radius + 1):
        raise ValueError("groups of fingerprints that no mask tells apart would never be small enough")
    keyed, found, family = distinct.select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("key"), "fp"), None, 0
    size = distinct.count()
    while True:
        masks = covering_masks(radius, family=family)
        table = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("masked")) for k, m in enumerate(masks)]))
        keyed = keyed.select("a", "key", "fp", table.alias("x"))
        # the first family's key is the masked bits themselves; further ones add to the group they divide
        key = F.col("x.masked") if family == 0 else F.xxhash64("a", "key", "x.t", "x.masked")
        keyed, on = keyed.select(F.col("x.t").alias("a"), key.alias("key"), "fp"), None
        least = max(group, int(size * len(masks) * hot))
        if size > least:  # no group has more rows than there are fingerprints
            large = _hot_groups(keyed, least)
            if large.count():
                on = cut(keyed.join(F.broadcast(large), ["a", "key"]))  # at most 1 / hot rows
                keyed = keyed.join(F.broadcast(large), ["a", "key"], "left_anti")
        # few of the rows give any; an exchange of those is cheaper than a file from every task of the comparison
        files = max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
        made = cut(_links(keyed, radius, group).repartition(files))
        own = made.where("fp is null").select("u", "v")
        found = own if found is None else found.unionByName(own)
        keyed = made.where("fp is not null").select("a", "key", "fp")
        if on is not None:
            keyed = keyed.unionByName(on.select("a", "key", "fp"))
        size = keyed.count()
        if not size:
            break
        family += 1
    return found


def components(fps: DataFrame, radius: int = RADIUS, rooted: bool = False) -> DataFrame:
    """fps and component_id (and root, the component's own fingerprint, if asked for) of every row of fps, which is read more than once and should be a stored table.

    A fingerprint of more than HOT_SHARE of all rows doesn't send its rows to one task: there are 1 / HOT_SHARE such
    fingerprints at most, so their names are broadcast. The names of components are stored before they are joined, so that
    a component of very many fingerprints is a skewed key of plain exchanges, which adaptive execution can split.
    """
    n = fps.count()
    groups = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), n)
    joined = connected_components(links(groups.select("fp"), radius), stored=True).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    roots = groups.join(joined, "fp", "left").select("fp", "rep", "rows", F.coalesce("root", "fp").alias("root"))
    least = cut(roots.groupBy("root").agg(F.min("rep").alias("component_id")), n)
    names = ["component_id", "root"] if rooted else ["component_id"]
    named = cut(roots.join(least, "root").select("fp", "rows", *names), n)
    hot = F.broadcast(named.where(F.col("rows") > n * HOT_SHARE).drop("rows"))
    rest = fps.join(hot.select("fp"), "fp", "left_anti").join(named.drop("rows"), "fp")
    return fps.join(hot, "fp").unionByName(rest).select(*fps.columns, *names)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    found = components(cut(fingerprints(docs, doc_id, text, width)), radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, with its columns: of the rows of the least doc_id (rows without doc_id only where no other is in the component) the one of the least text."""
    names, inner = docs.columns, docs.toDF(*[f"_c{k}" for k in range(len(docs.columns))])  # whatever the columns are called
    doc_id, text = (F.col(f"_c{names.index(c)}") for c in ("doc_id", "text"))
    h, g = _hashes(text)
    found = components(cut(fingerprints(inner.select(doc_id.alias("doc_id"), text.alias("text")), hashed=True)), rooted=True)
    own = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "h", "g", "root").agg(F.count("*").alias("n"))
    own = cut(own.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("g").alias("_g"), F.col("root").alias("_root"), F.col("n").alias("_n")))
    several = own.groupBy("_root").agg(F.sum("_n").alias("_n")).where("_n > 1").select("_root")

    def rows(kept: DataFrame) -> DataFrame:
        return inner.join(kept.drop("_n"), doc_id.cast("long").eqNullSafe(F.col("_id")) & (h == F.col("_h")) & (g == F.col("_g")))

    # rows that are the only ones of their component with its name go out as they are; only the others are moved to be compared
    alone, compared = rows(own.join(several, "_root", "left_anti")), rows(own.join(several, "_root", "left_semi"))
    whole = F.struct(text, *[F.col(c) for c in inner.columns if c != f"_c{names.index('text')}"])
    kinds = inner.select(whole.alias("x")).schema["x"].dataType.simpleString()
    if "map<" in kinds or "variant" in kinds:  # kinds without an order are compared as JSON
        least = F.min_by(whole, F.struct(text, F.to_json(whole)))
    else:
        least = F.min(whole)
    one = compared.groupBy("_root").agg(least.alias("_row"))
    return alone.select(*inner.columns).union(one.select(*[f"_row.{c}" for c in inner.columns])).toDF(*names)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"))
