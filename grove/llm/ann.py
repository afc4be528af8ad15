"""Operator 5, approximate nearest neighbours by balanced posting lists.

Fit: centroids come from a bounded sample (SAMPLE rows at most, by hash of vec_id), halved again and again at the largest
cluster, so that clusters stay balanced; a graph joins each centroid to its nearest ones, and to its neighbour in a chain,
so that every centroid can be reached. Both live in memory (MAX_LISTS centroids at most, a proven bound). The reach of the
search is fitted on the sample too: CALIBRATED of its rows are asked against all of it, and the reach is the least distance
ratio within which a share RECALL of their true neighbours has a list. Neighbours in a sample lie farther away than in the
whole table, so the recall there is more, not less.

Index: every vector is posted to its nearest centroid and, if it lies on a boundary, to up to REPLICAS - 1 further ones
whose distance is within BOUNDARY of the least. Lists that follow one another share a shelf of up to SHELF_ROWS rows; a
list that is larger has a shelf of its own, dealt to parts by hash of vec_id.

Search: a query walks the graph from its entries, always into centroids whose distance is within the reach of the best
found; those are its lists (pruned by that distance ratio), and as many more of the nearest as hold MIN_ROWS vectors. Queries
meet the shelves of their lists by key, QUERY_ROWS of them at a time (a shelf that more queries ask for is copied for each
further group of them), search those lists there, and each shelf gives its best k of every query; the best k of those are
ranked. Distances are computed from the original vectors in double precision.

Vectors that are null, zero, or hold null or non-finite components take no part; nor do those whose length isn't the most
common one. Rows without vec_id take no part. Where a vec_id repeats, its nearest row counts. A table with no more than k
candidates returns all of them. An empty table returns no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, cut, record_batch

SAMPLE = 131_072
MAX_LISTS = 16_384
LIST_TARGET = 64
SHELF_ROWS = 4096
QUERY_ROWS = 4096
REPLICAS = 2
BOUNDARY = 1.02
CALIBRATED = 512
RECALL = 0.95
MIN_ROWS = 400
DEGREE = 16


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


def balanced_centroids(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    clusters = [np.arange(len(sample))]
    while len(clusters) < lists:
        largest = max(range(len(clusters)), key=lambda k: len(clusters[k]))
        rows = clusters.pop(largest)
        if len(rows) < 2:
            clusters.append(rows)
            break
        own = sample[rows]
        ends = own[rng.choice(len(rows), 2, replace=False)]
        for _ in range(5):  # two means; the halves are made equal, so no cluster outgrows the others
            lean = (own - ends.mean(0)) @ (ends[1] - ends[0])
            order = np.argsort(lean, kind="stable")
            half = len(rows) // 2
            ends = np.array([own[order[:half]].mean(0), own[order[half:]].mean(0)])
        clusters += [rows[order[:half]], rows[order[half:]]]
    return np.unique(np.array([sample[rows].mean(0) for rows in clusters]), axis=0)


class CentroidGraph:
    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        n = len(centroids)
        near = np.concatenate([np.argsort(squared(centroids[k : k + 512], centroids), axis=1, kind="stable")[:, 1 : DEGREE + 1] for k in range(0, n, 512)])
        chain = np.stack([np.maximum(np.arange(n) - 1, 0), np.minimum(np.arange(n) + 1, n - 1)], axis=1)
        self.links = np.concatenate([near, chain], axis=1)
        self.entries = np.unique(np.linspace(0, n - 1, max(1, min(n, int(2 * n**0.5)))).astype(int))
        self.reach = 1.0

    def calibrate(self, sample: np.ndarray, k: int = 10) -> None:
        """Sets the reach from the sample's own neighbours."""
        asked = np.random.default_rng(11).choice(len(sample), min(CALIBRATED, len(sample)), replace=False)
        needed = []
        for at in range(0, len(asked), 32):
            some = asked[at : at + 32]
            far = squared(sample[some], sample)
            far[np.arange(len(some)), some] = np.inf
            near = np.argpartition(far, min(k, len(sample)) - 1, axis=1)[:, : min(k, len(sample) - 1)]
            to_lists = np.sqrt(squared(sample[some], self.centroids))
            best = to_lists.min(axis=1)
            for i, rows in enumerate(near):
                row, where = self.posts(sample[rows])
                least = np.full(len(rows), np.inf)
                np.minimum.at(least, row, to_lists[i][where])
                if best[i] > 0:
                    needed.append(least / best[i])
        if needed:
            self.reach = max(1.0, float(np.quantile(np.concatenate(needed), RECALL))) * (1 + 1e-9)

    def walk(self, vectors: np.ndarray, reach: float) -> np.ndarray:
        """Distances to the centroids that the walk has met, infinite for the others."""
        found = np.full((len(vectors), len(self.centroids)), np.inf)
        found[:, self.entries] = np.sqrt(squared(vectors, self.centroids[self.entries]))
        expanded = np.zeros(found.shape, bool)
        while True:
            todo = (found <= reach * found.min(axis=1, keepdims=True)) & ~expanded
            row, node = np.nonzero(todo)
            if not len(row):
                return found
            expanded |= todo
            met = np.zeros(found.shape, bool)
            met[row[:, None], self.links[node]] = True
            met &= np.isinf(found)
            nodes = np.flatnonzero(met.any(axis=0))  # of all rows together: one product of matrices
            if len(nodes):
                far = np.sqrt(squared(vectors, self.centroids[nodes]))
                found[:, nodes] = np.where(met[:, nodes], far, found[:, nodes])

    def posts(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of each vector's lists, its nearest first."""
        far = self.walk(vectors, max(BOUNDARY, 1.05))
        most = min(REPLICAS, far.shape[1])
        near = np.argpartition(far, most - 1, axis=1)[:, :most]
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1)
        at = np.take_along_axis(far, near, 1)
        keep = at <= BOUNDARY * at[:, :1]
        keep[:, 0] = True
        row, k = np.nonzero(keep)
        return row, near[row, k]

    def lists(self, vectors: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists each query searches."""
        far = self.walk(vectors, self.reach)
        best = far.min(axis=1, keepdims=True)
        keep = far <= self.reach * best
        short = np.flatnonzero((keep * sizes).sum(1) < least)
        if len(short):  # too few vectors there: the nearest lists that hold enough, of all lists
            every = squared(vectors[short], self.centroids)
            order = np.argsort(every, axis=1, kind="stable")
            enough = np.cumsum(sizes[order], axis=1) - sizes[order] < least
            for i, row in enumerate(short.tolist()):
                keep[row, order[i][enough[i]]] = True
        return np.nonzero(keep)


def shelves(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each list's shelf, and how many parts each shelf has."""
    shelf_of, parts, filled = np.zeros(len(sizes), np.int64), [1], 0
    for k, n in enumerate(sizes.tolist()):
        if filled and filled + n > SHELF_ROWS:
            parts.append(1)
            filled = 0
        shelf_of[k] = len(parts) - 1
        filled += n
        parts[-1] = max(1, -(-filled // SHELF_ROWS))
    return shelf_of, np.array(parts, np.int64)


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and v (array of float or double, as it was) of the rows that take part."""
    v = F.col(vector) if dict(rows.dtypes)[vector] == "array<float>" else F.col(vector).cast("array<double>")
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~bad & F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == F.lit(length[0]["n"] if length else 0))


def stacked(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def fit(rows: DataFrame, n: int) -> CentroidGraph:
    """From a sample by hash, of SAMPLE rows at most."""
    share = max(1, -(-n // (SAMPLE // 2)))
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(share)) == 0).limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    vectors = stacked(sample)
    if not len(vectors):
        vectors = stacked(rows.limit(1).select("v").toArrow()["v"].combine_chunks())
    vectors = vectors[np.lexsort(vectors.T[::-1])]  # whatever order the rows came in
    graph = CentroidGraph(balanced_centroids(vectors, int(min(MAX_LISTS, max(1, n // LIST_TARGET), len(vectors)))))
    graph.calibrate(vectors)
    return graph


NEAREST = "query_id long, vec_id long, score double"


def search(embeddings: DataFrame, is_query, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score for every row for which is_query (a Column over vec_id) holds."""
    rows = usable(embeddings, vec_id, vector)
    n = rows.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    graph = fit(rows, n)
    kind = dict(rows.dtypes)["v"]
    posted_ddl = f"list int, vec_id long, v {kind}"

    def post(parts):
        schema = batches(posted_ddl)
        for part in parts:
            for at in range(0, part.num_rows, 512):
                own = part.slice(at, 512)
                row, where = graph.posts(stacked(own.column(1)))
                yield record_batch(schema, [where.astype(np.int32), own.column(0).take(row), own.column(1).take(row)])

    posted = cut(rows.mapInArrow(post, posted_ddl))
    sizes = np.zeros(len(graph.centroids), np.int64)
    for r in posted.groupBy("list").count().collect():  # MAX_LISTS rows at most
        sizes[r["list"]] = r["count"]
    shelf_of, parts_of = shelves(sizes)
    least = MIN_ROWS * REPLICAS
    asked_ddl = f"shelf int, query_id long, lists array<int>, q {kind}"
    dealt = "shelf int, part int, crowd int, "

    def ask(parts):
        schema = batches(asked_ddl)
        for part in parts:
            for at in range(0, part.num_rows, 256):
                own = part.slice(at, 256)
                row, where = graph.lists(stacked(own.column(1)), sizes, least)
                key = row * len(parts_of) + shelf_of[where]  # rows and lists are in order, and shelves follow their lists
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
                wanted = np.split(where.astype(np.int32), first[1:]) if len(first) else []
                row, shelf = row[first], shelf_of[where[first]]
                yield record_batch(schema, [shelf.astype(np.int32), own.column(0).take(row), wanted, own.column(1).take(row)])

    asked = cut(rows.where(is_query).mapInArrow(ask, asked_ddl))
    crowds_of = np.ones(len(parts_of), np.int64)  # groups of queries by shelf
    for r in asked.groupBy("shelf").count().collect():  # a row for each shelf
        crowds_of[r["shelf"]] = -(-r["count"] // QUERY_ROWS)
    mixed = lambda ids: (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)

    def deal(own, copies, shelf, place):
        """The batch's rows, each as often as copies says; place(number of the copy, row) gives part and crowd."""
        import pyarrow as pa

        number = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        again = np.repeat(np.arange(len(copies)), copies)
        part, crowd = place(number, again)
        keys = [pa.array(x.astype(np.int32)) for x in (shelf[again], part, crowd)]
        return [*keys, *(c.take(pa.array(again)) for c in own)]

    def shelve(parts):
        schema = batches(dealt + posted_ddl)
        for part in parts:
            shelf, ids = shelf_of[part.column(0).to_numpy()], part.column(1).to_numpy()
            yield record_batch(schema, deal(part.columns, crowds_of[shelf], shelf, lambda number, again: (mixed(ids)[again] % parts_of[shelf][again], number)))  # noqa: B023

    def spread(parts):
        schema = batches(dealt + asked_ddl.removeprefix("shelf int, "))
        for part in parts:
            shelf, ids = part.column(0).to_numpy(), part.column(1).to_numpy()
            yield record_batch(schema, deal(part.columns[1:], parts_of[shelf], shelf, lambda number, again: (number, mixed(ids)[again] % crowds_of[shelf][again])))  # noqa: B023

    def meet(key, queries, vectors):
        import pyarrow as pa

        out: list = [[], [], []]
        if queries.num_rows and vectors.num_rows:
            vectors = vectors.sort_by([("list", "ascending"), ("vec_id", "ascending")])
            lists, ids = vectors["list"].to_numpy(), vectors["vec_id"].to_numpy()
            x = stacked(vectors["v"].combine_chunks())
            norms = (x * x).sum(1)
            for at in range(0, queries.num_rows, 64):
                some = queries.slice(at, 64)
                qid, q = some["query_id"].to_numpy(), stacked(some["q"].combine_chunks())
                asked_lists = some["lists"].to_pylist()
                for i in range(len(qid)):
                    ends = np.searchsorted(lists, asked_lists[i]), np.searchsorted(lists, asked_lists[i], "right")
                    rows = np.concatenate([np.arange(a, b) for a, b in zip(*ends, strict=True)])
                    rows = rows[ids[rows] != qid[i]]
                    if not len(rows):
                        continue
                    rough = norms[rows] - 2 * (x[rows] @ q[i])
                    by_id = np.argsort(ids[rows], kind="stable")  # a row may be there more than once: its nearest counts
                    own = ids[rows][by_id]
                    least_of = np.minimum.reduceat(rough[by_id], np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])))
                    most = np.partition(least_of, k - 1)[k - 1] if len(least_of) > k else np.inf
                    slack = 1e-9 * (1 + abs(most) + (q[i] * q[i]).sum()) if np.isfinite(most) else 0
                    near = rows[rough <= most + slack]
                    exact = np.sqrt(((x[near] - q[i]) ** 2).sum(1))
                    order = np.lexsort((ids[near], exact))
                    best = order[np.sort(np.unique(ids[near][order], return_index=True)[1])[:k]]
                    out[0].append(np.full(len(best), qid[i]))
                    out[1].append(ids[near][best])
                    out[2].append(exact[best])
        made = [np.concatenate(c) if c else [] for c in out]
        return pa.Table.from_batches([record_batch(batches(NEAREST), made)])

    asked = asked.mapInArrow(spread, dealt + asked_ddl.removeprefix("shelf int, ")).groupBy("shelf", "part", "crowd")
    vectors = posted.mapInArrow(shelve, dealt + posted_ddl).groupBy("shelf", "part", "crowd")
    near = asked.cogroup(vectors).applyInArrow(meet, NEAREST)
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))  # replicas
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
