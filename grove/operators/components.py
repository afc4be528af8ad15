"""Connected components of an undirected edge table, by alternating large-star and small-star rounds.

Every round is one aggregate and one equi-join over the edges; no vertex's neighbours are gathered into one row. A vertex
with very many edges is a skewed key: the aggregate combines it before the exchange, and beyond HUB_EDGES edges its result is
stored before the join, so that both sides of the join are plain exchanges, which adaptive execution can split. Rounds are stored in the shared checkpoint folder, so lineage
stays short and a lost executor costs one round at most. Before the first round each partition of the edges is replaced by
a spanning forest of itself, which keeps the components and shortens all paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.plans.storage import cut


#: Edges (16 bytes each) up to which one task may meet all edges of one vertex.
HUB_EDGES = 1_000_000


def forest_of_partitions(edges: DataFrame) -> DataFrame:
    """Edges (u, v) to edges (vertex, smallest vertex of its part), partition by partition."""

    def run(parts):
        import pyarrow as pa

        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent[p]
                x = parent[x]
            return x

        def flush():
            rows = [(x, find(x)) for x in parent]
            rows = [r for r in rows if r[0] != r[1]]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for part in parts:
            for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > 2_000_000:  # bounded memory; a forest of each run of edges serves as well
                yield flush()
        yield flush()

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(run, "u long, v long")


def _hung(pairs: DataFrame, most: int) -> DataFrame:
    """pairs and m, the least of u and its neighbours; pairs has most rows at most."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    if most > HUB_EDGES:
        least = cut(least)
    return pairs.join(least.select("u", F.least("u", "m").alias("m")), "u")


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", reduce_first: bool = True, stored: bool = False) -> DataFrame:
    """node and component (the smallest node that it reaches) of every node of an edge; nulls are dropped, self-loops are nodes.

    stored says that edges are a stored table, cheap to count first; a small one is then kept in few files.
    """
    pairs = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u is not null and v is not null")
    loops = pairs.where("u = v").select("u")
    now = (forest_of_partitions(pairs.where("u <> v")) if reduce_first else pairs.where("u <> v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = cut(now, pairs.count() if stored else None), None
    if not reduce_first or loops.limit(1).count():
        nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    else:
        nodes = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        if state[0] == 0:
            break
        both = now.union(now.select("v", "u"))
        large = _hung(both, 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _hung(large, 2 * state[0])
        small = small.select("v", "m").union(small.select("u", "m").distinct()).toDF("u", "v").where("u <> v").distinct()
        now = cut(small, 2 * state[0])
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    found = stars.unionByName(roots)
    if nodes is not None:
        found = nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return found
