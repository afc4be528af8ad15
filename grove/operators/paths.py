"""Bounded multi-source shortest paths over directed edges (src, dst, w >= 0).

Labels are (vertex, dist); a vertex that isn't reached has none. Every round expands the vertices whose label improved:
one equi-join with the edges, one aggregate that takes the least candidate and the old label together. The bound is put
before that aggregate. Rounds end when nothing improves.

The edges are dealt by src once; a round then moves the frontier and its candidates, never the edges. A vertex with very many
edges isn't dealt to one task: its edges stay spread, and the few labels of such vertices are broadcast to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.plans.storage import cut, dealt

#: Edges (24 bytes each) that one task may take, and that a vertex must have at least to be kept spread.
TASK_EDGES = 4_000_000
#: Share of all edges that a vertex must have to be kept spread: there are 1 / HOT_SHARE such vertices at most.
HOT_SHARE = 0.001
#: Rows that one task may put in order, and bins of the histograms that take its place beyond that.
TOP_ROWS, BINS = 100_000, 1024


def check_weights(edges: DataFrame) -> DataFrame:
    """The edges; a negative weight fails the job."""
    return edges.select("src", "dst", F.when(F.col("w") < 0, F.raise_error(F.lit("negative weight"))).otherwise(F.col("w")).cast("long").alias("w"))


def expand(frontier: DataFrame, edges: DataFrame, bound: int | None = None) -> DataFrame:
    """vertex and dist of every edge's end, below the bound."""
    out = frontier.join(edges, F.col("vertex") == F.col("src")).select(F.col("dst").alias("vertex"), (F.col("dist") + F.col("w")).alias("dist"))
    return out if bound is None else out.where(F.col("dist") < bound)


def relaxed(labels: DataFrame, candidates: DataFrame) -> DataFrame:
    """vertex, dist and improved, over labels and candidates together."""
    both = labels.select("vertex", F.col("dist").alias("old"), F.lit(None).cast("long").alias("new")).unionByName(
        candidates.select("vertex", F.lit(None).cast("long").alias("old"), F.col("dist").alias("new"))
    )
    least = both.groupBy("vertex").agg(F.min("old").alias("old"), F.min("new").alias("new"))
    improved = F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new") < F.col("old")))
    return least.select("vertex", F.least("old", "new").alias("dist"), improved.alias("improved"))


def _start(sources: DataFrame, bound: int | None) -> DataFrame:
    out = sources.groupBy("vertex").agg(F.min("dist").cast("long").alias("dist"))
    return out if bound is None else out.where(F.col("dist") < bound)


class Arcs:
    """The lightest edge of each (src, dst), stored in the order that rounds need."""

    def __init__(self, edges: DataFrame, task_edges: int = TASK_EDGES):
        self.least = cut(check_weights(edges).groupBy("src", "dst").agg(F.min("w").alias("w")))
        n, self.hot, rest = self.least.count(), None, self.least
        if n > task_edges:
            hot = cut(self.least.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") >= max(task_edges, n * HOT_SHARE)).select("src"))
            if hot.limit(1).count():
                self.hot, self.spread = F.broadcast(hot), cut(self.least.join(F.broadcast(hot), "src", "left_semi"))
                rest = self.least.join(self.hot, "src", "left_anti")
        self.rest = dealt(rest, "src", max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // task_edges))

    def expand(self, frontier: DataFrame, bound: int | None = None) -> DataFrame:
        found = expand(frontier, self.rest, bound)
        if self.hot is None:
            return found
        few = F.broadcast(frontier.join(self.hot, F.col("vertex") == F.col("src"), "left_semi"))
        return found.unionByName(expand(few, self.spread, bound))


def nth_distance(labels: DataFrame, n: int, top: int = TOP_ROWS) -> int | None:
    """The n-th smallest distance, null if there are fewer labels."""
    if n <= top:
        far = labels.orderBy("dist").limit(n).agg(F.max("dist").alias("d"), F.count("*").alias("n")).first()
        return far["d"] if far["n"] == n else None
    low, high, rows = labels.agg(F.min("dist"), F.max("dist"), F.count("*")).first()
    if rows < n:
        return None
    while low < high:  # the bin that holds it becomes the range
        width = (high - low) // BINS + 1
        bins = labels.where(F.col("dist").between(low, high)).groupBy(F.expr(f"(dist - {low}L) div {width}L").alias("bin")).count().orderBy("bin").collect()  # BINS rows at most
        for b in bins:
            if n <= b["count"]:
                low, high = low + b["bin"] * width, min(high, low + (b["bin"] + 1) * width - 1)
                break
            n -= b["count"]
    return low


def distances(edges: DataFrame, sources: DataFrame, bound: int | None = None, budget: int | None = None) -> DataFrame:
    """vertex and dist of all vertices nearer than the bound; with a budget, of those that can be among the budget + 1 nearest at least."""
    return _search(Arcs(edges), sources, bound, budget)


def _search(arcs: Arcs, sources: DataFrame, bound: int | None = None, budget: int | None = None) -> DataFrame:
    state = cut(_start(sources, bound).withColumn("improved", F.lit(True)))
    while state.where("improved").limit(1).count():
        if budget is not None:  # a vertex farther than budget + 1 others already are is neither among them nor on the way to them
            far = nth_distance(state, budget + 1)
            if far is not None:
                bound = far + 1 if bound is None else min(bound, far + 1)
        state = cut(relaxed(state, arcs.expand(state.where("improved"), bound)))
    return state.select("vertex", "dist")


def tight_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """src, dst and w of the edges with dist(src) + w = dist(dst), and both distances."""
    return _tight(edges.groupBy("src", "dst").agg(F.min("w").alias("w")), labels)


def _tight(least: DataFrame, labels: DataFrame) -> DataFrame:
    a = labels.select(F.col("vertex").alias("src"), F.col("dist").alias("d_src"))
    b = labels.select(F.col("vertex").alias("dst"), F.col("dist").alias("d_dst"))
    return least.join(a, "src").join(b, "dst").where("d_src + w = d_dst")


def predecessors(edges: DataFrame, labels: DataFrame, sources: DataFrame) -> DataFrame:
    """vertex, dist and pred: the smallest vertex before it on a shortest path (null at a source that nothing precedes).

    Over edges of weight 0 only a vertex with fewer edges from the sources precedes another, so that no circle can arise.
    """
    return _predecessors(edges.groupBy("src", "dst").agg(F.min("w").alias("w")), labels, sources)


def _predecessors(least: DataFrame, labels: DataFrame, sources: DataFrame) -> DataFrame:
    tight = cut(_tight(least, labels))
    zero = tight.where("w = 0").limit(1).count() > 0
    if zero:
        start = labels.join(sources.select("vertex", F.col("dist").alias("_d")), "vertex").where("dist = _d").select("vertex", F.lit(0).cast("long").alias("dist")).distinct()
        hops = distances(tight.select("src", "dst", F.lit(1).cast("long").alias("w")), start)
        tight = tight.join(hops.select(F.col("vertex").alias("src"), F.col("dist").alias("h_src")), "src").join(hops.select(F.col("vertex").alias("dst"), F.col("dist").alias("h_dst")), "dst")
        tight = tight.where("w > 0 or h_src < h_dst")
    pred = tight.groupBy(F.col("dst").alias("vertex")).agg(F.min("src").alias("pred"))
    return labels.join(pred, "vertex", "left")


def bounded(edges: DataFrame, sources: DataFrame, bound: int | None = None) -> DataFrame:
    """vertex, dist and pred of the vertices nearer than the bound."""
    arcs = Arcs(edges)
    return _predecessors(arcs.least, _search(arcs, sources, bound), _start(sources, bound))


def budgeted(edges: DataFrame, sources: DataFrame, budget: int, bound: int | None = None) -> tuple[int | None, DataFrame]:
    """(B', U): of the budget + 1 nearest by (dist, vertex), B' is the largest distance and U those strictly nearer; with fewer, the bound and all."""
    labels = cut(distances(edges, sources, bound, budget))
    far = nth_distance(labels, budget + 1)
    if far is None:
        return bound, labels
    return far, labels.where(F.col("dist") < far)


def base_case(edges: DataFrame, vertex: int, dist: int, k: int, bound: int | None = None) -> tuple[int | None, DataFrame]:
    """budgeted() from one vertex."""
    return budgeted(edges, edges.sparkSession.createDataFrame([(vertex, dist)], "vertex long, dist long"), k, bound)


def bmssp(edges: DataFrame, level: int, sources: DataFrame, k: int, t: int, bound: int | None = None) -> tuple[int | None, DataFrame]:
    """(B', U) for a level of the bounded problem: budgeted() with a budget of k * 2 ** (level * t)."""
    return budgeted(edges, sources, min(k * 2 ** min(level * t, 30), 2**31 - 2), bound)


def pivots(edges: DataFrame, sources: DataFrame, k: int, bound: int | None = None) -> DataFrame:
    """vertex, dist and is_pivot over W: what k rounds from the sources reach below the bound.

    If W outgrows k times the sources, all sources are pivots. Else a source is one if no tight edge within W leads to it
    and the tree of tight edges below it has k vertices or more.
    """
    arcs = Arcs(edges)
    start = cut(sources.groupBy("vertex").agg(F.min("dist").cast("long").alias("dist")))
    n = start.count()
    state = cut(start.withColumns({"improved": F.lit(True), "round": F.lit(0)}))
    for r in range(1, k + 1):
        near = relaxed(state, arcs.expand(state.where(F.col("round") == r - 1), bound))
        state = cut(near.join(state.select("vertex", "round"), "vertex", "left").withColumn("round", F.coalesce("round", F.lit(r))))
        if state.count() > k * n:
            own = start.select("vertex", F.lit(True).alias("is_pivot"))
            return state.join(own, "vertex", "left").select("vertex", "dist", F.coalesce("is_pivot", F.lit(False)).alias("is_pivot"))
        if not state.where(F.col("round") == r).limit(1).count():
            break
    rounds = state.select("vertex", "round")
    tight = _tight(arcs.least, state)
    tight = tight.join(rounds.withColumnsRenamed({"vertex": "src", "round": "r_src"}), "src").join(rounds.withColumnsRenamed({"vertex": "dst", "round": "r_dst"}), "dst")
    tight = tight.where("w > 0 or r_src < r_dst")
    parent = tight.groupBy(F.col("dst").alias("vertex")).agg(F.min("src").alias("parent"))
    tree = state.select("vertex").join(parent, "vertex", "left").select("vertex", F.coalesce("parent", "vertex").alias("parent"))
    sizes = tree_sizes(tree)
    chosen = start.select("vertex").join(sizes, "vertex").where(F.col("n") >= k).select("vertex", F.lit(True).alias("is_pivot"))
    return state.join(chosen, "vertex", "left").select("vertex", "dist", F.coalesce("is_pivot", F.lit(False)).alias("is_pivot"))


def tree_sizes(tree: DataFrame) -> DataFrame:
    """vertex and n of every root of a forest (vertex, parent; a root is its own parent): pointers double until all are at roots."""
    tree = cut(tree)
    while True:
        x, y = tree.alias("x"), tree.alias("y")
        doubled = x.join(y, F.col("x.parent") == F.col("y.vertex")).select(F.col("x.vertex").alias("vertex"), F.col("y.parent").alias("parent"), (F.col("x.parent") != F.col("y.parent")).alias("moved"))
        doubled = cut(doubled)
        tree = doubled.select("vertex", "parent")
        if not doubled.where("moved").limit(1).count():
            return tree.groupBy(F.col("parent").alias("vertex")).agg(F.count("*").alias("n"))


class PullQueue:
    """Keys with values, the least of each key, pulled in order of (value, key), size at a time."""

    def __init__(self, spark, size: int, bound: int):
        self.size, self.bound = size, bound
        self.rows = spark.createDataFrame([], "key long, value long")

    def insert(self, rows: DataFrame) -> None:
        self.rows = cut(self.rows.unionByName(rows.select("key", "value")).groupBy("key").agg(F.min("value").alias("value")))

    def batch_prepend(self, rows: DataFrame, low: int | None = None, high: int | None = None) -> None:
        """insert() of the rows whose value is in the half-open range from low to high."""
        if low is not None:
            rows = rows.where(F.col("value") >= low)
        if high is not None:
            rows = rows.where(F.col("value") < high)
        self.insert(rows)

    def empty(self) -> bool:
        return not self.rows.limit(1).count()

    def pull(self) -> tuple[int, DataFrame]:
        """The boundary (the least value that stays, else the bound) and the rows that are pulled."""
        out, rest = pulled(self.rows, self.size)
        out, self.rows = cut(out), cut(rest)
        least = self.rows.agg(F.min("value").alias("v")).first()["v"]
        return self.bound if least is None else least, out


def pulled(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The size least rows (key, value) by (value, key), and the rest."""
    out = rows.orderBy("value", "key").limit(size)
    return out, rows.join(out, "key", "left_anti")


def with_unreachable(labels: DataFrame, vertices: DataFrame) -> DataFrame:
    """vertex and dist of all vertices, -1 where there is no label."""
    return vertices.join(labels.select("vertex", "dist"), "vertex", "left").select("vertex", F.coalesce("dist", F.lit(-1)).alias("dist"))
