"""Minimum spanning forests.

* hooked(): what components become when each joins the one its cheapest edge leads to (find and union over tables).
* boruvka_round(), boruvka_rounds(): one round; rounds until no component has an outgoing edge, with a trace.
* superstep_forest(): edges activated in order of rank in P steps, up to t rounds and one contraction a step, then rounds
  to the end: never on a fixed count, so the forest is complete.
* minimum_spanning_forest(): the plain way to the forest. Every partition first drops the edges that aren't in its own
  forest (no edge of the whole forest is lost by that); what is left is finished in one task if it is small, else by
  rounds until it is. All ways choose the same edges, as the order is total.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.operators.edges import activation_steps, cheapest_outgoing, contract, drop_internal, lightest_per_pair, ranked, relabel, selected
from grove.plans.storage import cut

#: Edges (40 bytes each) that one task may finish.
FINISH_EDGES = 4_000_000
#: Components whose joining one task may work out.
HOOK_ROWS = 500_000


def parameters(n: int) -> tuple[int, int]:
    """t = ceil(log2(n) ** (2/3)) rounds a step and P = ceil(log2(n) / t) steps, at least 1 of each."""
    if n < 2:
        return 1, 1
    log = math.log2(n)
    t = max(1, math.ceil(log ** (2 / 3))) if n > 4 else 1
    return t, max(1, math.ceil(log / t))


def hooked_in_one_task(cheapest: DataFrame) -> DataFrame:
    """hooked() for a table of few rows; the root is the smallest component."""

    def run(parts):
        import pyarrow as pa

        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        for part in parts:
            for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
        rows = [(x, find(x)) for x in list(parent)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["vertex", "comp"])

    return cheapest.select("comp", "other").coalesce(1).mapInArrow(run, "vertex long, comp long")


def hooked(cheapest: DataFrame) -> DataFrame:
    """vertex and comp for every component in cheapest_outgoing(): the root it hangs from once all chosen edges are joined.

    Two components that chose one edge are the only cycles; the smaller is the root. Then pointers are doubled until none moves.
    """
    a, b = cheapest.alias("a"), cheapest.alias("b")
    mutual = F.col("b.other") == F.col("a.comp")
    parents = a.join(b, F.col("a.other") == F.col("b.comp")).select(
        F.col("a.comp").alias("vertex"), F.when(mutual & (F.col("a.comp") < F.col("a.other")), F.col("a.comp")).otherwise(F.col("a.other")).alias("comp")
    )
    while True:
        parents = cut(parents)
        x, y = parents.alias("x"), parents.alias("y")
        doubled = x.join(y, F.col("x.comp") == F.col("y.vertex")).select(F.col("x.vertex").alias("vertex"), F.col("y.comp").alias("comp"), (F.col("x.comp") != F.col("y.comp")).alias("moved"))
        doubled = cut(doubled)
        if not doubled.where("moved").limit(1).count():
            return doubled.select("vertex", "comp")
        parents = doubled.select("vertex", "comp")


def boruvka_round(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round over edges (cu, cv, rank): the ranks that are chosen, and the components' new names (vertex, comp)."""
    cheapest = cut(cheapest_outgoing(edges))
    small = cheapest.limit(HOOK_ROWS + 1).count() <= HOOK_ROWS
    return selected(cheapest), cut(hooked_in_one_task(cheapest)) if small else hooked(cheapest)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _composed(components: DataFrame | None, names: DataFrame) -> DataFrame:
    """Vertices' components after components were renamed once more."""
    if components is None:
        return names
    moved = components.join(names.select(F.col("vertex").alias("_old"), F.col("comp").alias("_new")), F.col("comp") == F.col("_old"), "left")
    moved = moved.select("vertex", F.coalesce("_new", "comp").alias("comp"))
    return moved.unionByName(names.join(components.select("vertex"), "vertex", "left_anti"))


class Rounds:
    """Edges over components that shrink round by round; by tables, until finish edges or fewer are left for one task."""

    def __init__(self, edges: DataFrame, n: int, finish: int = FINISH_EDGES):
        self.edges, self.components, self.live, self.chosen, self.trace, self.finish = edges, None, n, [], [], finish

    def _record(self, chosen: DataFrame, names: DataFrame, taken: list[int]) -> None:
        """Keeps the chosen ranks, the components' new names and how many edges each of these rounds took."""
        self.chosen.append(chosen)
        parts = int(self.edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.components = cut(_composed(self.components, names).coalesce(parts))  # unions would double the partitions
        for n in taken:
            self.trace.append((len(self.trace), self.live, self.live - n))
            self.live -= n

    def advance(self, most: int | None = None) -> bool:
        """Up to most rounds, all without it; False if no component had an outgoing edge."""
        done = 0
        while self.live > 1 and (most is None or done < most):
            if self.edges.limit(self.finish + 1).count() <= self.finish:
                return self._in_one_task(None if most is None else most - done) or done > 0
            if not self.round():
                break
            done += 1
        return done > 0

    def _in_one_task(self, most: int | None) -> bool:
        made = cut(rounds_in_one_task(self.edges, most))
        counts = made.where("kind = 0").groupBy("a").agg(F.count("*").alias("n")).orderBy("a").collect()  # a row for each round
        if not counts:
            return False
        self._record(made.where("kind = 0").select(F.col("b").alias("rank")), made.where("kind = 1").select(F.col("a").alias("vertex"), F.col("b").alias("comp")), [r["n"] for r in counts])
        self.edges = made.where("kind = 2").select(F.col("a").alias("cu"), F.col("b").alias("cv"), F.col("c").alias("rank"))
        return True

    def round(self) -> bool:
        """One round; False if no component has an outgoing edge."""
        chosen, names = boruvka_round(self.edges)
        chosen = cut(chosen)
        taken = chosen.count()
        if not taken:
            return False
        renamed = relabel(self.edges.select(F.col("cu").alias("u"), F.col("cv").alias("v"), "rank"), names)
        self._record(chosen, names, [taken])
        self.edges = cut(lightest_per_pair(renamed))
        return True

    def ranks(self, spark) -> DataFrame:
        return _union(self.chosen) if self.chosen else spark.createDataFrame([], "rank long")


def boruvka_rounds(ranks: DataFrame, n: int, finish: int = FINISH_EDGES) -> Rounds:
    """All rounds over ranked edges (u, v, rank)."""
    state = Rounds(cut(lightest_per_pair(ranks.select(F.col("u").alias("cu"), F.col("v").alias("cv"), "rank"))), n, finish)
    state.advance()
    return state


TRACE = "round int, c_before long, c_after long, xi double, is_final boolean"
STEPS = "step int, c_before long, c_after long, m_i long, t int, xi double, is_final boolean"


def round_trace(ranks: DataFrame, n: int) -> DataFrame:
    """TRACE, a row for each round; the round that completes the forest is the final one."""
    trace = boruvka_rounds(ranks, n).trace
    rows = [(k, a, b, a / b, k == len(trace) - 1) for k, a, b in trace]
    return ranks.sparkSession.createDataFrame(rows, TRACE)


def shrinkage(trace: DataFrame) -> DataFrame:
    """xi_geomean over all rows of a trace, and xi_reference without the final one: geometric means of xi over 1, else 1."""
    over = lambda c: F.coalesce(F.exp(F.avg(F.when(c, F.log("xi")))), F.lit(1.0))
    return trace.agg(F.count("*").alias("n_rows"), over(F.col("xi") > 1).alias("xi_geomean"), over((F.col("xi") > 1) & ~F.col("is_final")).alias("xi_reference"))


def superstep_forest(ranks: DataFrame, n: int, m: int | None = None, t: int | None = None, steps: int | None = None, finish: int = FINISH_EDGES) -> tuple[DataFrame, list[tuple]]:
    """The forest's ranks, and a row of STEPS for each step (rounds after the last step are further rows, with t = 0)."""
    spark = ranks.sparkSession
    own_t, own_steps = parameters(n)
    t, steps = t or own_t, steps or own_steps
    ranks = cut(ranks.select("u", "v", "rank"))
    m = ranks.count() if m is None else m
    stepped = activation_steps(ranks, m, steps)
    state = Rounds(spark.createDataFrame([], "cu long, cv long, rank long"), n, finish)
    rows: list[list] = []
    for step in range(steps):
        if state.live <= 1:
            break
        before = state.live
        new = stepped.where(F.col("step") == step).select("u", "v", "rank")
        new = relabel(new, state.components) if state.components is not None else new.withColumns({"cu": F.col("u"), "cv": F.col("v")})
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        state.edges = cut(state.edges.unionByName(drop_internal(new).select("cu", "cv", "rank")).coalesce(parts))
        carried = state.edges.count()
        state.advance(t)
        rows.append([step, before, state.live, carried, t, before / state.live, False])
    while state.live > 1:  # what t rounds of the last step left
        before, carried = state.live, state.edges.count()
        if not carried or not state.advance(1):
            break
        rows.append([len(rows), before, state.live, carried, 0, before / state.live, False])
    if rows:
        rows[-1][-1] = True
    return state.ranks(spark), [tuple(r) for r in rows]


def step_trace(ranks: DataFrame, n: int) -> DataFrame:
    return ranks.sparkSession.createDataFrame(superstep_forest(ranks, n)[1], STEPS)


def step_summary(ranks: DataFrame, n: int, m: int) -> DataFrame:
    """One row: n, m, P, t, steps_actual, xi_geomean, xi_theory (2 ** t), C_trace, M_trace."""
    t, steps = parameters(n)
    rows = [r for r in superstep_forest(ranks, n, m)[1]]
    xs = [math.log(r[5]) for r in rows if r[5] > 1 and not r[6]]
    mean = math.exp(sum(xs) / len(xs)) if xs else 1.0
    made = (n, m, steps, t, len(rows), mean, 2.0**t, [r[1] for r in rows], [r[3] for r in rows])
    return ranks.sparkSession.createDataFrame([made], "n long, m long, P int, t int, steps_actual int, xi_geomean double, xi_theory double, C_trace array<long>, M_trace array<long>")


def round_summary(ranks: DataFrame, n: int, m: int) -> DataFrame:
    """One row: n, m, rounds (all), xi_geomean (without the final round), xi_theory (2)."""
    trace = boruvka_rounds(ranks, n).trace
    xs = [math.log(a / b) for _, a, b in trace[:-1] if a > b]
    mean = math.exp(sum(xs) / len(xs)) if xs else 1.0
    return ranks.sparkSession.createDataFrame([(n, m, len(trace), mean, 2.0)], "n long, m long, rounds int, xi_geomean double, xi_theory double")


EDGE = "eid long, u long, v long, w long"


def array_rounds(a: np.ndarray, b: np.ndarray, vertices: int, most: int | None = None) -> tuple:
    """Up to most rounds over whole arrays of edges in order, whose ends a and b are below vertices.

    Gives the places of the edges that each round chooses, every vertex's component, and the place and ends of each edge that
    is left.
    """
    comp, taken = np.arange(vertices), []
    edge = np.flatnonzero(a != b)
    a, b = a[edge], b[edge]
    while len(edge) and (most is None or len(taken) < most):
        best = np.full(vertices, -1)
        # written from the last to the first, the lightest edge stays
        best[a[::-1]] = edge[::-1]
        of_b = np.full(vertices, -1)
        of_b[b[::-1]] = edge[::-1]
        best = np.where((best < 0) | (of_b >= 0) & (of_b < best), of_b, best)
        live = np.flatnonzero(best >= 0)
        taken.append(np.unique(best[live]))
        at = np.searchsorted(edge, best[live])
        parent = np.arange(vertices)
        parent[live] = np.where(a[at] == live, b[at], a[at])
        mutual = live[(parent[parent[live]] == live) & (live < parent[live])]
        parent[mutual] = mutual
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        comp, a, b = parent[comp], parent[a], parent[b]
        stay = a != b
        a, b, edge = a[stay], b[stay], edge[stay]
    return taken, comp, edge, a, b


def forest_rows(eid, u, v, w) -> np.ndarray:
    """Rows of the forest of one table of edges, in the one order: rounds over whole arrays, edges sorted once."""
    order = np.lexsort((eid, np.maximum(u, v), np.minimum(u, v), w))
    names, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    taken = array_rounds(flat[: len(u)][order], flat[len(u) :][order], len(names))[0]
    return np.sort(order[np.concatenate(taken)]) if taken else np.zeros(0, np.int64)


def rounds_in_one_task(edges: DataFrame, most: int | None = None) -> DataFrame:
    """Up to most rounds over few edges (cu, cv, rank). Rows of kind 0: round and a rank that it chooses; of kind 1: vertex
    and component; of kind 2: the edges between components that are left, the lightest of each pair."""

    def run(parts):
        import pyarrow as pa

        held = [[part.column(k).to_numpy() for k in range(3)] for part in parts if part.num_rows]
        if not held:
            return
        u, v, rank = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(rank)
        rank = rank[order]
        names, flat = np.unique(np.concatenate([u[order], v[order]]), return_inverse=True)
        taken, comp, edge, a, b = array_rounds(flat[: len(rank)], flat[len(rank) :], len(names), most)
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        first = np.unique(lo * len(names) + hi, return_index=True)[1]  # edges are in order: a pair's first is its lightest
        none = np.zeros(0, np.int64)
        of_round = np.repeat(np.arange(len(taken)), [len(x) for x in taken]) if taken else none
        made = (
            (of_round, rank[np.concatenate(taken)] if taken else none, None),
            (names, names[comp], None),
            (names[lo[first]], names[hi[first]], rank[edge[first]]),
        )
        for kind, (x, y, z) in enumerate(made):
            for at in range(0, len(x), 500_000):
                own = x[at : at + 500_000]
                last = pa.nulls(len(own), pa.int64()) if z is None else pa.array(z[at : at + 500_000], pa.int64())
                columns = [pa.array(np.full(len(own), kind, np.int32)), pa.array(own, pa.int64()), pa.array(y[at : at + 500_000], pa.int64()), last]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "a", "b", "c"])

    return edges.select("cu", "cv", "rank").coalesce(1).mapInArrow(run, "kind int, a long, b long, c long")


def forest_of_partitions(edges: DataFrame, most: int = FINISH_EDGES) -> DataFrame:
    """The edges of each partition's own forest; a partition of over most edges is taken in runs, each joined with the forest so far."""

    def run(parts):
        import pyarrow as pa

        held: list = []
        size = 0

        def reduced():
            columns = [np.concatenate([h[k] for h in held]) for k in range(4)]
            rows = forest_rows(*columns)
            return [c[rows] for c in columns]

        for part in parts:
            held.append([part.column(k).to_numpy() for k in range(4)])
            size += part.num_rows
            if size > most:
                held = [reduced()]
                size = len(held[0][0])
                if size > most // 2:  # a forest that large is handed on as it is
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names=["eid", "u", "v", "w"])
                    held, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in reduced()], names=["eid", "u", "v", "w"])

    return edges.select("eid", "u", "v", "w").where("u <> v").mapInArrow(run, EDGE)


def minimum_spanning_forest(edges: DataFrame, finish: int = FINISH_EDGES) -> DataFrame:
    """The forest's edges (EDGE)."""
    left = cut(forest_of_partitions(edges, finish))
    while True:
        n = left.count()
        if n <= finish:
            return forest_of_partitions(left.coalesce(1), max(finish, n) + 1)
        parts = max(1, -(-2 * n // finish))
        if parts < left.rdd.getNumPartitions():  # forests of unions of forests, while that still makes them fewer
            fewer = cut(forest_of_partitions(left.coalesce(parts), 4 * finish))
            if fewer.count() < 0.7 * n:
                left = fewer
                continue
            left = fewer
        return _by_rounds(left, finish)


def _by_rounds(edges: DataFrame, finish: int) -> DataFrame:
    ranks = cut(ranked(edges))
    state = Rounds(lightest_per_pair(ranks.select(F.col("u").alias("cu"), F.col("v").alias("cv"), "rank")), 2**62)
    while state.edges.count() > finish:
        if not state.round():
            break
    rest = state.edges.select(F.col("rank").alias("eid"), F.col("cu").alias("u"), F.col("cv").alias("v"), F.col("rank").alias("w"))
    rest = forest_of_partitions(rest.coalesce(1), finish + 1).select(F.col("eid").alias("rank"))
    chosen = _union([*state.chosen, rest])
    return ranks.join(chosen, "rank", "left_semi").select("eid", "u", "v", "w")


def summary(forest: DataFrame) -> DataFrame:
    """One row: total_weight and n_edges; 0 and 0 without edges."""
    return forest.agg(F.coalesce(F.sum("w"), F.lit(0)).cast("long").alias("total_weight"), F.count("*").alias("n_edges"))


def agreement(totals: DataFrame) -> DataFrame:
    """tag and agree: whether all algorithms (rows of tag, algo, total) gave one total, and each gave some."""
    return totals.groupBy("tag").agg(((F.count_distinct("total") == 1) & (F.count("total") == F.count("*"))).alias("agree"))
