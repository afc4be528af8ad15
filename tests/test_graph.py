import math
import random

import pytest
from pyspark.sql import functions as F

from grove.operators import edges as E
from grove.operators import forest as M
from grove.operators.components import connected_components

SCHEMA = "eid long, u long, v long, w long"
GOLD = {"sf0.001": (24, 2_995_308, 159, 57_056_407), "sf0.01": (24, 2_242_574, 1_599, 620_026_360), "sf0.1": (24, 2_167_853, 15_998, 5_938_265_703)}


def table(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], SCHEMA)


def kruskal(rows):
    parent, out = {}, []

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for k, (u, v, w) in sorted(enumerate(rows), key=lambda r: (r[1][2], min(r[1][:2]), max(r[1][:2]), r[0])):
        a, b = find(u), find(v)
        if a != b:
            parent[a] = b
            out.append((k, u, v, w))
    return sorted(out)


HARD = [(0, 1, 1)] * 15 + [(j, j + 1, 10 + (j & -j).bit_length() - 1) for j in range(1, 16)]
CASES = {
    "hard_last_step": (17, HARD, 16, 162),
    "disconnected": (5, [(0, 1, 3), (1, 2, 4), (3, 4, 1)], 3, 8),
    "isolated": (4, [(0, 1, 7)], 1, 7),
    "parallel_edges": (2, [(0, 1, 5), (1, 0, 2), (0, 1, 2)], 1, 2),
    "self_loop": (2, [(0, 0, -9), (0, 1, 4)], 1, 4),
    "negative": (3, [(0, 1, -5), (1, 2, -3), (0, 2, -1)], 2, -8),
    "all_tied": (4, [(a, b, 1) for a in range(4) for b in range(a + 1, 4)], 3, 3),
    "empty": (1, [], 0, 0),
}


@pytest.mark.parametrize("name", CASES)
def test_all_ways_to_the_forest(spark, name):
    n, rows, count, weight = CASES[name]
    want = kruskal(rows)
    edges = table(spark, rows)
    ranks = E.ranked(edges)
    plain = M.minimum_spanning_forest(edges)
    by_rounds = ranks.join(M.boruvka_rounds(ranks, n).ranks(spark), "rank", "left_semi")
    by_steps = ranks.join(M.superstep_forest(ranks, n)[0], "rank", "left_semi")
    for found in (plain, by_rounds, by_steps):
        assert sorted(map(tuple, found.select("eid", "u", "v", "w").collect())) == want
        assert tuple(M.summary(found).first()) == (weight, count)


def random_rows(seed, n=120, m=400):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n), rng.randint(-5, 20)) for _ in range(m)]


def test_random_graphs_and_small_limits(spark, monkeypatch):
    rows = random_rows(1)
    edges, want = table(spark, rows).repartition(6), kruskal(rows)
    got = lambda df: sorted(map(tuple, df.select("eid", "u", "v", "w").collect()))
    assert got(M.minimum_spanning_forest(edges, finish=20)) == want  # by rounds until few are left
    monkeypatch.setattr(M, "HOOK_ROWS", 3)  # pointers doubled over tables
    ranks = E.ranked(edges)
    assert got(ranks.join(M.boruvka_rounds(ranks, 120, finish=0).ranks(spark), "rank", "left_semi")) == want


def test_rounds_by_tables_and_in_one_task_are_the_same(spark):
    rows = random_rows(2, 90, 200)
    ranks = E.ranked(table(spark, rows)).cache()
    n = len({x for u, v, _ in rows for x in (u, v)})
    whole, some, none = (M.boruvka_rounds(ranks, n, finish) for finish in (10_000, 40, 0))
    assert whole.trace == some.trace == none.trace and len(none.trace) > 2
    chosen = [sorted(r.rank for r in state.ranks(spark).collect()) for state in (whole, some, none)]
    assert chosen[0] == chosen[1] == chosen[2]
    component = lambda state: {r.vertex: r.comp for r in state.components.collect()}
    parts = [sorted(sorted(v for v, c in of.items() if c == root) for root in set(of.values())) for of in map(component, (whole, some, none))]
    assert parts[0] == parts[1] == parts[2]
    steps = [M.superstep_forest(ranks, n, t=2, steps=3, finish=finish) for finish in (10_000, 0)]
    assert steps[0][1] == steps[1][1]
    assert all(sorted(r.rank for r in found.collect()) == chosen[0] for found, _ in steps)
    ranks.unpersist()


def test_components_of_hubs(spark, monkeypatch):
    from grove.operators import components as C

    monkeypatch.setattr(C, "HUB_EDGES", 0)
    rows = [(0, k) for k in range(1, 60)] + [(k, k + 1) for k in range(100, 120)] + [(200, 200)]
    edges = spark.createDataFrame(rows, "u long, v long").repartition(4)
    got = {r.node: r.component for r in C.connected_components(edges).collect()}
    assert got == {k: 0 for k in range(60)} | {k: 100 for k in range(100, 121)} | {200: 200}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_known_totals(spark, sf):
    from grove.sources import tables as T

    for k, pairs in enumerate((T.nation_pairs, T.trade_pairs)):
        found = M.summary(M.minimum_spanning_forest(T.as_edges(pairs(spark, f"/root/testdata/{sf}")))).first()
        assert (found["n_edges"], found["total_weight"]) == GOLD[sf][2 * k : 2 * k + 2]


def test_parameters():
    assert [M.parameters(n) for n in (16, 10_000, 50_000, 100_000, 500_000, 1_000_000)] == [(3, 2), (6, 3), (7, 3), (7, 3), (8, 3), (8, 3)]
    assert M.parameters(3)[0] == M.parameters(4)[0] == 1 and M.parameters(1) == (1, 1)


def test_traces(spark):
    n, rows, *_ = CASES["hard_last_step"]
    ranks = E.ranked(table(spark, rows))
    trace = M.round_trace(ranks, n)
    got = trace.orderBy("round").collect()
    assert got[0].c_before == n and got[-1].c_after == 1 and [r.is_final for r in got] == [False] * (len(got) - 1) + [True]
    assert all(r.xi == r.c_before / r.c_after and r.xi >= 2 for r in got[:-1])
    xs = [r.xi for r in got]
    mean = M.shrinkage(trace).first()
    assert mean.xi_geomean == pytest.approx(math.exp(sum(map(math.log, xs)) / len(xs)))
    assert mean.xi_reference == pytest.approx(math.exp(sum(map(math.log, xs[:-1])) / max(1, len(xs) - 1)) if len(xs) > 1 else 1.0)
    steps = M.step_trace(ranks, n).orderBy("step").collect()
    assert steps[0].c_before == n and steps[-1].c_after == 1 and steps[-1].is_final and steps[0].m_i == 15
    one = M.step_summary(ranks, n, len(rows)).first()
    assert (one.P, one.t, one.xi_theory, one.C_trace[0]) == (2, 3, 8.0, n) and len(one.M_trace) == one.steps_actual
    assert M.round_summary(ranks, n, len(rows)).first().rounds == len(got)
    assert M.shrinkage(M.round_trace(E.ranked(table(spark, [])), 1)).first().xi_geomean == 1.0


def test_rank_and_prefix_sums(spark):
    rows = random_rows(2, m=1000)
    edges = table(spark, rows).repartition(7)
    got = [r.eid for r in E.ranked(edges).orderBy("rank").collect()]
    assert got == [k for k, _ in sorted(enumerate(rows), key=lambda r: (r[1][2], min(r[1][:2]), max(r[1][:2]), r[0]))]
    assert [r["rank"] for r in E.ranked(edges).orderBy("rank").collect()] == list(range(1, 1001))
    up = {r.w: (r.n, r.n_up_to) for r in E.weight_histogram(edges).collect()}
    for w in up:
        assert up[w] == (sum(x[2] == w for x in rows), sum(x[2] <= w for x in rows))
    assert E.lightest(E.ranked(edges), 10).count() == 10
    steps = E.activation_steps(E.ranked(edges), 1000, 3).groupBy("step").count().orderBy("step").collect()
    assert [tuple(r) for r in steps] == [(0, 333), (1, 333), (2, 334)]


def test_components_against_union_find(spark):
    for seed, m in ((3, 60), (4, 150), (5, 0)):
        rows = random_rows(seed, m=m)
        parent: dict = {}

        def find(x, parent=parent):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for u, v, _ in rows:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
        want = sorted((x, find(x)) for x in parent)
        for reduce_first in (True, False):
            assert sorted(map(tuple, connected_components(table(spark, rows), reduce_first=reduce_first).collect())) == want
    chain = spark.range(200).selectExpr("id as u", "id + 1 as v")
    assert connected_components(chain, reduce_first=False).agg(F.max("component"), F.count("*")).first() == (0, 201)


def test_contraction(spark):
    edges = E.ranked(table(spark, [(0, 1, 5), (1, 2, 1), (0, 2, 3), (2, 3, 9), (3, 4, 2)]))
    names = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 2)], "vertex long, comp long")
    assert sorted(map(tuple, E.contract(edges, names).collect())) == [(0, 2, 1), (2, 4, 2)]
    best = {r.comp: (r["rank"], r.other) for r in E.cheapest_outgoing(E.contract(edges, names)).collect()}
    assert best == {0: (1, 2), 2: (1, 0), 4: (2, 2)}


def test_agreement(spark):
    rows = [("a", "x", 1), ("a", "y", 1), ("b", "x", 1), ("b", "y", 2), ("c", "x", None), ("c", "y", None), ("d", "x", 1), ("d", "y", None)]
    got = dict(map(tuple, M.agreement(spark.createDataFrame(rows, "tag string, algo string, total long")).collect()))
    assert got == {"a": True, "b": False, "c": False, "d": False}
