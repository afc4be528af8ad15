import heapq
import random

import pytest

from grove.operators import paths as P
from grove.sources.text import digraph

TOY = [(0, 1, 2), (0, 2, 5), (1, 2, 1), (1, 3, 2), (2, 3, 1), (3, 4, 3), (2, 5, 10), (4, 5, 1)]


def dijkstra(arcs, sources, bound=None):
    out: dict = {}
    heap = [(d, v) for v, d in sources]
    heapq.heapify(heap)
    while heap:
        d, v = heapq.heappop(heap)
        if v in out or bound is not None and d >= bound:
            continue
        out[v] = d
        for a, b, w in arcs:
            if a == v:
                heapq.heappush(heap, (d + w, b))
    return out


def starts(spark, rows):
    return spark.createDataFrame(rows, "vertex long, dist long")


def test_toy(spark):
    arcs = digraph(spark, TOY)
    source = starts(spark, [(0, 0)])
    found = {r.vertex: (r.dist, r.pred) for r in P.bounded(arcs, source).collect()}
    assert {v: d for v, (d, _) in found.items()} == {0: 0, 1: 2, 2: 3, 3: 4, 4: 7, 5: 8}
    assert {v: p for v, (_, p) in found.items()} == {0: None, 1: 0, 2: 1, 3: 1, 4: 3, 5: 4}
    bound, near = P.base_case(arcs, 0, 0, 2)
    assert bound == 3 and {r.vertex for r in near.collect()} == {0, 1}
    bound, near = P.bmssp(arcs, 2, source, 2, 1)
    assert bound is None and near.count() == 6
    assert {r.vertex: r.dist for r in P.with_unreachable(P.distances(arcs, source, 4), spark.range(6).withColumnRenamed("id", "vertex")).collect()} == {0: 0, 1: 2, 2: 3, 3: -1, 4: -1, 5: -1}


def test_random_graphs(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(60), rng.randrange(60), rng.randint(0, 9)) for _ in range(200)]
    arcs, sources = digraph(spark, rows), [(0, 3), (7, 0), (7, 5), (9, 50)]
    for bound in (None, 12):
        want = dijkstra(rows, sources, bound)
        found = P.bounded(arcs, starts(spark, sources), bound).collect()
        assert {r.vertex: r.dist for r in found} == want
        pred = {r.vertex: r.pred for r in found}
        for v in want:  # predecessors lead to a source, over tight edges
            seen = set()
            while pred[v] is not None:
                assert v not in seen and any(a == pred[v] and b == v and want[a] + w == want[v] for a, b, w in rows)
                seen.add(v)
                v = pred[v]
            assert want[v] == min(d for x, d in sources if x == v)
    want = sorted((d, v) for v, d in dijkstra(rows, sources).items())
    for budget in (1, 5, 17, 1000):
        bound, found = P.budgeted(arcs, starts(spark, sources), budget)
        limit = want[budget][0] if len(want) > budget else None
        assert bound == limit and {(r.dist, r.vertex) for r in found.collect()} == {x for x in want if limit is None or x[0] < limit}


def test_negative_weights_are_an_error(spark):
    with pytest.raises(Exception, match="negative"):
        P.distances(digraph(spark, [(0, 1, -1)]), starts(spark, [(0, 0)])).collect()


def test_zero_circles(spark):
    found = P.bounded(digraph(spark, [(0, 1, 1), (1, 2, 0), (2, 1, 0), (2, 3, 0)]), starts(spark, [(0, 0)])).collect()
    assert {r.vertex: (r.dist, r.pred) for r in found} == {0: (0, None), 1: (1, 0), 2: (1, 1), 3: (1, 2)}


def test_pivots(spark):
    chain = [(0, 1, 1), (1, 2, 1), (2, 3, 1), (10, 1, 9), (11, 12, 1)]
    got = {r.vertex: (r.dist, r.is_pivot) for r in P.pivots(digraph(spark, chain), starts(spark, [(0, 0), (10, 0), (11, 0)]), 3).collect()}
    assert {v for v, (_, p) in got.items() if p} == {0} and set(got) == {0, 1, 2, 3, 10, 11, 12}
    star = [(0, k, k) for k in range(1, 20)]
    got = P.pivots(digraph(spark, star), starts(spark, [(0, 0)]), 2).collect()
    assert {r.vertex for r in got if r.is_pivot} == {0} and len(got) == 20
    got = P.pivots(digraph(spark, star), starts(spark, [(0, 0)]), 30, bound=4).collect()
    assert {r.vertex for r in got} == {0, 1, 2, 3} and not any(r.is_pivot for r in got)


def test_tree_sizes(spark):
    tree = spark.createDataFrame([(k, max(0, k - 1)) for k in range(9)] + [(20, 20)], "vertex long, parent long")
    assert dict(map(tuple, P.tree_sizes(tree).collect())) == {0: 9, 20: 1}


def test_pull_queue(spark):
    queue = P.PullQueue(spark, 2, 100)
    assert queue.empty()
    queue.insert(spark.createDataFrame([(1, 5), (2, 3), (3, 3), (1, 4), (4, 9)], "key long, value long"))
    bound, rows = queue.pull()
    assert bound == 4 and {tuple(r) for r in rows.collect()} == {(2, 3), (3, 3)}
    queue.batch_prepend(spark.createDataFrame([(2, 1), (4, 10)], "key long, value long"))
    bound, rows = queue.pull()
    assert bound == 9 and {tuple(r) for r in rows.collect()} == {(2, 1), (1, 4)}
    bound, rows = queue.pull()
    assert bound == 100 and {tuple(r) for r in rows.collect()} == {(4, 9)} and queue.empty()


def test_vertices_with_very_many_edges(spark):
    rng = random.Random(4)
    rows = [(0, k, rng.randint(0, 50)) for k in range(1, 300)] + [(rng.randrange(300), rng.randrange(300), rng.randint(0, 9)) for _ in range(300)]
    want = dijkstra(rows, [(0, 0)])
    arcs = P.Arcs(digraph(spark, rows), task_edges=100)
    assert arcs.hot is not None and arcs.spread.select("src").distinct().count() == 1 and arcs.rest.where("src = 0").count() == 0
    assert {r.vertex: r.dist for r in P._search(arcs, starts(spark, [(0, 0)])).collect()} == want
    assert P.Arcs(digraph(spark, rows)).hot is None


def test_edges_stay_where_they_are(spark, capsys):
    arcs = P.Arcs(digraph(spark, TOY))
    arcs.expand(starts(spark, [(0, 0)]).hint("merge")).explain()
    plan = capsys.readouterr().out
    assert "hashpartitioning(vertex" in plan and "hashpartitioning(src" not in plan


def test_nth_distance(spark):
    rng = random.Random(5)
    for spread in (3, 5000, 2**50):
        values = sorted(rng.randint(-spread, spread) for _ in range(400))
        labels = starts(spark, list(enumerate(values)))
        for n in (1, 2, 57, 399, 400):
            assert P.nth_distance(labels, n) == P.nth_distance(labels, n, top=0) == values[n - 1]
        assert P.nth_distance(labels, 401) is None and P.nth_distance(labels, 401, top=0) is None
