"""Queries over the test tables, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from grove.functions import bench
from grove.operators import edges as E
from grove.operators import forest as M
from grove.operators import paths as P
from grove.operators.components import connected_components
from grove.plans.storage import cut
from grove.sources import tables as T

#: Parameters of single queries: fixed ranks, sources and bounds that make their results worth looking at.
NATION_RANK, SOURCE, BOUND, BUDGET, PULL = 15, 0, 600_000, 5, 10

NATION = """nation_pairs AS (
  SELECT least(c_nationkey, s_nationkey)::BIGINT AS lo, greatest(c_nationkey, s_nationkey)::BIGINT AS hi, min(CAST(round(l_extendedprice * 100) AS BIGINT)) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2)"""
TRADE = """trade_pairs AS (
  SELECT least(o_custkey * 2, l_suppkey * 2 + 1) AS lo, greatest(o_custkey * 2, l_suppkey * 2 + 1) AS hi, min(CAST(round(l_extendedprice * 100) AS BIGINT)) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
N_RANKED = NATION + ", nation AS (SELECT row_number() OVER (ORDER BY w, lo, hi) AS rank, lo, hi, w FROM nation_pairs)"
T_RANKED = TRADE + ", trade AS (SELECT row_number() OVER (ORDER BY w, lo, hi) AS rank, lo, hi, w FROM trade_pairs)"
#: An edge is in the forest if no path of edges before it joins its ends: Kruskal as a fold over ranks, with the map from
#: vertices to components as an array.
KRUSKAL = """fold AS (
  SELECT 0::BIGINT AS rank, (SELECT list(i::BIGINT) FROM range(0, 25) t(i)) AS comp, false AS taken
  UNION ALL
  SELECT n.rank, CASE WHEN f.comp[n.lo + 1] <> f.comp[n.hi + 1] THEN list_transform(f.comp, lambda c: CASE WHEN c = greatest(f.comp[n.lo + 1], f.comp[n.hi + 1]) THEN least(f.comp[n.lo + 1], f.comp[n.hi + 1]) ELSE c END) ELSE f.comp END,
    f.comp[n.lo + 1] <> f.comp[n.hi + 1]
  FROM fold f JOIN nation n ON n.rank = f.rank + 1)"""


def _rounds_sql(active: str = "true", more: str = "EXISTS (SELECT 1 FROM best)", jumps: int = 17) -> str:
    """r: after k rounds over the active edges of trade, every vertex's component and the rank that the last round took for it.

    Each component joins the other end of its cheapest edge, of two that choose each other the smaller one stays, and
    pointers double until they are at roots (at most 2 ** jumps components in a chain).
    """
    doubled = ", ".join(f"p{j} AS (SELECT x.c, y.p, x.rank FROM p{j - 1} x JOIN p{j - 1} y ON y.c = x.p)" for j in range(1, jumps + 1))
    return f"""r(k, vertex, comp, taken) AS (
  SELECT 0, vertex, vertex, NULL::BIGINT FROM (SELECT lo AS vertex FROM trade UNION SELECT hi FROM trade)
  UNION ALL
  (WITH o AS (SELECT a.comp AS cu, b.comp AS cv, rank FROM trade JOIN r a ON a.vertex = lo JOIN r b ON b.vertex = hi WHERE a.comp <> b.comp AND {active}),
  best AS (SELECT c, min(rank) AS rank, arg_min(o, rank) AS o FROM (SELECT cu AS c, cv AS o, rank FROM o UNION ALL SELECT cv, cu, rank FROM o) GROUP BY c),
  p0 AS (SELECT x.c, CASE WHEN y.o = x.c AND x.c < x.o THEN x.c ELSE x.o END AS p, x.rank FROM best x JOIN best y ON y.c = x.o),
  {doubled}
  SELECT r.k + 1, r.vertex, coalesce(p.p, r.comp), p.rank FROM r LEFT JOIN p{jumps} p ON p.c = r.comp WHERE {more}))"""


T_KEPT = T_RANKED.replace("trade AS (", "trade AS MATERIALIZED (")
#: t rounds on the edges of each step's prefix, then rounds over all edges: live holds the components after k rounds, lim the
#: edges that were active up to then; a step's edges are the lightest between the components so far and its own new ones.
T_STEPS = f"""{T_KEPT}, c AS (SELECT count(*) AS m, (SELECT count(*) FROM (SELECT lo FROM trade UNION SELECT hi FROM trade)) AS n FROM trade),
p AS MATERIALIZED (SELECT m, n, greatest(1, CAST(ceil(log2(n) ^ (2.0 / 3)) AS INTEGER)) AS t, greatest(1, CAST(ceil(log2(n) / greatest(1, CAST(ceil(log2(n) ^ (2.0 / 3)) AS INTEGER))) AS INTEGER)) AS steps FROM c),
stepped AS MATERIALIZED (SELECT rank, lo, hi, least((rank - 1) // greatest(1, m // steps), steps - 1) AS step FROM trade, p)"""

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def nation(spark, sf_dir):
    return cut(T.ranked_edges(T.nation_pairs(spark, sf_dir)))


def trade(spark, sf_dir):
    return cut(T.ranked_edges(T.trade_pairs(spark, sf_dir)))


def _n_vertices(edges):
    return T.vertices_of(edges).count()


@query(f"WITH {TRADE} SELECT lo, hi, w FROM trade_pairs")
def edge_scan_canonical(spark, sf_dir):
    return E.canonical(T.as_edges(T.trade_pairs(spark, sf_dir))).select("lo", "hi", "w")


@query(f"WITH {T_RANKED} SELECT rank, lo, hi, w FROM trade")
def edge_rank(spark, sf_dir):
    return E.numbered(T.trade_pairs(spark, sf_dir), ["w", "lo", "hi"]).select("rank", "lo", "hi", "w")


@query(
    f"""WITH {T_RANKED}, c AS (SELECT count(*) AS m, (SELECT count(*) FROM (SELECT lo FROM trade UNION SELECT hi FROM trade)) AS n FROM trade),
p AS (SELECT m, greatest(1, CAST(ceil(log2(n) ^ (2.0 / 3)) AS BIGINT)) AS t, log2(n) AS l FROM c),
s AS (SELECT m, greatest(1, CAST(ceil(l / t) AS BIGINT)) AS steps FROM p)
SELECT rank, CAST(least((rank - 1) // greatest(1, m // steps), steps - 1) AS INTEGER) AS step FROM trade, s"""
)
def edge_activation_steps(spark, sf_dir):
    ranks = trade(spark, sf_dir)
    _, steps = M.parameters(_n_vertices(ranks))
    return E.activation_steps(ranks, ranks.count(), steps).select("rank", "step")


@query("WITH e AS (SELECT CAST(round(l_extendedprice * 100) AS BIGINT) AS w FROM lineitem) SELECT w, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY w) AS BIGINT) AS n_up_to FROM e GROUP BY w")
def weight_histogram_prefix(spark, sf_dir):
    return E.weight_histogram(T.table(spark, sf_dir, "lineitem").select(F.round(F.col("l_extendedprice") * 100).cast("long").alias("w")))


@query(f"WITH {TRADE} SELECT min(w) AS min_w, max(w) AS max_w FROM trade_pairs")
def weight_range(spark, sf_dir):
    return E.weight_range(T.trade_pairs(spark, sf_dir))


@query(f"WITH {T_RANKED} SELECT DISTINCT min(rank) AS rank FROM (SELECT lo AS c, rank FROM trade UNION ALL SELECT hi, rank FROM trade) GROUP BY c")
def coe_round0(spark, sf_dir):
    ranks = trade(spark, sf_dir)
    return E.selected(E.cheapest_outgoing(ranks.select(F.col("u").alias("cu"), F.col("v").alias("cv"), "rank")))


@query(f"WITH {T_RANKED}, b AS (SELECT lo AS c, hi AS o, rank FROM trade UNION ALL SELECT hi, lo, rank FROM trade) SELECT c AS comp, min(rank) AS rank, arg_min(o, rank) AS other FROM b GROUP BY c")
def cheapest_outgoing(spark, sf_dir):
    return E.cheapest_outgoing(trade(spark, sf_dir).select(F.col("u").alias("cu"), F.col("v").alias("cv"), "rank"))


@query(
    f"""WITH RECURSIVE {N_RANKED}, e AS (SELECT lo AS a, hi AS b FROM nation WHERE rank <= {NATION_RANK} UNION ALL SELECT hi, lo FROM nation WHERE rank <= {NATION_RANK}),
r AS (SELECT n_nationkey::BIGINT AS vertex, n_nationkey::BIGINT AS comp FROM nation_names UNION SELECT e.b, r.comp FROM r JOIN e ON e.a = r.vertex)
SELECT vertex, min(comp) AS comp FROM r GROUP BY vertex""".replace("nation_names", "main.nation")
)
def components(spark, sf_dir):
    found = connected_components(nation(spark, sf_dir).where(F.col("rank") <= NATION_RANK)).select(F.col("node").alias("vertex"), "component")
    vertices = T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("vertex"))
    return vertices.join(found, "vertex", "left").select("vertex", F.coalesce("component", "vertex").alias("comp"))


def _regions(spark, sf_dir):
    return T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("vertex"), F.col("n_regionkey").cast("long").alias("comp"))


@query(
    f"""WITH {N_RANKED.replace(", nation AS", ", ranked AS")}
SELECT least(a.n_regionkey, b.n_regionkey)::BIGINT AS cu, greatest(a.n_regionkey, b.n_regionkey)::BIGINT AS cv, min(rank) AS rank
FROM ranked JOIN nation a ON lo = a.n_nationkey JOIN nation b ON hi = b.n_nationkey WHERE a.n_regionkey <> b.n_regionkey GROUP BY 1, 2"""
)
def contract_by_region(spark, sf_dir):
    return E.contract(nation(spark, sf_dir), _regions(spark, sf_dir))


@query(
    f"""WITH {N_RANKED.replace(", nation AS", ", ranked AS")}
SELECT rank, a.n_regionkey::BIGINT AS cu, b.n_regionkey::BIGINT AS cv FROM ranked JOIN nation a ON lo = a.n_nationkey JOIN nation b ON hi = b.n_nationkey WHERE a.n_regionkey <> b.n_regionkey"""
)
def relabel_by_region(spark, sf_dir):
    return E.drop_internal(E.relabel(nation(spark, sf_dir), _regions(spark, sf_dir))).select("rank", "cu", "cv")


SUMMARY_SQL = f"WITH RECURSIVE {N_RANKED}, {KRUSKAL} SELECT CAST(sum(n.w) AS BIGINT) AS total_weight, count(*) AS n_edges FROM fold f JOIN nation n USING (rank) WHERE f.taken"


@query(SUMMARY_SQL)
def msf_summary(spark, sf_dir):
    return M.summary(M.minimum_spanning_forest(T.as_edges(T.nation_pairs(spark, sf_dir))))


@query(f"WITH RECURSIVE {N_RANKED}, {KRUSKAL} SELECT n.lo, n.hi, n.w FROM fold f JOIN nation n USING (rank) WHERE f.taken")
def msf_edges(spark, sf_dir):
    return M.minimum_spanning_forest(T.as_edges(T.nation_pairs(spark, sf_dir))).select(F.col("u").alias("lo"), F.col("v").alias("hi"), "w")


@query(SUMMARY_SQL)
def msf_rounds_summary(spark, sf_dir):
    ranks = nation(spark, sf_dir)
    return M.summary(ranks.join(M.boruvka_rounds(ranks, 25).ranks(spark), "rank", "left_semi"))


@query(SUMMARY_SQL)
def msf_superstep_summary(spark, sf_dir):
    ranks = nation(spark, sf_dir)
    return M.summary(ranks.join(M.superstep_forest(ranks, 25)[0], "rank", "left_semi"))


@query(f"WITH RECURSIVE {T_KEPT}, {_rounds_sql()} SELECT CAST(sum(w) AS BIGINT) AS total_weight, count(*) AS n_edges FROM (SELECT DISTINCT taken FROM r) JOIN trade ON rank = taken")
def msf_trade_summary(spark, sf_dir):
    """The larger graph."""
    return M.summary(M.minimum_spanning_forest(T.as_edges(T.trade_pairs(spark, sf_dir))))


@query(
    f"""WITH RECURSIVE {T_KEPT}, {_rounds_sql()}, live AS (SELECT k, count(DISTINCT comp) AS c FROM r GROUP BY k)
SELECT CAST(a.k AS INTEGER) AS round, a.c AS c_before, b.c AS c_after, a.c / b.c AS xi, b.k = (SELECT max(k) FROM live) AS is_final FROM live a JOIN live b ON b.k = a.k + 1"""
)
def xi_rounds(spark, sf_dir):
    ranks = trade(spark, sf_dir)
    return M.round_trace(ranks, _n_vertices(ranks))


@query(
    f"""WITH RECURSIVE {T_STEPS}, {_rounds_sql("(SELECT step FROM stepped s WHERE s.rank = trade.rank) <= a.k // (SELECT t FROM p)", "(SELECT count(DISTINCT comp) FROM r) > 1 AND ((SELECT max(k) FROM r) < (SELECT t * steps FROM p) OR EXISTS (SELECT 1 FROM best))")},
live AS MATERIALIZED (SELECT k, count(DISTINCT comp) AS c FROM r GROUP BY k),
s AS (SELECT k, CAST(CASE WHEN k < t * steps THEN k // t ELSE steps + k - t * steps END AS INTEGER) AS step, CASE WHEN k < t * steps THEN t ELSE 0 END AS t, least(CASE WHEN k < t * steps THEN k + t ELSE k + 1 END, (SELECT max(k) FROM live)) AS after
  FROM live, p WHERE k < (SELECT max(k) FROM live) AND (k >= t * steps OR k % t = 0)),
m AS (SELECT s.k, count(DISTINCT (least(a.comp, b.comp), greatest(a.comp, b.comp))) FILTER (e.step < s.step) + count(*) FILTER (e.step = s.step) AS m_i
  FROM s JOIN stepped e ON e.step <= s.step JOIN r a ON a.k = s.k AND a.vertex = e.lo JOIN r b ON b.k = s.k AND b.vertex = e.hi WHERE a.comp <> b.comp GROUP BY s.k)
SELECT s.step, x.c AS c_before, y.c AS c_after, coalesce(m.m_i, 0) AS m_i, CAST(s.t AS INTEGER) AS t, x.c / y.c AS xi, s.k = (SELECT max(k) FROM s) AS is_final
FROM s JOIN live x ON x.k = s.k JOIN live y ON y.k = s.after LEFT JOIN m ON m.k = s.k"""
)
def xi_steps(spark, sf_dir):
    ranks = trade(spark, sf_dir)
    return M.step_trace(ranks, _n_vertices(ranks))


def _source(spark):
    return spark.createDataFrame([(SOURCE, 0)], "vertex long, dist long")


ARCS = "arcs AS (SELECT lo AS src, hi AS dst, w FROM nation_pairs UNION ALL SELECT hi, lo, w FROM nation_pairs)"


def _sssp_sql(bound: int | None = None) -> str:
    below = f" WHERE l.dist + a.w < {bound}" if bound else ""
    # no simple path has more than 24 edges, so 24 rounds of all arcs give the shortest
    return f"""RECURSIVE {NATION}, {ARCS}, r AS (
  SELECT {SOURCE}::BIGINT AS vertex, 0::BIGINT AS dist, 0 AS k
  UNION ALL
  SELECT vertex, min(dist), k FROM (
    SELECT a.dst AS vertex, l.dist + a.w AS dist, l.k + 1 AS k FROM r l JOIN arcs a ON a.src = l.vertex{below}
    UNION ALL SELECT l.vertex, l.dist, l.k + 1 FROM r l) WHERE k <= 24 GROUP BY vertex, k),
labels AS (SELECT vertex, min(dist)::BIGINT AS dist FROM r GROUP BY vertex)"""


def _pred_sql(bound: int | None = None) -> str:
    return f"""WITH {_sssp_sql(bound)}
SELECT l.vertex, l.dist, min(p.vertex) AS pred FROM labels l LEFT JOIN (SELECT a.dst, x.vertex, x.dist + a.w AS d FROM arcs a JOIN labels x ON x.vertex = a.src) p ON p.dst = l.vertex AND p.d = l.dist GROUP BY l.vertex, l.dist"""


@query(_pred_sql())
def sssp(spark, sf_dir):
    return P.bounded(T.both_ways(T.nation_pairs(spark, sf_dir)), _source(spark))


@query(_pred_sql(BOUND))
def sssp_bounded(spark, sf_dir):
    return P.bounded(T.both_ways(T.nation_pairs(spark, sf_dir)), _source(spark), BOUND)


@query(
    f"""WITH {_sssp_sql()}, near AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY dist, vertex) AS n FROM labels) WHERE n <= {BUDGET + 1}), b AS (SELECT max(dist) AS bound FROM near)
SELECT vertex, dist, bound FROM labels, b WHERE dist < bound"""
)
def sssp_budgeted(spark, sf_dir):
    bound, found = P.budgeted(T.both_ways(T.nation_pairs(spark, sf_dir)), _source(spark), BUDGET)
    return found.withColumn("bound", F.lit(bound).cast("long"))


@query(
    f"""WITH {_sssp_sql()}, near AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY dist, vertex) AS n FROM labels) WHERE n <= 9), b AS (SELECT max(dist) AS bound FROM near)
SELECT vertex, dist, bound FROM labels, b WHERE dist < bound"""
)
def bmssp_level(spark, sf_dir):
    """Level 2 with k = 2 and t = 1: a budget of 8."""
    bound, found = P.bmssp(T.both_ways(T.nation_pairs(spark, sf_dir)), 2, _source(spark), 2, 1)
    return found.withColumn("bound", F.lit(bound).cast("long"))


@query(
    f"""WITH RECURSIVE {TRADE}, arcs AS MATERIALIZED (SELECT lo AS src, hi AS dst, w FROM trade_pairs UNION ALL SELECT hi, lo, w FROM trade_pairs),
r(vertex, dist) USING KEY (vertex) AS (
  SELECT 2::BIGINT, 0::BIGINT
  UNION
  SELECT a.dst, min(r.dist + a.w)::BIGINT FROM r JOIN arcs a ON a.src = r.vertex LEFT JOIN recurring.r old ON old.vertex = a.dst WHERE old.dist IS NULL OR r.dist + a.w < old.dist GROUP BY a.dst)
SELECT vertex, dist FROM r"""
)
def sssp_trade(spark, sf_dir):
    return P.distances(T.both_ways(T.trade_pairs(spark, sf_dir)), spark.createDataFrame([(2, 0)], "vertex long, dist long"))


@query(
    f"""WITH {TRADE}, q AS (SELECT lo AS key, min(w) AS value FROM trade_pairs GROUP BY lo), n AS (SELECT *, row_number() OVER (ORDER BY value, key) AS i FROM q)
SELECT key, value, (SELECT min(value) FROM n WHERE i > {PULL}) AS boundary FROM n WHERE i <= {PULL}"""
)
def frontier_pull(spark, sf_dir):
    queue = P.PullQueue(spark, PULL, 2**62)
    queue.insert(T.trade_pairs(spark, sf_dir).select(F.col("lo").alias("key"), F.col("w").alias("value")))
    boundary, rows = queue.pull()
    return rows.withColumn("boundary", F.lit(boundary).cast("long"))


def _pivots_sql(sources: int, k: int, bound: int) -> str:
    """Rounds from the vertices that the last round reached first, until they outgrow k times the sources; then trees of tight edges."""
    return f"""WITH RECURSIVE {NATION}, {ARCS}, r(k, vertex, dist, round) AS (
  SELECT 0, i::BIGINT, 0::BIGINT, 0 FROM range(0, {sources}) t(i)
  UNION ALL
  SELECT k + 1, vertex, min(dist)::BIGINT, min(round) FROM (
    SELECT l.k, a.dst AS vertex, l.dist + a.w AS dist, l.k + 1 AS round FROM r l JOIN arcs a ON a.src = l.vertex WHERE l.round = l.k AND l.dist + a.w < {bound}
    UNION ALL SELECT k, vertex, dist, round FROM r)
  WHERE k < {k} AND (SELECT count(*) FROM r) <= {k} * {sources} AND EXISTS (SELECT 1 FROM r WHERE r.round = r.k) GROUP BY k, vertex),
w AS MATERIALIZED (SELECT vertex, dist, round FROM r WHERE k = (SELECT max(k) FROM r)),
parents AS MATERIALIZED (SELECT w.vertex, coalesce(min(x.src), w.vertex) AS parent FROM w LEFT JOIN (
  SELECT a.src, a.dst FROM arcs a JOIN w s ON s.vertex = a.src JOIN w d ON d.vertex = a.dst WHERE s.dist + a.w = d.dist AND (a.w > 0 OR s.round < d.round)) x ON x.dst = w.vertex GROUP BY w.vertex),
up(vertex, root) AS (SELECT vertex, parent FROM parents UNION SELECT up.vertex, p.parent FROM up JOIN parents p ON p.vertex = up.root),
sizes AS (SELECT root AS vertex, count(DISTINCT up.vertex) AS n FROM up JOIN parents p ON p.vertex = up.root AND p.parent = p.vertex GROUP BY root)
SELECT w.vertex, w.dist, w.round = 0 AND ((SELECT count(*) FROM w) > {k} * {sources} OR coalesce(sizes.n, 0) >= {k}) AS is_pivot FROM w LEFT JOIN sizes USING (vertex)"""


def _sources(spark, n: int):
    return spark.createDataFrame([(k, 0) for k in range(n)], "vertex long, dist long")


@query(_pivots_sql(4, 4, BOUND))
def pivots(spark, sf_dir):
    """What the rounds reach outgrows its limit, so every source is a pivot."""
    return P.pivots(T.both_ways(T.nation_pairs(spark, sf_dir)), _sources(spark, 4), 4, BOUND)


@query(_pivots_sql(9, 3, BOUND))
def pivots_of_trees(spark, sf_dir):
    """25 vertices can't outgrow 27, so sizes of trees decide."""
    return P.pivots(T.both_ways(T.nation_pairs(spark, sf_dir)), _sources(spark, 9), 3, BOUND)


def _samples(spark, sf_dir):
    """Event values as timing samples: of a size by user, of an algorithm by type."""
    size = F.concat(F.lit("size"), F.pmod("user_id", F.lit(3)))
    algo = F.when(F.col("event_type") == F.lit("click"), "boruvka").when(F.col("event_type") == F.lit("view"), "bms").otherwise(F.col("event_type"))
    return T.table(spark, sf_dir, "events").select(size.alias("tag"), F.lit(1000).cast("long").alias("n"), F.lit(5000).cast("long").alias("m"), algo.alias("algo"), F.col("value").alias("ms"))


SAMPLES = "samples AS (SELECT 'size' || (user_id % 3) AS tag, CASE event_type WHEN 'click' THEN 'boruvka' WHEN 'view' THEN 'bms' ELSE event_type END AS algo, value AS ms FROM events)"
STATS = "stats AS (SELECT tag, algo, count(ms) AS trials, avg(ms) AS mean_ms, min(ms) AS min_ms, max(ms) AS max_ms, coalesce(stddev_samp(ms), 0) AS sigma_ms FROM samples GROUP BY tag, algo)"


@query(f"WITH {SAMPLES}, {STATS} SELECT tag, algo, trials, round(mean_ms, 6) AS mean_ms, min_ms, max_ms, round(sigma_ms, 6) AS sigma_ms, round(CASE algo WHEN 'bms' THEN 1000 * log2(1000) ^ (2.0 / 3) ELSE 5000 * log2(1000) END / mean_ms, 6) AS t_hat FROM stats")
def bench_stats(spark, sf_dir):
    stats = bench.timing_stats(_samples(spark, sf_dir), ("tag", "n", "m", "algo"))
    hat = bench.t_hat(F.col("mean_ms"), F.col("n"), F.col("m"), F.col("algo"))
    return stats.select("tag", "algo", "trials", F.round("mean_ms", 6).alias("mean_ms"), "min_ms", "max_ms", F.round("sigma_ms", 6).alias("sigma_ms"), F.round(hat, 6).alias("t_hat"))


@query(
    f"""WITH {SAMPLES}, {STATS}, b AS (SELECT *, max(mean_ms) FILTER (algo = 'boruvka') OVER (PARTITION BY tag) AS b1, max(mean_ms) FILTER (algo = 'bms') OVER (PARTITION BY tag) AS b2 FROM stats)
SELECT tag, algo, round(CASE WHEN algo <> 'boruvka' THEN b1 / mean_ms END, 6) AS vs_boruvka, round(CASE WHEN algo <> 'bms' THEN b2 / mean_ms END, 6) AS vs_bms FROM b"""
)
def bench_speedup(spark, sf_dir):
    return bench.speedups(bench.timing_stats(_samples(spark, sf_dir))).select("tag", "algo", F.round("vs_boruvka", 6).alias("vs_boruvka"), F.round("vs_bms", 6).alias("vs_bms"))


@query(f"WITH {SAMPLES} SELECT tag, max(ms) AS slowest_ms, CAST(greatest(3, least(60, floor(30000.0 / 5 / max(ms)))) AS INTEGER) AS trials FROM samples GROUP BY tag")
def bench_trials(spark, sf_dir):
    slow = bench.slowest(_samples(spark, sf_dir))
    return slow.select("tag", "slowest_ms", bench.trials(F.col("slowest_ms"), 5, 30_000).alias("trials"))


@query("SELECT 'size' || (user_id % 3) AS tag, count(DISTINCT event_type) = 1 AND count(event_type) = count(*) AS agree FROM events GROUP BY 1")
def bench_agreement(spark, sf_dir):
    rows = T.table(spark, sf_dir, "events").select(F.concat(F.lit("size"), F.pmod("user_id", F.lit(3))).alias("tag"), F.col("event_type").alias("total"))
    return M.agreement(rows)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props) AND json_extract_string(props, '$.k') IS NOT NULL")
def json_trace_parse(spark, sf_dir):
    events = T.table(spark, sf_dir, "events").select("event_id", "props")
    parsed = events.select("event_id", F.from_json("props", "k long").alias("j"))
    return parsed.where("j.k is not null").select("event_id", "j.k")


@query()
def generated_graph(spark, sf_dir):
    from grove.sources.generator import random_graph

    return random_graph(spark, 1000, 5000, connected=True)


@query(
    """SELECT * FROM (VALUES ('random', 5000::BIGINT, 5000::BIGINT, 0::BIGINT, 4999::BIGINT, 0::BIGINT, true, 1::BIGINT, true), ('uniform', 5000, 5000, 0, 4999, 0, true, 1, true), ('small', 5000, 5000, 0, 4999, 0, true, 1, true), ('negpos', 5000, 5000, 0, 4999, 0, true, 1, true))
t(weights, n_edges, n_eids, min_eid, max_eid, n_loops, in_range, n_components, shuffled)"""
)
def generated_shape(spark, sf_dir):
    """What holds for a connected graph of every weight mode: ids, ends, weights, one component, and ids that don't follow the path."""
    from functools import reduce

    from grove.sources.generator import WEIGHTS, random_graph

    def shape(weights):
        low, size = WEIGHTS[weights]
        graph = cut(random_graph(spark, 1000, 5000, weights=weights, connected=True))
        ends = F.col("u").between(0, 999) & F.col("v").between(0, 999) & F.col("w").between(low, low + size - 1)
        found = graph.agg(
            F.count("*").alias("n_edges"), F.count_distinct("eid").alias("n_eids"), F.min("eid").alias("min_eid"), F.max("eid").alias("max_eid"),
            F.count_if(F.col("u") == F.col("v")).alias("n_loops"), F.every(ends).alias("in_range"),
        )
        joined = connected_components(graph).agg(F.count_distinct("component").alias("n_components"))
        # edges in order of a path would share an end with the next one
        a, b = graph.select("eid", "u", "v"), graph.select((F.col("eid") - 1).alias("eid"), F.col("u").alias("x"), F.col("v").alias("y"))
        chained = a.join(b, "eid").agg((F.count_if(F.expr("u in (x, y) or v in (x, y)")) < 500).alias("shuffled"))
        return found.crossJoin(joined).crossJoin(chained).withColumn("weights", F.lit(weights))  # a row each

    return reduce(lambda a, b: a.unionByName(b), map(shape, WEIGHTS))


FOREST = f"RECURSIVE {N_RANKED}, {KRUSKAL}, f AS (SELECT n.lo, n.hi, n.w FROM fold JOIN nation n USING (rank) WHERE fold.taken)"


@query(f"WITH {FOREST} SELECT 'Total weight = ' || CAST(sum(w) AS BIGINT) AS value FROM f UNION ALL SELECT 'Edges in MST/MSF (' || count(*) || '):' FROM f UNION ALL SELECT lo || ' ' || hi || ' ' || w FROM f")
def forest_text(spark, sf_dir):
    from grove.sources.sinks import forest_lines

    return forest_lines(M.minimum_spanning_forest(T.as_edges(T.nation_pairs(spark, sf_dir))))


@query(f"WITH {FOREST} SELECT CAST(sum(w) AS BIGINT) AS value FROM f")
def total_scrape(spark, sf_dir):
    from grove.sources.text import scrape

    return scrape(forest_text(spark, sf_dir))


@query(SUMMARY_SQL)
def msf_tables_summary(spark, sf_dir):
    """All rounds over tables, as on graphs that no one task could finish."""
    ranks = nation(spark, sf_dir)
    return M.summary(ranks.join(M.boruvka_rounds(ranks, 25, finish=0).ranks(spark), "rank", "left_semi"))


@query(f"WITH {N_RANKED} SELECT rank - 1 AS eid, lo AS u, hi AS v, w FROM nation")
def edge_list_scan(spark, sf_dir):
    """The nation graph as a text of edges, read again."""
    from grove.plans.storage import fresh
    from grove.sources.text import read_edge_list, write_edge_list

    path = fresh(spark, "edge-list")
    write_edge_list(spark, path, 25, nation(spark, sf_dir).select((F.col("rank") - 1).alias("eid"), "u", "v", "w"))
    return read_edge_list(spark, path)[1]


@query("SELECT event_id, CAST(round(value * 100) AS BIGINT) AS cents FROM events WHERE event_id % 5 <> 0 AND event_type = 'click'")
def json_lines_scan(spark, sf_dir):
    """JSON lines of several types, of which every fifth is broken."""
    from grove.sources.text import parse_json_lines

    line = F.to_json(F.struct(F.col("event_type").alias("type"), "event_id", F.round(F.col("value") * 100).cast("long").alias("cents")))
    lines = T.table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 5 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value"))
    return parse_json_lines(lines, "type string, event_id long, cents long", kind="click").select("event_id", "cents")


@query(f"""WITH {NATION} SELECT '{{"type":"edge","lo":' || lo || ',"hi":' || hi || ',"w":' || w || '}}' AS value FROM nation_pairs""")
def json_lines_sink(spark, sf_dir):
    from grove.sources.sinks import json_lines

    return json_lines(T.nation_pairs(spark, sf_dir).select("lo", "hi", "w"), "edge")


@query(f"WITH {NATION} SELECT lo, hi, w FROM nation_pairs")
def cached_dataset(spark, sf_dir):
    """Made by the first call, found by the second."""
    from grove.plans.storage import fresh
    from grove.sources.text import cached

    path = fresh(spark, "cached")
    cached(spark, path, lambda: T.nation_pairs(spark, sf_dir))
    return cached(spark, path).select("lo", "hi", "w")


@query(f"WITH {_sssp_sql(BOUND)} SELECT 'B'' = {BOUND}' AS value UNION ALL SELECT n.n_nationkey || ' ' || coalesce(l.dist, -1) FROM nation n LEFT JOIN labels l ON l.vertex = n.n_nationkey")
def distance_text(spark, sf_dir):
    from grove.sources.sinks import distance_lines

    vertices = T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("vertex"))
    return distance_lines(BOUND, P.bounded(T.both_ways(T.nation_pairs(spark, sf_dir)), _source(spark), BOUND), vertices)


@query("SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT), (1, 2), (2, 3), (3, 4), (4, 7), (5, 8)) t(vertex, dist)")
def toy_distances(spark, sf_dir):
    """The small directed graph that is given edge by edge."""
    from grove.sources.text import digraph

    toy = digraph(spark, [(0, 1, 2), (0, 2, 5), (1, 2, 1), (1, 3, 2), (2, 3, 1), (3, 4, 3), (2, 5, 10), (4, 5, 1)])
    return P.bounded(toy, _source(spark)).select("vertex", "dist")


@query(f"WITH {T_RANKED} SELECT rank, lo, hi, w FROM trade WHERE rank <= 100")
def lightest_edges(spark, sf_dir):
    return E.lightest(trade(spark, sf_dir), 100).select("rank", F.col("u").alias("lo"), F.col("v").alias("hi"), "w")


@query(
    f"""WITH {TRADE}, q AS (SELECT lo AS key, min(w) AS value FROM trade_pairs GROUP BY lo), n AS (SELECT *, row_number() OVER (ORDER BY value, key) AS i FROM q)
SELECT key, min(value) AS value FROM (SELECT key, value FROM n WHERE i > {PULL} UNION ALL SELECT hi, w FROM trade_pairs WHERE w >= 100000 AND w < 400000) GROUP BY key"""
)
def frontier_prepend(spark, sf_dir):
    """What the queue holds after a pull and a batch from a half-open range."""
    pairs = T.trade_pairs(spark, sf_dir)
    queue = P.PullQueue(spark, PULL, 2**62)
    queue.insert(pairs.select(F.col("lo").alias("key"), F.col("w").alias("value")))
    queue.pull()
    queue.batch_prepend(pairs.select(F.col("hi").alias("key"), F.col("w").alias("value")), 100_000, 400_000)
    return queue.rows.select("key", "value")


@query(f"SELECT count(DISTINCT comp) AS n_components FROM ({ORACLE_SQL['components']})")
def component_count(spark, sf_dir):
    return components(spark, sf_dir).agg(F.count_distinct("comp").alias("n_components"))


@query(
    """SELECT count(*) AS n_rows, round(coalesce(exp(avg(ln(xi)) FILTER (xi > 1)), 1.0), 6) AS xi_geomean, round(coalesce(exp(avg(ln(xi)) FILTER (xi > 1 AND event_type <> 'view')), 1.0), 6) AS xi_reference
FROM (SELECT value / 50 AS xi, event_type FROM events)"""
)
def xi_geomean(spark, sf_dir):
    """Event values as ratios of a trace, views as its final rows."""
    trace = T.table(spark, sf_dir, "events").select((F.col("value") / 50).alias("xi"), (F.col("event_type") == "view").alias("is_final"))
    return M.shrinkage(trace).select("n_rows", F.round("xi_geomean", 6).alias("xi_geomean"), F.round("xi_reference", 6).alias("xi_reference"))


def _xi(spark, sf_dir):
    """Samples as shrinkage rows; every fourth lacks its figure."""
    rows = _samples_of(spark, sf_dir)
    missing = F.when(F.col("event_id") % 4 != 0, F.col("ms") + 1)
    return rows.select("tag", "n", "m", "algo", F.col("event_id").alias("rep"), missing.alias("xi_geomean"), F.lit(2.0).alias("xi_theory"), F.when(F.col("algo") == "bms", F.lit(3)).alias("steps_actual"), F.lit(7).alias("rounds"), F.lit(4).alias("t"), F.array(F.col("ms") + 1, F.col("ms") + 2).alias("sequence"))


def _samples_of(spark, sf_dir):
    size = F.concat(F.when(F.pmod("user_id", F.lit(3)) == 2, "dense").otherwise("size"), F.pmod("user_id", F.lit(3)))
    algo = F.when(F.col("event_type") == F.lit("click"), "boruvka").when(F.col("event_type") == F.lit("view"), "bms").otherwise(F.col("event_type"))
    return T.table(spark, sf_dir, "events").select("event_id", size.alias("tag"), F.lit(1000).cast("long").alias("n"), F.lit(5000).cast("long").alias("m"), algo.alias("algo"), F.col("value").alias("ms"))


XI = "xi AS (SELECT event_id AS rep, CASE user_id % 3 WHEN 2 THEN 'dense' ELSE 'size' END || (user_id % 3) AS tag, CASE event_type WHEN 'click' THEN 'boruvka' WHEN 'view' THEN 'bms' ELSE event_type END AS algo, value AS ms, CASE WHEN event_id % 4 <> 0 THEN value + 1 END AS xi_geomean FROM events)"


@query(f"WITH {XI} SELECT tag, algo, round(avg(coalesce(xi_geomean, 0)), 6) AS xi_mean FROM xi GROUP BY tag, algo")
def xi_means(spark, sf_dir):
    return bench.xi_means(_xi(spark, sf_dir)).select("tag", "algo", F.round("xi_mean", 6).alias("xi_mean"))


@query(
    f"""WITH {XI}, means AS (SELECT tag, avg(coalesce(xi_geomean, 0)) FILTER (algo = 'bms') AS xi_bms, avg(coalesce(xi_geomean, 0)) FILTER (algo = 'boruvka') AS xi_boruvka, avg(ms) FILTER (algo = 'bms') AS a, avg(ms) FILTER (algo = 'boruvka') AS b
  FROM xi WHERE tag NOT LIKE '%dense%' GROUP BY tag)
SELECT tag, 1000::BIGINT AS n, round(xi_bms, 6) AS xi_bms, 2.0::DOUBLE AS xi_theory, round(xi_boruvka, 6) AS xi_boruvka, round(1000 * log2(1000) ^ (2.0 / 3) / a, 6) AS t_hat_bms, round(5000 * log2(1000) / b, 6) AS t_hat_boruvka FROM means"""
)
def convergence(spark, sf_dir):
    stats = bench.timing_stats(_samples_of(spark, sf_dir), ("tag", "n", "m", "algo"))
    found = bench.convergence(stats, _xi(spark, sf_dir))
    return found.select("tag", "n", "xi_theory", *[F.round(c, 6).alias(c) for c in ("xi_bms", "xi_boruvka", "t_hat_bms", "t_hat_boruvka")])


@query(
    f"""WITH {SAMPLES}, {STATS}, b AS (SELECT *, max(mean_ms) FILTER (algo = 'boruvka') OVER (PARTITION BY tag) AS b1, max(mean_ms) FILTER (algo = 'bms') OVER (PARTITION BY tag) AS b2 FROM stats)
SELECT tag, 1000::BIGINT AS n, 5000::BIGINT AS m, trials, algo, printf('%.2f', mean_ms) AS mean_ms, printf('%.0f', min_ms) AS min_ms, printf('%.0f', max_ms) AS max_ms, printf('%.2f', sigma_ms) AS sigma_ms,
  printf('%.2f', CASE algo WHEN 'bms' THEN 1000 * log2(1000) ^ (2.0 / 3) ELSE 5000 * log2(1000) END / mean_ms) AS t_hat_ops_per_ms,
  CASE WHEN algo <> 'boruvka' THEN printf('%.4f', b1 / mean_ms) ELSE '' END AS vs_boruvka, CASE WHEN algo <> 'bms' THEN printf('%.4f', b2 / mean_ms) ELSE '' END AS vs_bms FROM b"""
)
def timing_csv(spark, sf_dir):
    return bench.timing_table(_samples(spark, sf_dir))


@query(
    f"""WITH {XI} SELECT tag, 1000::BIGINT AS n, 5000::BIGINT AS m, algo, rep, CASE WHEN xi_geomean IS NULL THEN '' ELSE printf('%.4f', xi_geomean) END AS xi_geomean, '2.00' AS xi_theory,
  CASE algo WHEN 'bms' THEN '3' ELSE '7' END AS steps_or_rounds, '4' AS t, '[' || round(ms + 1, 4) || ',' || round(ms + 2, 4) || ']' AS xi_sequence FROM xi"""
)
def xi_csv(spark, sf_dir):
    return bench.xi_table(_xi(spark, sf_dir))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i FROM events) WHERE i = 1")
def first_of_group(spark, sf_dir):
    rows = T.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return bench.first_of_each(rows, ("user_id", "event_type"), "event_id")


@query("SELECT * FROM (VALUES ('10k', 10000::BIGINT, 50000::BIGINT), ('dense_50k', 50000, 2500000)) t(tag, n, m)")
def requested_sizes(spark, sf_dir):
    from grove.sources.generator import cases

    return spark.createDataFrame([c[:3] for c in cases(["10k", "dense_50k"])], "tag string, n long, m long")
