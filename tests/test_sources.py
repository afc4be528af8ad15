import csv
import glob
import json
import statistics

import pytest
from pyspark.sql import functions as F

from grove.functions import bench
from grove.operators import forest as M
from grove.plans import benchmark, report
from grove.sources import generator, sinks, text

TIMING = [("10k", 10_000, 50_000, a, k, ms) for a, times in {"boruvka": [30.0, 34.0, 32.0], "bms": [16.0, 15.0], "par_T2": [20.0]}.items() for k, ms in enumerate(times)]
XI = [("10k", 10_000, 50_000, "bms", 0, 8.5, 64.0, 3, None, 6, [9.12345, 8.0]), ("10k", 10_000, 50_000, "boruvka", 0, 3.5, 2.0, None, 7, None, [3.5]), ("dense", 5, 9, "bms", 0, None, 4.0, 1, None, 2, [])]


@pytest.mark.parametrize("weights, low, high", [("random", 1, 10**9), ("uniform", 1, 1), ("small", 1, 100), ("negpos", -(10**9), 10**9)])
def test_generator(spark, weights, low, high):
    rows = generator.random_graph(spark, 50, 300, weights=weights, connected=True).collect()
    assert sorted(r.eid for r in rows) == list(range(300)) and all(0 <= r.u < 50 and 0 <= r.v < 50 and r.u != r.v and low <= r.w <= high for r in rows)
    again = generator.random_graph(spark, 50, 300, weights=weights, connected=True).collect()
    assert sorted(rows) == sorted(again)
    edges = spark.createDataFrame(rows)
    assert M.minimum_spanning_forest(edges).count() == 49
    assert sorted(rows) != sorted(generator.random_graph(spark, 50, 300, seed=7, weights=weights, connected=True).collect())


def test_generator_refuses(spark):
    for bad in (dict(n=1, m=1), dict(n=2, m=0), dict(n=9, m=3, connected=True), dict(n=3, m=3, weights="other")):
        with pytest.raises(ValueError):
            generator.random_graph(spark, **bad)
    assert [c[0] for c in generator.cases(["10k", "1m"])] == ["10k", "1m"] and len(generator.cases()) == 8
    with pytest.raises(ValueError):
        generator.cases(["none"])


def test_edge_list(spark, tmp_path):
    path = f"{tmp_path}/g.txt"
    with open(path, "w") as f:
        f.write("4 3\n0 1 5\n 1  2 -7\n2 3 9000000000\n")
    n, edges = text.read_edge_list(spark, path)
    assert n == 4 and sorted(map(tuple, edges.collect())) == [(0, 0, 1, 5), (1, 1, 2, -7), (2, 2, 3, 9_000_000_000)]
    text.write_edge_list(spark, f"{tmp_path}/out", n, edges)
    assert text.read_edge_list(spark, f"{tmp_path}/out")[1].count() == 3
    with open(path, "w") as f:
        f.write("2 2\n0 5 5\n")
    with pytest.raises(ValueError):
        text.read_edge_list(spark, path)


def test_json_lines_and_scrape(spark):
    trace = spark.createDataFrame([(0, 9, 3, 3.0, False)], M.TRACE)
    lines = sinks.json_lines(trace, "round")
    assert json.loads(lines.first().value) == {"type": "round", "round": 0, "c_before": 9, "c_after": 3, "xi": 3.0, "is_final": False}
    more = lines.unionByName(spark.createDataFrame([("not json",), ('{"type":"summary","round":1}',)], "value string"))
    got = text.parse_json_lines(more, "type string, round int, xi double", kind="round").collect()
    assert [(r.type, r.round, r.xi) for r in got] == [("round", 0, 3.0)]
    assert text.parse_json_lines(more, "type string, round int").count() == 2
    found = text.scrape(spark.createDataFrame([("Total weight = -17",), ("Edges: 3",), ("Total weight = x",)], "value string")).collect()
    assert [r.value for r in found] == [-17]


def test_sinks(spark, tmp_path):
    forest = spark.createDataFrame([(0, 1, 2, 5), (1, 0, 1, 3)], M.EDGE)
    assert [r.value for r in sinks.forest_lines(forest).collect()] == ["Total weight = 8", "Edges in MST/MSF (2):", "0 1 3", "1 2 5"]
    assert sinks.forest_lines(forest.limit(0), edges=False).count() == 2
    labels = spark.createDataFrame([(0, 0), (2, 4)], "vertex long, dist long")
    assert [r.value for r in sinks.distance_lines(None, labels, spark.range(3).toDF("vertex")).collect()] == ["B' = INF", "0 0", "1 -1", "2 4"]
    sinks.write_text(sinks.forest_lines(forest), f"{tmp_path}/t")
    assert spark.read.text(f"{tmp_path}/t").count() == 4


def test_cached(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        text.cached(spark, f"{tmp_path}/x")
    assert text.cached(spark, f"{tmp_path}/x", lambda: spark.range(3)).count() == 3
    assert text.cached(spark, f"{tmp_path}/x", lambda: spark.range(9)).count() == 3


def test_bench_tables(spark, tmp_path):
    timing, xi = spark.createDataFrame(TIMING, benchmark.TIMING), spark.createDataFrame(XI, benchmark.XI)
    sinks.write_csv(bench.timing_table(timing).coalesce(1), f"{tmp_path}/t")
    rows = {r["algo"]: r for r in csv.DictReader(open(glob.glob(f"{tmp_path}/t/*.csv")[0]))}
    assert list(rows["bms"]) == "tag,n,m,trials,algo,mean_ms,min_ms,max_ms,sigma_ms,t_hat_ops_per_ms,vs_boruvka,vs_bms".split(",")
    assert rows["bms"]["mean_ms"] == "15.50" and rows["bms"]["vs_boruvka"] == f"{32 / 15.5:.4f}" and rows["bms"]["vs_bms"] == "" == rows["boruvka"]["vs_boruvka"]
    assert rows["boruvka"]["sigma_ms"] == f"{statistics.stdev([30, 34, 32]):.2f}" and rows["par_T2"]["sigma_ms"] == "0.00" and rows["boruvka"]["trials"] == "3"
    got = {(r.tag, r.algo): r for r in bench.xi_table(xi).collect()}
    assert json.loads(got["10k", "bms"].xi_sequence) == [9.1235, 8.0] and got["10k", "bms"].steps_or_rounds == "3" and got["10k", "boruvka"].steps_or_rounds == "7" and got["dense", "bms"].xi_geomean == ""
    means = {(r.tag, r.algo): r.xi_mean for r in bench.xi_means(xi).collect()}
    assert means["dense", "bms"] == 0.0
    line = bench.convergence(bench.timing_stats(timing, ("tag", "n", "m", "algo")), xi).collect()
    assert [(r.tag, r.xi_bms, r.xi_boruvka) for r in line] == [("10k", 8.5, 3.5)]
    page = report.markdown(timing, xi)
    assert "| 10k | 10,000 | 50,000 | 2 | bms | 15.5 |" in page and "## Convergence" in page
    slow = bench.slowest(timing).select(bench.trials(F.col("slowest_ms"), 3, 30_000).alias("a"), bench.trials(F.col("slowest_ms"), 3, 10).alias("b")).first()
    assert tuple(slow) == (60, 3)


def test_benchmark_end_to_end(spark, tmp_path):
    argv = ["--output-dir", str(tmp_path), "--min-trials", "1", "--max-trials", "1", "--xi-repeats", "1", "--par-threads", "2", "--gen"]
    assert benchmark.main(argv, spark, [("tiny", 12, 20, {})]) == 0
    assert "# Benchmark report" in "".join(open(x).read() for x in glob.glob(f"{tmp_path}/bench_report.md/part*"))
    assert glob.glob(f"{tmp_path}/bench_timing.csv/*.csv") and glob.glob(f"{tmp_path}/bench_xi.csv/*.csv")
    rows = [("tiny", (12, 20, None))]
    assert not benchmark.verified(spark, dict(rows), {"a": lambda r, n: None, "b": lambda r, n: None})
