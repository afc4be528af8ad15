"""python -m grove.plans.benchmark: generate, verify, trace, time and report the forest algorithms over the generator's cases.

Algorithms: boruvka (rounds), bms (super-steps), par_T<k> (the partitioned forest on k partitions).
"""

from __future__ import annotations

import argparse
import logging
import math
import os
import time

from pyspark.sql import DataFrame, SparkSession

from grove.functions import bench
from grove.operators import edges as E
from grove.operators import forest as M
from grove.plans import report
from grove.plans.storage import cut
from grove.sources import generator, sinks, text

log = logging.getLogger("grove")
TIMING = "tag string, n long, m long, algo string, trial int, ms double"
XI = "tag string, n long, m long, algo string, rep int, xi_geomean double, xi_theory double, steps_actual int, rounds int, t int, sequence array<double>"


def algorithms(threads: list[int]) -> dict:
    """Name to a function of (ranked edges, n) that gives the forest's total weight."""

    def total(chosen: DataFrame, ranks: DataFrame) -> int:
        return M.summary(ranks.join(chosen, "rank", "left_semi")).first()["total_weight"]

    found = {
        "boruvka": lambda ranks, n: total(M.boruvka_rounds(ranks, n).ranks(ranks.sparkSession), ranks),
        "bms": lambda ranks, n: total(M.superstep_forest(ranks, n)[0], ranks),
    }
    for k in threads:
        found[f"par_T{k}"] = lambda ranks, n, k=k: M.summary(M.minimum_spanning_forest(ranks.repartition(k))).first()["total_weight"]
    return found


def timed(f, *args) -> tuple[float, object]:
    began = time.perf_counter()
    out = f(*args)
    return (time.perf_counter() - began) * 1000, out


def verified(spark: SparkSession, graphs: dict, algos: dict) -> bool:
    """Whether all algorithms agree on each case's total; a missing total is a failure."""
    rows = [(tag, a, f(ranks, n)) for tag, (n, _, ranks) in graphs.items() for a, f in algos.items()]
    found = M.agreement(spark.createDataFrame(rows, "tag string, algo string, total long")).collect()
    for r in found:
        log.info("%s %s", r.tag, "agree" if r.agree else "DISAGREE")
    return all(r.agree for r in found)


def planned(spark: SparkSession, graphs: dict, algos: dict, target_ms: float, least: int, most: int) -> dict[str, int]:
    probes = []
    for tag, (n, _, ranks) in graphs.items():
        for a, f in algos.items():
            f(ranks, n)  # warm-up
            probes.append((tag, a, timed(f, ranks, n)[0]))
    slow = bench.slowest(spark.createDataFrame(probes, "tag string, algo string, ms double"))
    return {r.tag: r.trials for r in slow.select("tag", bench.trials(slow["slowest_ms"], len(algos), target_ms, least, most).alias("trials")).collect()}


def timings(spark: SparkSession, graphs: dict, algos: dict, trials: dict[str, int]) -> DataFrame:
    rows = []
    for tag, (n, m, ranks) in graphs.items():
        for a, f in algos.items():
            f(ranks, n)
            rows += [(tag, n, m, a, k, timed(f, ranks, n)[0]) for k in range(trials.get(tag, 3))]
    return spark.createDataFrame(rows, TIMING)


def shrinkages(spark: SparkSession, graphs: dict, repeats: int) -> DataFrame:
    rows = []
    for tag, (n, m, ranks) in graphs.items():
        for rep in range(repeats):
            steps = M.superstep_forest(ranks, n, m)[1]
            trace = M.boruvka_rounds(ranks, n).trace
            mean = lambda xs: math.exp(sum(map(math.log, xs)) / len(xs)) if xs else 1.0
            sequence = [a / b for _, a, b in trace]
            rows.append((tag, n, m, "bms", rep, mean([r[5] for r in steps if r[5] > 1 and not r[6]]), 2.0 ** M.parameters(n)[0], len(steps), None, M.parameters(n)[0], [r[5] for r in steps]))
            rows.append((tag, n, m, "boruvka", rep, mean([x for x in sequence[:-1] if x > 1]), 2.0, None, len(trace), None, sequence))
    return spark.createDataFrame(rows, XI)


def arguments(argv: list[str] | None = None):
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--build", action="store_true", help="accepted; nothing has to be built")
    p.add_argument("--gen", action="store_true", help="generate the graphs anew")
    p.add_argument("--target-sec", type=float, default=30.0)
    p.add_argument("--min-trials", type=int, default=3)
    p.add_argument("--max-trials", type=int, default=60)
    p.add_argument("--par-threads", default="2,4")
    p.add_argument("--output-dir", default="results")
    p.add_argument("--sizes")
    p.add_argument("--skip-verify", action="store_true")
    p.add_argument("--xi-only", action="store_true")
    p.add_argument("--xi-repeats", type=int, default=3)
    p.add_argument("--seed", type=int, default=42)
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, cases: list[tuple] | None = None) -> int:
    logging.basicConfig(format="[%(asctime)s] %(levelname)s %(message)s", level=logging.INFO)
    a = arguments(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    out = os.path.abspath(a.output_dir) if "://" not in a.output_dir else a.output_dir
    graphs = {}
    for tag, n, m, more in cases or generator.cases(a.sizes.split(",") if a.sizes else None):
        make = lambda n=n, m=m, more=more: generator.random_graph(spark, n, m, seed=a.seed, connected=True, **more)
        path = f"{out}/data/test_{tag}.parquet"
        if a.gen:
            make().write.mode("overwrite").parquet(path)
        graphs[tag] = n, m, cut(E.ranked(text.cached(spark, path, make)))
    algos = algorithms([int(x) for x in a.par_threads.split(",") if x])
    if not a.skip_verify and not verified(spark, graphs, algos):
        return 1
    xi = shrinkages(spark, graphs, a.xi_repeats)
    sinks.write_csv(bench.xi_table(xi).coalesce(1), f"{out}/bench_xi.csv")
    if not a.xi_only:
        timing = timings(spark, graphs, algos, planned(spark, graphs, algos, 1000 * a.target_sec, a.min_trials, a.max_trials))
        sinks.write_csv(bench.timing_table(timing).coalesce(1), f"{out}/bench_timing.csv")
        lines = report.markdown(timing, xi).split("\n")
        spark.createDataFrame(list(enumerate(lines)), "at int, value string").coalesce(1).sort("at").select("value").write.mode("overwrite").text(f"{out}/bench_report.md")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
