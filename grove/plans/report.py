"""The benchmark's report: aggregates are collected (a row for each case and algorithm) and set as Markdown."""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.functions import bench

log = logging.getLogger("grove")


def _table(head: list[str], rows: list[list]) -> str:
    return "\n".join("| " + " | ".join(map(str, r)) + " |" for r in [head, ["---"] * len(head), *rows]) + "\n"


DEFINITIONS = """## Definitions

* Shrinkage of step i: components before over components after. Its mean is geometric. Theory: at least 2 a round for boruvka, 2^t a step for bms.
* Throughput t_hat: bound over mean time, in operations a millisecond. The bound is m log2(n), for bms n (log2 n)^(2/3).
* Trials: max(least, min(most, floor(T / k / budget))), with T the time for a size, k algorithms, and the slowest probe as budget.
"""


def markdown(timing: DataFrame, xi: DataFrame) -> str:
    stats = bench.speedups(bench.timing_stats(timing, ("tag", "n", "m", "algo")))
    stats = stats.withColumn("t_hat", bench.t_hat(F.col("mean_ms"), F.col("n"), F.col("m"), F.col("algo")))
    times = stats.orderBy("n", "m", "tag", "algo").collect()
    sample = bench.first_of_each(xi)
    means = bench.xi_means(xi).join(sample, ["tag", "algo"]).orderBy("n", "m", "tag", "algo").collect()
    ratio = lambda x: "-" if x is None else f"{x:.2f}x"
    out = [f"# Benchmark report\n\nMade {time.strftime('%Y-%m-%d %H:%M:%S')}\n", DEFINITIONS, "## Shrinkage\n"]
    out.append(_table(["size", "n", "m", "algorithm", "mean", "theory", "steps or rounds", "t"], [[r.tag, f"{r.n:,}", f"{r.m:,}", r.algo, f"{r.xi_mean:.2f}", f"{r.xi_theory:.1f}", r.steps_actual or r.rounds, r.t or ""] for r in means]))
    out.append("## Times\n")
    out.append(_table(["size", "n", "m", "trials", "algorithm", "mean ms", "deviation", "t_hat", "vs boruvka", "vs bms"], [[r.tag, f"{r.n:,}", f"{r.m:,}", r.trials, r.algo, f"{r.mean_ms:.1f}", f"{r.sigma_ms:.1f}", f"{r.t_hat:.0f}", ratio(r.vs_boruvka), ratio(r.vs_bms)] for r in times]))
    out.append("## Convergence over sparse graphs\n")
    rows = bench.convergence(bench.timing_stats(timing, ("tag", "n", "m", "algo")), xi).orderBy("n").collect()
    out.append(_table(["n", "bms", "theory", "boruvka", "t_hat bms", "t_hat boruvka"], [[f"{r.n:,}", f"{r.xi_bms:.2f}", f"{r.xi_theory:.1f}", f"{r.xi_boruvka:.2f}", f"{r.t_hat_bms:.0f}", f"{r.t_hat_boruvka:.0f}"] for r in rows]))
    return "\n".join(out)
