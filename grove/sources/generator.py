"""Seeded random graphs.

Every number is a hash of (seed, what for, edge or vertex), so tasks need no common state and the same call gives the same
graph whatever the partitions. A connected graph starts with a path through all vertices in a hashed order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.operators.edges import numbered

#: Weight modes, each with its least weight and how many there are.
WEIGHTS = {"random": (1, 10**9), "uniform": (1, 1), "small": (1, 100), "negpos": (-(10**9), 2 * 10**9 + 1)}


def _draw(what: str, seed: int, key, size):
    return F.pmod(F.xxhash64(F.lit(what), F.lit(seed), key), F.lit(size))


def random_graph(spark: SparkSession, n: int, m: int, seed: int = 42, weights: str = "random", connected: bool = False) -> DataFrame:
    """eid (0..m-1), u, v, w. Needs n >= 2 and m >= 1, and m >= n - 1 to be connected; parallel edges may occur, self-loops don't."""
    if n < 2 or m < 1:
        raise ValueError("needs n >= 2 and m >= 1")
    if weights not in WEIGHTS:
        raise ValueError(f"unknown weights {weights}")
    if connected and m < n - 1:
        raise ValueError("a connected graph needs m >= n - 1")
    path = n - 1 if connected else 0
    u, v = _draw("u", seed, F.col("id"), n), _draw("v", seed, F.col("id"), n)
    edges = spark.range(path, m).select("id", u.alias("u"), F.when(u == v, F.pmod(v + 1, F.lit(n))).otherwise(v).alias("v"))
    if connected:
        order = numbered(spark.range(n).select(F.col("id").alias("vertex"), F.xxhash64(F.lit("p"), F.lit(seed), F.col("id")).alias("h")), ["h", "vertex"], "place")
        a, b = order.select("place", F.col("vertex").alias("u")), order.select((F.col("place") - 1).alias("place"), F.col("vertex").alias("v"))
        edges = a.join(b, "place").select((F.col("place") - 1).alias("id"), "u", "v").unionByName(edges)
    low, size = WEIGHTS[weights]
    weighted = edges.select("id", "u", "v", (_draw("w", seed, F.col("id"), size) + low).alias("w"))
    shuffled = numbered(weighted.withColumn("h", F.xxhash64(F.lit("s"), F.lit(seed), F.col("id"))), ["h", "id"], "eid")
    return shuffled.select((F.col("eid") - 1).alias("eid"), "u", "v", "w")


#: The benchmark's cases, each with tag, n, m and further arguments.
CASES = [
    ("10k", 10_000, 50_000, {}),
    ("100k", 100_000, 500_000, {}),
    ("500k", 500_000, 2_500_000, {}),
    ("1m", 1_000_000, 5_000_000, {}),
    ("dense_50k", 50_000, 2_500_000, {}),
    ("dense_100k", 100_000, 5_000_000, {}),
    ("1m_ties", 1_000_000, 5_000_000, {"weights": "uniform"}),
    ("1m_small", 1_000_000, 5_000_000, {"weights": "small"}),
]


def cases(tags: list[str] | None = None) -> list[tuple]:
    """The cases with these tags (all without); an error if none is left."""
    found = [c for c in CASES if tags is None or c[0] in tags]
    if not found:
        raise ValueError(f"no case of {tags}")
    return found
