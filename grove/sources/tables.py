"""Graphs from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _weight():
    return F.round(F.col("l_extendedprice") * 100).cast("long")


def nation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lo, hi and w: the least price that links two nations, of a customer's and a supplier's."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", _weight().alias("w"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.where("c_nationkey <> s_nationkey")
    lo, hi = F.least("c_nationkey", "s_nationkey").cast("long"), F.greatest("c_nationkey", "s_nationkey").cast("long")
    return rows.groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.min("w").alias("w"))


def trade_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lo, hi and w: the least price that links a customer (even ids) and a supplier (odd ids)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", _weight().alias("w"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    ends = (F.col("o_custkey") * 2, F.col("l_suppkey") * 2 + 1)
    return rows.groupBy(F.least(*ends).alias("lo"), F.greatest(*ends).alias("hi")).agg(F.min("w").alias("w"))


def as_edges(pairs: DataFrame) -> DataFrame:
    """Edges from pairs; pairs are unique, so their eid needs no meaning beyond being unique."""
    return pairs.select(F.xxhash64("lo", "hi").alias("eid"), F.col("lo").alias("u"), F.col("hi").alias("v"), "w")


def ranked_edges(pairs: DataFrame) -> DataFrame:
    """Edges whose eid is their rank by (w, lo, hi), and rank."""
    from grove.operators.edges import numbered

    return numbered(pairs, ["w", "lo", "hi"]).select(F.col("rank").alias("eid"), F.col("lo").alias("u"), F.col("hi").alias("v"), "w", "rank")


def both_ways(pairs: DataFrame) -> DataFrame:
    """Directed edges src, dst, w."""
    w = F.col("w")
    arc = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), w.alias("w"))
    return pairs.select(F.inline(F.array(arc("lo", "hi"), arc("hi", "lo"))))  # a union would make the pairs twice


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("u", "v")).alias("vertex")).distinct()
