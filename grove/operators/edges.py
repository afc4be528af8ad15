"""Operators on edge tables: one total order, activation by rank, relabelling, contraction, cheapest outgoing edges.

An edge table has eid, u, v and w (all long). Everywhere edges are compared by (w, lesser end, greater end, eid) in original
ids; the place in that order, rank (from 1), is computed once, and later steps compare ranks alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grove.plans.storage import cut

ORDER = ("w", "lo", "hi", "eid")


def canonical(edges: DataFrame) -> DataFrame:
    """The edges and lo, hi: their ends in order."""
    return edges.withColumns({"lo": F.least("u", "v"), "hi": F.greatest("u", "v")})


def numbered(rows: DataFrame, by: list, out: str = "rank") -> DataFrame:
    """The rows and their place from 1 in the order of by.

    Rows are dealt to ranges of the order and sorted there; a range's first place follows from the sizes of those before
    it, which is one number for each partition. No task sees more than its range. The dealt rows are stored first, since
    a second evaluation would draw the ranges elsewhere.
    """
    place = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = cut(dealt.withColumns({"_part": F.shiftright(place, 33), "_row": place.bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # as many rows as partitions
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = dealt.join(F.broadcast(starts), "_part")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_start") + F.col("_row") + 1).alias(out))


def running_sum(rows: DataFrame, by: list, value: str, out: str) -> DataFrame:
    """The rows and the sum of value up to and with each in the order of by (whose values differ), by ranges as numbered() does."""
    place = F.monotonically_increasing_id()
    dealt = cut(rows.repartitionByRange(*by).withColumn("_part", F.shiftright(place, 33)))
    sums = dealt.groupBy("_part").agg(F.sum(value).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = dealt.withColumn("_sum", F.sum(value).over(within)).join(F.broadcast(starts), "_part")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_start") + F.col("_sum")).alias(out))


def ranked(edges: DataFrame) -> DataFrame:
    """The edges and their rank in the one order."""
    return numbered(canonical(edges), list(ORDER)).drop("lo", "hi")


def activation_steps(ranks: DataFrame, m: int, steps: int) -> DataFrame:
    """The step (from 0) in which each rank is activated: m // steps edges a step, what is left in the last."""
    each = max(1, m // max(1, steps))
    return ranks.withColumn("step", F.least(F.floor((F.col("rank") - 1) / F.lit(each)), F.lit(steps - 1)).cast("int"))


def lightest(ranks: DataFrame, k: int) -> DataFrame:
    """The k lightest edges."""
    return ranks.where(F.col("rank") <= k)


def weight_range(edges: DataFrame) -> DataFrame:
    return edges.agg(F.min("w").alias("min_w"), F.max("w").alias("max_w"))


def weight_histogram(edges: DataFrame) -> DataFrame:
    """w, n and n_up_to: edges of each weight, and of all weights up to it."""
    counts = edges.groupBy("w").agg(F.count("*").alias("n"))
    return running_sum(counts, ["w"], "n", "n_up_to")


def relabel(edges: DataFrame, components: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """The edges and cu, cv: their ends' components; a vertex that components doesn't name is its own."""
    for end, out in ((u, "cu"), (v, "cv")):
        names = components.select(F.col("vertex").alias("_vertex"), F.col("comp").alias("_comp"))
        edges = edges.join(names, F.col(end) == F.col("_vertex"), "left").withColumn(out, F.coalesce("_comp", end)).drop("_vertex", "_comp")
    return edges


def drop_internal(edges: DataFrame) -> DataFrame:
    return edges.where("cu <> cv")


def lightest_per_pair(edges: DataFrame) -> DataFrame:
    """cu < cv and the least rank between each two components."""
    return drop_internal(edges).groupBy(F.least("cu", "cv").alias("cu"), F.greatest("cu", "cv").alias("cv")).agg(F.min("rank").alias("rank"))


def contract(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Edges over components in place of vertices, without internal and parallel ones: cu, cv, rank."""
    return lightest_per_pair(relabel(edges, components))


def cheapest_outgoing(edges: DataFrame) -> DataFrame:
    """comp, rank and other: the cheapest edge that leaves each component, and the component it leads to (edges: cu, cv, rank)."""
    out = drop_internal(edges)
    both = out.select(F.col("cu").alias("comp"), F.col("cv").alias("other"), "rank").unionByName(out.select(F.col("cv").alias("comp"), F.col("cu").alias("other"), "rank"))
    return both.groupBy("comp").agg(F.min("rank").alias("rank"), F.min_by("other", "rank").alias("other"))


def selected(cheapest: DataFrame) -> DataFrame:
    """The distinct edges that components choose."""
    return cheapest.select("rank").distinct()
