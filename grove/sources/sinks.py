"""What results are written as."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forest_lines(forest: DataFrame, edges: bool = True) -> DataFrame:
    """value: the total, the count, then "u v w" of each edge in the order of weight (or the first two lines alone)."""
    from grove.operators.forest import summary

    head = summary(forest).select(F.explode(F.array(
        F.struct(F.lit(-2).cast("long").alias("at"), F.concat(F.lit("Total weight = "), F.col("total_weight")).alias("value")),
        F.struct(F.lit(-1).cast("long").alias("at"), F.format_string("Edges in MST/MSF (%d):", "n_edges").alias("value")),
    ))).select("col.*", F.lit(None).cast("long").alias("w"))
    if edges:
        head = head.unionByName(forest.select(F.lit(0).cast("long").alias("at"), F.concat_ws(" ", "u", "v", "w").alias("value"), "w"))
    return head.sort("at", "w", "value").select("value")


def distance_lines(bound: int | None, labels: DataFrame, vertices: DataFrame) -> DataFrame:
    """value: B', then "vertex dist" of all vertices, -1 where there is none."""
    from grove.operators.paths import with_unreachable

    rows = with_unreachable(labels, vertices).select("vertex", F.concat_ws(" ", "vertex", "dist").alias("value"))
    head = labels.sparkSession.createDataFrame([(None, f"B' = {'INF' if bound is None else bound}")], "vertex long, value string")
    return head.unionByName(rows).sort(F.col("vertex").asc_nulls_first()).select("value")


def json_lines(rows: DataFrame, kind: str) -> DataFrame:
    """value: each row as a JSON object with its type first."""
    return rows.select(F.to_json(F.struct(F.lit(kind).alias("type"), *[F.col(f"`{c}`") for c in rows.columns])).alias("value"))


def write_text(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
