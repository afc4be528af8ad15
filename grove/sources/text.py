"""Graphs and traces as text: edge lists, JSON lines, single figures, and graphs given row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_edge_list(spark: SparkSession, path: str, check: bool = True) -> tuple[int, DataFrame]:
    """n and the edges (eid from 0, in the order of lines) of a text whose first line is "n m", and each further one "u v w".

    With check, a wrong number of edges and ends outside 0..n-1 raise ValueError.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    numbered = lines.rdd.map(lambda r: r[0]).zipWithIndex().toDF("value string, at long")
    head = numbered.where("at = 0").first()
    if head is None:
        raise ValueError("no first line")
    n, m = map(int, head["value"].split())
    part = F.split(F.trim("value"), r"\s+")
    edges = numbered.where("at > 0").select((F.col("at") - 1).alias("eid"), *[F.try_element_at(part, F.lit(k)).cast("long").alias(c) for k, c in ((1, "u"), (2, "v"), (3, "w"))])
    if check:
        outside = F.col("u").isNull() | F.col("v").isNull() | F.col("w").isNull() | ~F.col("u").between(0, n - 1) | ~F.col("v").between(0, n - 1)
        found = edges.agg(F.count("*").alias("m"), F.count(F.when(outside, 1)).alias("bad")).first()
        if found["m"] != m or found["bad"]:
            raise ValueError(f"{found['m']} edges of {m}, {found['bad']} of them with ends outside 0..{n - 1}")
    return n, edges


def write_edge_list(spark: SparkSession, path: str, n: int, edges: DataFrame) -> None:
    """The text that read_edge_list() reads, in the order of eid, as one file's worth of lines."""
    lines = edges.select("eid", F.concat_ws(" ", "u", "v", "w").alias("value"))
    head = spark.createDataFrame([(-1, f"{n} {edges.count()}")], "eid long, value string")
    head.unionByName(lines.withColumn("eid", F.col("eid").cast("long"))).sort("eid").select("value").write.mode("overwrite").text(path)


def digraph(spark: SparkSession, rows: list[tuple[int, int, int]]) -> DataFrame:
    """Directed edges given one by one."""
    return spark.createDataFrame(rows, "src long, dst long, w long")


def parse_json_lines(lines: DataFrame, schema: str, column: str = "value", kind: str | None = None, kind_field: str = "type") -> DataFrame:
    """Fields of JSON lines; lines that don't parse are dropped, and those of another kind where one is given."""
    parsed = lines.select(F.from_json(column, f"{schema}, _bad string" if "_bad" not in schema else schema, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("j"))
    rows = parsed.where("j is not null and j._bad is null").select("j.*").drop("_bad")
    return rows if kind is None else rows.where(F.col(kind_field) == kind)


def scrape(lines: DataFrame, label: str = "Total weight", column: str = "value") -> DataFrame:
    """value (long) of the lines "label = value"."""
    found = F.regexp_extract(column, rf"^\Q{label}\E\s*=\s*(-?[0-9]+)\s*$", 1)
    return lines.where(F.col(column).startswith(label)).select(F.when(found != "", found.cast("long")).alias("value")).where("value is not null")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def cached(spark: SparkSession, path: str, make=None) -> DataFrame:
    """The Parquet table at path; made first if it isn't there, and an error if nothing makes it."""
    if not exists(spark, path):
        if make is None:
            raise FileNotFoundError(path)
        make().write.mode("ignore").parquet(path)
    return spark.read.parquet(path)
