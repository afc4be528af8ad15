"""Operator 4, token counts by an exact length histogram.

Documents are aggregated by encoded length (one row for each length that occurs). Suffix sums over that histogram answer,
for every context limit, how many documents and tokens reach it and how many tokens stay if each document is cut there.

Null and empty texts have length 0. Repeated rows count each, and documents of equal length are one row. Very long texts are
encoded whole, a few rows at a time. An empty table gives an empty histogram. Columns other than
the text are not read, so clashing names do no harm. The histogram has at most as many rows as there are distinct lengths
(under the square root of twice the corpus's tokens), so the windows over it stay small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, record_batch, slices
from .tokens import public, rank_encoder

TOKENIZER = "byte_bpe_50k.json"


def encoded_lengths(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """n_tokens of every row, without special tokens."""
    path = path or public(TOKENIZER)

    def run(parts):
        schema, encode = batches("n_tokens long"), rank_encoder(path).encode
        for part in slices(parts):
            yield record_batch(schema, [[len(b) // 4 for b in encode(part.column(0).to_pylist())]])

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "n_tokens long")


def length_histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """length, n_docs, tokens, docs_at_least, tokens_at_least, truncated_tokens (each document cut to this length), share_at_most."""
    counts = lengths.groupBy(F.col(length).alias("length")).agg(F.count("*").alias("n_docs"))
    up = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tokens = F.col("length") * F.col("n_docs")
    out = counts.withColumn("tokens", tokens).select(
        "length", "n_docs", "tokens",
        F.sum("n_docs").over(up).alias("docs_at_least"), F.sum("tokens").over(up).alias("tokens_at_least"),
        F.sum("n_docs").over(everything).alias("_docs"), F.sum("tokens").over(everything).alias("_tokens"),
    )
    return out.select(
        "length", "n_docs", "tokens", "docs_at_least", "tokens_at_least",
        (F.col("_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_tokens"),
        ((F.col("_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("_docs")).alias("share_at_most"),
    )


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least a share q of the documents doesn't exceed (null without documents)."""
    return histogram.where(F.col("share_at_most") >= q).agg(F.min("length").alias("length"))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For any context limits, whether they occur as a length or not: limit, docs_over, truncated_tokens."""
    spark = histogram.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in dict.fromkeys(limits)], "`limit` long")
    none = F.lit(None).cast("long")
    rows = histogram.select(none.alias("limit"), F.col("length").alias("at"), "n_docs")
    rows = rows.unionByName(wanted.select("limit", F.col("limit").alias("at"), F.lit(0).cast("long").alias("n_docs")))
    down = Window.orderBy(F.desc("at"), F.col("limit").asc_nulls_last())  # a limit before the documents of just its length
    over = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tokens = F.col("at") * F.col("n_docs")
    sums = rows.select("limit", F.sum("n_docs").over(over).alias("docs_over"), F.sum(tokens).over(over).alias("_over"), F.sum(tokens).over(everything).alias("_all"))
    return sums.where("limit is not null").select("limit", "docs_over", (F.col("_all") - F.col("_over") + F.col("limit") * F.col("docs_over")).alias("truncated_tokens"))


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return length_histogram(encoded_lengths(table(spark, sf_dir, "documents")))
