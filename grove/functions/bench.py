"""Benchmark analytics over timing rows (tag, n, m, algo, trial, ms) and shrinkage rows (tag, n, m, algo, rep, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def t_hat(mean_ms: Column, n: Column, m: Column, algo: Column) -> Column:
    """Operations a millisecond: n log2(n) ** (2/3) for bms, m log2(n) for others; 0 without time."""
    log = F.when(n > 1, F.log2(n)).otherwise(F.lit(1.0))
    theta = F.when(algo == "bms", n * F.pow(log, F.lit(2.0 / 3.0))).otherwise(m * log)
    return F.when(mean_ms > 0, theta / mean_ms).otherwise(F.lit(0.0))


def trials(slowest_ms: Column, algorithms: int, target_ms: float, least: int = 3, most: int = 60) -> Column:
    """max(least, min(most, floor(T / k / budget)))."""
    each = F.floor(F.lit(float(target_ms) / algorithms) / slowest_ms)
    return F.greatest(F.lit(least), F.least(F.lit(most), each)).cast("int")


def slowest(probes: DataFrame) -> DataFrame:
    """tag and the slowest probe's ms."""
    return probes.groupBy("tag").agg(F.max("ms").alias("slowest_ms"))


def timing_stats(timing: DataFrame, keys: tuple[str, ...] = ("tag", "algo")) -> DataFrame:
    """trials, mean, least, most and sample deviation (0 of one trial)."""
    return timing.groupBy(*keys).agg(
        F.count("ms").alias("trials"), F.avg("ms").alias("mean_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.coalesce(F.stddev_samp("ms"), F.lit(0.0)).alias("sigma_ms")
    )


def speedups(stats: DataFrame, baselines: tuple[str, ...] = ("boruvka", "bms"), tag: str = "tag", algo: str = "algo") -> DataFrame:
    """stats and vs_<baseline>: the baseline's mean over this one's, null for the baseline itself."""
    of_tag = Window.partitionBy(tag)
    for b in baselines:
        mean = F.max(F.when(F.col(algo) == b, F.col("mean_ms"))).over(of_tag)
        stats = stats.withColumn(f"vs_{b}", F.when(F.col(algo) != b, mean / F.col("mean_ms")))
    return stats


def xi_means(xi: DataFrame) -> DataFrame:
    """Mean xi_geomean of each tag and algo; a missing one counts as 0."""
    return xi.groupBy("tag", "algo").agg(F.avg(F.coalesce("xi_geomean", F.lit(0.0))).alias("xi_mean"))


def first_of_each(rows: DataFrame, keys: tuple[str, ...] = ("tag", "algo"), by: str = "rep") -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(by))).where("_n = 1").drop("_n")


def or_else(a: Column, b: Column) -> Column:
    """a unless it is null or 0, else b."""
    return F.coalesce(F.nullif(a, F.lit(0)), b)


def sparse_only(rows: DataFrame, tag: str = "tag") -> DataFrame:
    return rows.where(~F.col(tag).contains("dense") & ~F.col(tag).contains("ties") & ~F.col(tag).contains("small"))


def convergence(stats: DataFrame, xi: DataFrame) -> DataFrame:
    """tag, n, xi_bms, xi_theory, xi_boruvka, t_hat_bms, t_hat_boruvka of the sparse cases that have both algorithms' xi."""
    rows = sparse_only(stats).select("tag", "n", "algo", t_hat(F.col("mean_ms"), F.col("n"), F.col("m"), F.col("algo")).alias("t"))
    of = lambda a, c: F.max(F.when(F.col("algo") == a, F.col(c)))
    hats = rows.groupBy("tag").agg(F.coalesce(of("bms", "t"), F.lit(0.0)).alias("t_hat_bms"), F.coalesce(of("boruvka", "t"), F.lit(0.0)).alias("t_hat_boruvka"))
    both = sparse_only(xi_means(xi)).groupBy("tag").agg(of("bms", "xi_mean").alias("xi_bms"), of("boruvka", "xi_mean").alias("xi_boruvka")).where("xi_bms is not null and xi_boruvka is not null")
    sample = first_of_each(xi.where("algo = 'bms'")).select("tag", "n", "xi_theory")
    joined = both.join(sample, "tag").join(hats, "tag", "left")
    return joined.select("tag", "n", "xi_bms", "xi_theory", "xi_boruvka", F.coalesce("t_hat_bms", F.lit(0.0)).alias("t_hat_bms"), F.coalesce("t_hat_boruvka", F.lit(0.0)).alias("t_hat_boruvka"))


def timing_table(timing: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """The twelve columns of the timing file, as text."""
    stats = speedups(timing_stats(timing, ("tag", "n", "m", "algo")))
    hat = t_hat(F.col("mean_ms"), F.col("n"), F.col("m"), F.col("algo"))
    fixed = lambda c, d: F.coalesce(F.format_string(f"%.{d}f", c), F.lit(""))
    ratio = lambda c: F.when(c.isNull(), F.lit("")).otherwise(F.format_string("%.4f", c))
    return stats.select(
        "tag", "n", "m", "trials", "algo", fixed(F.col("mean_ms"), 2).alias("mean_ms"), fixed(F.col("min_ms"), 0).alias("min_ms"), fixed(F.col("max_ms"), 0).alias("max_ms"),
        fixed(F.col("sigma_ms"), 2).alias("sigma_ms"), fixed(hat, 2).alias("t_hat_ops_per_ms"), ratio(F.col("vs_boruvka")).alias("vs_boruvka"), ratio(F.col("vs_bms")).alias("vs_bms"),
    )


def xi_table(xi: DataFrame) -> DataFrame:
    """The ten columns of the shrinkage file, as text; the sequence as a JSON array rounded to 4 places. xi needs tag, n, m, algo, rep, xi_geomean, xi_theory, steps_actual, rounds, t, sequence."""
    number = lambda c, d: F.when(or_else(F.col(c), F.lit(None)).isNull(), F.lit("")).otherwise(F.format_string(f"%.{d}f", F.col(c)))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return xi.select(
        "tag", "n", "m", "algo", "rep", number("xi_geomean", 4).alias("xi_geomean"), number("xi_theory", 2).alias("xi_theory"),
        text(or_else(F.col("steps_actual"), F.col("rounds"))).alias("steps_or_rounds"), text(F.col("t")).alias("t"), F.to_json(F.transform("sequence", lambda x: F.round(x, 4))).alias("xi_sequence"),
    )
