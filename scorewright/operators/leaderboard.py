"""Leaderboard operators on long rows (model, inference, checkpoint, source, benchmark, metric, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

LOWER_IS_BETTER = ("runtime", "latency", "benchmark_time")


def lower_better(metric: Column) -> Column:
    test = metric.contains(LOWER_IS_BETTER[0])
    for name in LOWER_IS_BETTER[1:]:
        test = test | metric.contains(name)
    return test


def best_merge(rows: DataFrame) -> DataFrame:
    """One value per (model, checkpoint, source, benchmark, metric): the least of time metrics, the greatest of others."""
    return rows.groupBy("model", "checkpoint", "source", "benchmark", "metric").agg(
        F.when(lower_better(F.col("metric")), F.min("value")).otherwise(F.max("value")).alias("value"),
        F.array_join(F.array_sort(F.collect_set("inference")), " / ").alias("inference"),
    )


def metric_override(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Keeps the metric that ``chosen`` (benchmark, metric) names for a benchmark; others keep all their metrics."""
    named = chosen.withColumnRenamed("metric", "wanted")
    return rows.join(named, "benchmark", "left").where("wanted is null or wanted = metric").drop("wanted")


def weighted_average(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Mean of benchmark values by model with weights (benchmark, weight), 1 where a benchmark has none."""
    w = F.coalesce("weight", F.lit(1.0))
    return rows.join(weights, "benchmark", "left").groupBy("model").agg(F.coalesce(F.try_divide(F.sum(F.col("value") * w), F.sum(F.when(F.col("value").isNotNull(), w)))).alias("average"), F.count("value").alias("num_benchmarks"))


def checkpoint_number(checkpoint: Column) -> Column:
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(checkpoint, r"(\d+)", 1), F.lit("")), F.lit("999999999")).cast("long"), F.lit(-1))


def default_order() -> list[Column]:
    return [F.lower("model"), F.lower("inference"), checkpoint_number(F.col("checkpoint"))]


def extremes(rows: DataFrame) -> DataFrame:
    """Least and greatest value of each benchmark, null where both agree within 1e-9."""
    both = rows.groupBy("benchmark").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    apart = F.col("high") - F.col("low") > 1e-9
    return both.select("benchmark", F.when(apart, F.col("low")).alias("low"), F.when(apart, F.col("high")).alias("high"))


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset(number * size).limit(size)


def ranked(rows: DataFrame, value: str) -> DataFrame:
    """Position by value, missing values last; one row a model."""
    return rows.withColumn("rank", F.row_number().over(W.orderBy(F.desc_nulls_last(value), "model")))


def rescale(value: Column) -> Column:
    return F.when(value <= 1, value * 100).when(value <= 100, value).when(value <= 1000, value / 10).otherwise(value)


def duration(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60), F.floor(F.pmod(seconds, F.lit(60)))
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))


def normal_models(rows: DataFrame, mode: str = "normal") -> DataFrame:
    debug = F.lower("model").startswith("debug__")
    return rows if mode == "all" else rows.where(debug if mode == "debug" else ~debug)


def modality(benchmark: Column) -> Column:
    """Keyword classes in order of precedence."""
    name = F.lower(benchmark)
    return F.when(name.rlike("video|movie|clip"), "video").when(name.rlike("image|vision|view|click|chart|doc"), "image").when(name.rlike("audio|speech|voice|asr"), "audio").otherwise("text")
