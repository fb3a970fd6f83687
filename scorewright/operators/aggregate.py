"""Aggregations: groups, runs, corpus metrics, judges, roll-ups.  All are partial aggregates before they shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scorewright.functions.text import gram_overlaps
from scorewright.operators.cider import gram_cosines


def finite(value: Column) -> Column:
    """NaN as null, so that means skip it."""
    return F.when(~F.isnan(value), value)


def group_means(df: DataFrame, group: Column, metrics: list[str]) -> DataFrame:
    """Mean of each metric by group; a list of groups counts the row in each, null in none."""
    return df.withColumn("category", group).where("category is not null").groupBy("category").agg(F.count("*").alias("num_samples"), *[F.avg(finite(F.col(m))).alias(m) for m in metrics])


def across_runs(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean and population deviation of run values."""
    return long.groupBy(*keys).agg(F.avg(finite(F.col(value))).alias("mean"), F.stddev_pop(finite(F.col(value))).alias("std"), F.count("*").alias("num_runs"))


def any_all(long: DataFrame, keys: list[str], sample: str, hit: Column) -> DataFrame:
    """Share of samples that hit in any run and in all runs."""
    by_sample = long.groupBy(*keys, sample).agg(F.bool_or(hit).alias("a"), F.bool_and(hit).alias("b"))
    return by_sample.groupBy(*keys).agg(F.avg(F.col("a").cast("int")).alias("any_rate"), F.avg(F.col("b").cast("int")).alias("all_rate"))


def confusion(df: DataFrame, positive: Column, truth: Column) -> DataFrame:
    """Counts and precision, recall, F1, accuracy in percent-free shares; 0 where undefined."""
    c = df.agg(F.count_if(positive & truth).alias("tp"), F.count_if(positive & ~truth).alias("fp"), F.count_if(~positive & truth).alias("fn"), F.count_if(~positive & ~truth).alias("tn"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = c.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn")), "accuracy": share(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))})
    return c.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def calibration(df: DataFrame, ordinal: str, confidence: Column, correct: Column, bin_size: int = 100, norm: float = 2) -> DataFrame:
    """Weighted p-norm of |mean confidence - accuracy| over consecutive blocks of rows in input order."""
    blocks = df.groupBy(F.floor(F.col(ordinal) / bin_size).alias("block")).agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(correct).alias("a"))
    gap = F.abs(F.col("c") - F.col("a"))
    if math.isinf(norm):
        return blocks.agg(F.max(gap).alias("calibration_error"))
    return blocks.agg(F.pow(F.sum(F.col("n") * F.pow(gap, F.lit(norm))) / F.sum("n"), F.lit(1.0 / norm)).alias("calibration_error"))


def bleu(df: DataFrame, prediction: Column, reference: Column, order: int = 4) -> DataFrame:
    """Corpus BLEU with one reference: clipped n-gram counts a row, summed, then combined."""
    rows = df.select(gram_overlaps(F.array(F.lower(reference)), F.lower(prediction), F.lit(order))[0].alias("x"))
    part = lambda n, k: F.sum(F.col("x")[3 * (n - 1) + k])
    sums = rows.agg(part(1, 2).alias("c"), part(1, 1).alias("l"), *[part(n, 0).alias(f"m{n}") for n in range(1, order + 1)], *[part(n, 2).alias(f"t{n}") for n in range(1, order + 1)])
    logs = sum((F.log(F.try_divide(F.col(f"m{n}"), F.col(f"t{n}"))) for n in range(1, order + 1)), F.lit(0.0)) / order
    penalty = F.when(F.col("c") > F.col("l"), 1.0).otherwise(F.exp(1 - F.try_divide(F.col("l"), F.col("c"))))
    return sums.select(*[F.col(f"m{n}") for n in range(1, order + 1)], *[F.col(f"t{n}") for n in range(1, order + 1)], F.coalesce(penalty * F.exp(logs), F.lit(0.0)).alias("bleu"))


def cider(df: DataFrame, key: str, prediction: Column, reference: Column, n: int = 1) -> DataFrame:
    """(key, cider): cosine of TF-IDF n-gram vectors, document frequencies taken over all references."""
    return gram_cosines(df, key, prediction, reference, [n]).select(key, F.col("cosines")[0].alias("cider"))


def swap_verdict(ab: Column, ba: Column) -> Column:
    """Winner of a pair judged in both orders: BA is turned round, disagreement and silence tie."""
    flipped = F.when(ba == "A", "B").when(ba == "B", "A").otherwise(ba)
    return F.when(ab.isNull() & ba.isNull(), "tie").when(ba.isNull(), ab).when(ab.isNull(), flipped).when(ab == flipped, ab).otherwise("tie")


def win_rate(verdict: Column) -> Column:
    return F.when(verdict == "A", 1.0).otherwise(0.0)


def win_point(verdict: Column) -> Column:
    return F.when(verdict == "A", 1.0).when(verdict == "tie", 0.5).otherwise(0.0)


def bootstrap_error(df: DataFrame, value: Column, rounds: int, key: str) -> DataFrame:
    """Deviation of resampled means: each row has weight Poisson(1) in each round, drawn from a hash of row and round."""
    u = (F.pmod(F.xxhash64(key, "round"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    weight = F.lit(0)
    p, total = math.exp(-1), 0.0
    for k in range(7):
        total += p
        weight = weight + (u > total).cast("int")
        p /= k + 1
    drawn = df.select(key, value.alias("v")).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("w", weight)
    return drawn.groupBy("round").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("m")).agg(F.stddev_samp("m").alias("stderr"))


def macro_average(df: DataFrame, group: str, value: Column) -> DataFrame:
    return df.groupBy(group).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("macro"), F.count("*").alias("groups"))


def safe_percentage(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b) * 100, F.lit(0.0))


def running_rank(df: DataFrame, by: list, partition: list[str]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*partition).orderBy(*by)))
