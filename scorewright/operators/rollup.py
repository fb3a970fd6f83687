"""Roll-ups of benchmarks: passes over samples, steps of a problem, options by likelihood, resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def passes(tests: DataFrame, problem: list[str], sample: list[str], ok: Column) -> DataFrame:
    """(problem, passed): whether any sample of a problem passes all its tests."""
    by_sample = tests.groupBy(*problem, *sample).agg(F.bool_and(ok).alias("ok"))
    return by_sample.groupBy(*problem).agg(F.bool_or("ok").alias("passed"))


def step_consistency(steps: DataFrame, problem: list[str], main: Column, ok: Column) -> DataFrame:
    """A row a problem: whether its main question, all and any of its steps are right, and the class these give.

    mastery: all right; rote: the main question alone stands without some step; unsure: all steps but not the main
    question; lacking: neither.  Problems without steps count all of them as right.
    """
    out = steps.groupBy(*problem).agg(
        F.coalesce(F.bool_or(F.when(main, ok)), F.lit(False)).alias("main_ok"),
        F.coalesce(F.bool_and(F.when(~main, ok)), F.lit(True)).alias("all_steps"),
        F.coalesce(F.bool_or(F.when(~main, ok)), F.lit(True)).alias("any_step"),
    )
    kind = F.when(F.col("main_ok") & F.col("all_steps"), "mastery").when(F.col("main_ok"), "rote").when(F.col("all_steps"), "unsure").otherwise("lacking")
    return out.withColumn("kind", kind)


def consistency_scores(problems: DataFrame, *group: str) -> DataFrame:
    """Strict and loose score: mastery counts 1, unsure 0.5; loosely, rote answers with any right step count too."""
    mastery, half = F.col("kind") == "mastery", 0.5 * (F.col("kind") == "unsure").cast("int")
    loose = mastery | ((F.col("kind") == "rote") & F.col("any_step"))
    return problems.groupBy(*group).agg(F.count("*").alias("n"), F.avg(mastery.cast("int") + half).alias("strict"), F.avg(loose.cast("int") + half).alias("loose"))


def likeliest_option(options: DataFrame, doc: list[str], option: str, perplexity: str, missing: float = 100.0) -> DataFrame:
    """(doc, option): the option of least perplexity; ties go to the smaller option, a missing value counts as ``missing``."""
    ppl = F.coalesce(F.col(perplexity), F.lit(missing))
    return options.groupBy(*doc).agg(F.min_by(option, F.struct(ppl, F.col(option))).alias(option))


def remaining(samples: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Samples that no saved output holds yet."""
    return samples.join(done.select(key), key, "left_anti")


def fan_out(df: DataFrame, categories: Column, name: str = "category") -> DataFrame:
    """A row in each of its categories, once in each; none without categories."""
    return df.withColumn(name, F.explode(F.array_distinct(F.filter(categories, lambda c: c.isNotNull()))))

