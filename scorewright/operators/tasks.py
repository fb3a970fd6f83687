"""Task layer: building records, aligning them with engine output, filtering runs, and views of the leaderboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scorewright.operators.ordinals import ordinal_join

#: Suffixes of leaderboard columns that are derived from a benchmark and are none themselves.
DERIVED = ("__runtime_inference", "__latency", "__benchmark_time", "__throughput", "__coverage")


def overlay(*maps: Column) -> Column:
    """One map of several; a later map's value stands for a key of both."""
    if len(maps) == 1:
        return maps[0]
    below, over = overlay(*maps[:-1]), maps[-1]
    return F.map_concat(F.map_filter(below, lambda k, _: ~F.map_contains_key(over, k)), over)


def renamed_key(fields: Column, old: str, new: str) -> Column:
    """The map with one key renamed, if it has it."""
    moved = F.map_concat(F.map_filter(fields, lambda k, _: ~k.isin(old, new)), F.create_map(F.lit(new), F.try_element_at(fields, F.lit(old))))
    return F.when(F.map_contains_key(fields, F.lit(old)), moved).otherwise(fields)


def aligned_tags(text: Column, tag: str, n: Column) -> Column:
    """The text with exactly ``n`` media tags: later ones go, missing ones come first."""
    parts = F.split(text, f"\\Q{tag}\\E", -1)
    have = F.size(parts) - 1
    kept = F.array_join(F.slice(parts, F.lit(1), n + 1), tag)
    rest = F.array_join(F.slice(parts, n + 2, F.greatest(have - n, F.lit(0))), "")
    return F.when(have > n, F.concat(kept, rest)).otherwise(F.concat(F.repeat(F.lit(tag), n - have), text))


def dialogue(messages: Column) -> Column:
    """``Role: text`` of each message, one a line."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), m["text"])), "\n")


def build_records(samples: DataFrame, index: Column, prompt: Column, labels: Column, options: Column, default_options: list[str], *meta: Column) -> DataFrame:
    """(index, prompt, labels, options, meta): canonical records; a sample without options has the task's."""
    fallback = F.array(*[F.lit(o) for o in default_options])
    return samples.select(
        index.cast("string").alias("index"), F.rtrim(prompt).alias("prompt"), F.filter(labels, lambda x: x.isNotNull()).alias("labels"),
        F.when(F.coalesce(F.size(options), F.lit(0)) > 0, options).otherwise(fallback).alias("options"), overlay(*meta).alias("meta"),
    )


def instances_by_record(records: DataFrame, instances: DataFrame, key: str, order: str, value: str, default: float = 100.0) -> DataFrame:
    """Records with the perplexities of their instances, by option in the order of the instances; a missing one has the default."""
    listed = instances.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.coalesce(value, F.lit(default)).alias("v")))).alias("got"))
    return records.join(listed, key, "left").withColumn("perplexities", F.coalesce(F.transform("got", lambda x: x["v"]), F.array(F.lit(default)))).drop("got")


def merged_metrics(records: DataFrame, scores: DataFrame, group: str, order: str) -> DataFrame:
    """Records with scores by position in their group; a group whose lengths differ keeps no score."""
    return ordinal_join(records, scores, [group], [order])


def eligible(prediction: Column, label: Column) -> Column:
    """Whether a verifier judges the record: it has an answer and a label."""
    return (F.coalesce(F.trim(prediction), F.lit("")) != "") & (F.coalesce(F.trim(label), F.lit("")) != "")


def engine_matches(engine: Column, wanted: list[str], every: list[str]) -> Column:
    """Whether one part of ``a / b`` holds one of the wanted names; all names ask for nothing, and "-" is none."""
    if set(wanted) >= set(every):
        return F.lit(True)
    parts = F.filter(F.split(engine, r"\s*/\s*"), lambda p: p != "-")
    return F.exists(parts, lambda p: F.greatest(*[p.contains(w) for w in wanted], F.lit(False)))


def real_benchmark(name: Column) -> Column:
    """Whether the column is a benchmark of its own."""
    derived = F.lit(False)
    for suffix in DERIVED:
        derived = derived | name.endswith(suffix)
    return ~derived


def base_name(name: Column) -> Column:
    """A benchmark's name without the number of its repetition."""
    return F.regexp_replace(name, r"__\d+$", "")


def first_written(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): of several values of a key the first written counts."""
    return rows.groupBy(key).agg(F.min_by(value, order).alias(value))


def key_union(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, position): distinct keys in the order in which they first appear, counted from 0."""
    first = rows.groupBy(key).agg(F.min(order).alias("_first"))  # as many rows as there are names of metrics
    return first.select(key, (F.row_number().over(W.orderBy("_first", key)) - 1).alias("position"))


def normalised_weights(weights: DataFrame, weight: str = "weight") -> DataFrame:
    """Weights within 0..1 that sum to 1; all 0 stay 0."""
    kept = weights.withColumn(weight, F.least(F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    total = kept.agg(F.sum(weight).alias("_sum"))
    return kept.join(F.broadcast(total)).withColumn(weight, F.coalesce(F.try_divide(weight, "_sum"), F.lit(0.0))).drop("_sum")  # one row


def dense_grid(rows: DataFrame, size: int = 7, passes: int = 2) -> DataFrame:
    """Rows of the ``size`` models and benchmarks that cover each other best, chosen in turn."""
    kept = rows.where("value is not null")
    inside = kept
    for _ in range(passes):
        models = inside.groupBy("model").agg(F.countDistinct("benchmark").alias("n")).orderBy(F.desc("n"), "model").limit(size).select("model")
        inside = kept.join(models, "model", "left_semi")
        benchmarks = inside.groupBy("benchmark").agg(F.countDistinct("model").alias("n")).orderBy(F.desc("n"), "benchmark").limit(size).select("benchmark")
        inside = kept.join(benchmarks, "benchmark", "left_semi")
    return inside.join(models, "model", "left_semi")


def last_candidate(text: Column, candidates: list[str]) -> Column:
    """The candidate that stands last in the text; null if none does."""
    ends = F.array(*[F.struct((F.instr(F.reverse(text), c[::-1]) * -1).alias("at"), F.lit(c).alias("c"), text.contains(c).alias("in")) for c in candidates])
    return F.array_max(F.filter(ends, lambda x: x["in"]))["c"]


def percentage(part: Column, whole: Column, default: float = 0.0) -> Column:
    """100 part / whole; the default for nothing or zero."""
    return F.coalesce(F.try_divide(100.0 * part, F.nullif(whole, F.lit(0))), F.lit(default))


def percent_text(value: Column) -> Column:
    """A number written with or without a percent sign; the sign does not divide it, and what is no number is null."""
    return F.trim(F.regexp_replace(F.trim(value), "%$", "")).try_cast("double")


def picked_metric(metrics: Column, names: tuple[str, ...] = ("overall", "all", "average", "avg")) -> Column:
    """The first of the usual names of a kit's total."""
    return F.coalesce(*[F.try_element_at(metrics, F.lit(n)) for n in names])


def macro_average(rows: DataFrame, group: str, value: str, scale: dict[str, float]) -> DataFrame:
    """Mean over groups of their means; a group's mean is scaled where its judge's scale is not 0..1."""
    each = rows.groupBy(group).agg(F.avg(value).alias("mean"))
    factor = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in scale.items() for x in pair]), F.col(group)), F.lit(1.0))
    return each.agg(F.avg(F.col("mean") * factor).alias("macro"), F.count("*").alias("num_groups"))


def run_statistics(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, statistic, value): one run passes through under its own name, several give mean, std, any and all."""
    got = long.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.max(value).alias("any"), F.min(value).alias("all"))
    entry = lambda name, c: F.struct(F.lit(name).alias("statistic"), F.col(c).alias("value"))
    rows = F.when(F.col("n") == 1, F.array(entry("value", "m"))).otherwise(F.array(entry("mean", "m"), entry("std", "s"), entry("any", "any"), entry("all", "all")))
    return got.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.statistic", "x.value")
