"""Dataset operators: combining, filtering, rotating, repeating and splitting record tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from scorewright.operators.ordinals import with_ordinals


def concatenate(parts: dict[str, DataFrame]) -> DataFrame:
    """Union by name with the part's name as ``dataset_name``; missing columns are null."""
    named = [df.withColumn("dataset_name", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def join_all(parts: dict[str, DataFrame], key: str, order: str) -> DataFrame:
    """Inner join of all parts on a key: the first keeps all its rows, of the others the last row of a key counts."""
    (first, base), *others = parts.items()
    out = base.withColumn(first, F.struct(*base.columns))
    for name, df in others:
        last = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias(name))
        out = out.join(last, key)
    return out


def subset(df: DataFrame, wanted: dict[str, object], meta: str | None = None) -> DataFrame:
    """AND over keys; a key is looked up in the map ``meta`` first, null never matches, lists match by any overlap."""
    kinds = dict(df.dtypes)

    def test(key: str, values: object) -> Column:
        values = values if isinstance(values, (list, tuple, set)) else [values]
        inner = F.try_element_at(F.col(meta), F.lit(key)) if meta else None
        outer = F.col(key) if key in kinds else None
        column = inner if outer is None else outer if inner is None else F.coalesce(inner, outer)
        if column is None:
            return F.lit(False)
        if outer is not None and kinds[key].startswith("array"):
            return F.coalesce(F.arrays_overlap(column, F.array(*map(F.lit, values))), F.lit(False))
        return F.coalesce(column.isin(list(values)), F.lit(False))

    return df.where(reduce(lambda a, b: a & b, [test(k, v) for k, v in wanted.items()], F.lit(True)))


def rotate_right(items: Column, by: Column) -> Column:
    n = F.size(items)
    k = F.pmod(by, n)
    return F.when(n == 0, items).otherwise(F.concat(F.slice(items, n - k + 1, k), F.slice(items, F.lit(1), n - k)))


def rotate_options(df: DataFrame, options: str, label: str, run: Column) -> DataFrame:
    """Contents move right by the run's number; the label letter moves with its content."""
    n = F.size(options)
    place = F.ascii(F.upper(F.col(label))) - 65
    moved = F.pmod(place + run, n)
    return df.withColumns({options: rotate_right(F.col(options), run), label: F.char(moved + 65)})


def repeat(df: DataFrame, times: int) -> DataFrame:
    return df.withColumn("repetition", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def shards(df: DataFrame, order: str, world: int) -> DataFrame:
    """Contiguous shards: the first n mod world shards have one row more.

    Ordinals come from :func:`numbered`, so no task sees all rows.
    """
    total = df.agg(F.count("*").alias("n")).first().n
    ranged = numbered(df, order)
    small, more = divmod(total, world)
    edge = more * (small + 1)
    at = F.col("ordinal")
    shard = F.when(at < edge, F.floor(at / (small + 1))).otherwise(more + F.floor((at - edge) / max(small, 1)))
    return ranged.withColumn("shard", shard.cast("int"))


def numbered(df: DataFrame, order: str, name: str = "ordinal") -> DataFrame:
    """Ordinals from 0 in the order of a column, without a window over all rows; nulls come first."""
    return with_ordinals(df, [order], name=name)


def null_policy(df: DataFrame, prediction: str, policy: str = "miss", fallback: str = "") -> DataFrame:
    """miss: null reads as empty; skip: such rows go; fallback: a constant takes their place."""
    if policy == "skip":
        return df.where(F.col(prediction).isNotNull())
    return df.withColumn(prediction, F.coalesce(F.col(prediction), F.lit(fallback if policy == "fallback" else "")))


def render_prompt(template: Column, query: Column) -> Column:
    """No template: the query; no query: the template without its first braces; else filled or appended."""
    named = F.replace(F.replace(template, F.lit("{query}"), query), F.lit("{}"), query)
    return (
        F.when(template.isNull(), query)
        .when(query.isNull(), F.trim(F.regexp_replace(template, r"^\s*\{[^}]*\}", "")))
        .when(template.contains("{}") | template.contains("{query}"), named)
        .otherwise(F.concat_ws("\n", query, template))
    )


def last_of_role(messages: DataFrame, role: str = "user") -> DataFrame:
    """(conv_id, turn, text) of each conversation's last message of a role."""
    return messages.where(F.col("role") == role).groupBy("conv_id").agg(F.max_by(F.struct("turn", "text"), "turn").alias("m")).select("conv_id", "m.turn", "m.text")
