"""Ordinals without a window over a group, and joins by them.

Rows are range-partitioned by group and order, so that a large group lies in many tasks.  A row's ordinal is its place in
its partition plus the rows of its group in the partitions before; only one row for each group and partition is summed up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scorewright.storage import written


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_{k}"]) for k in keys])


def with_ordinals(df: DataFrame, order: list[str], group: list[str] = (), name: str = "ordinal", size: str | None = None) -> DataFrame:
    """``df`` with ordinals from 0 in each group (null is a group of its own), and on wish the group's ``size``.

    Null orders come first.  Rows of equal order follow a hash of all their columns, and rows equal in all columns are
    told apart in any order.  An empty table stays empty.
    """
    group = list(group)
    hashable = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    rows = df.withColumn("_tie", F.xxhash64(*hashable))
    # Written once: a partition's rows must keep their places in all that follows.
    sorted_rows = rows.repartitionByRange(*group, *order, "_tie").sortWithinPartitions(*group, *order, "_tie")
    rows = written(sorted_rows.withColumns({"_id": F.monotonically_increasing_id(), "_part": F.spark_partition_id()}).drop("_tie"), "ordinals")
    parts = rows.groupBy(*group, "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    # At most one row for each partition in a group; without groups these are as few as there are partitions.
    place = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_n").over(place.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_part").alias("_of"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(place).alias("_size"))
    parts = written(parts, "offsets")
    met = rows.join(parts, (rows["_part"] == parts["_of"]) & _same(rows, parts, group) if group else rows["_part"] == parts["_of"])
    sized = {size: F.col("_size")} if size else {}
    return met.withColumns({name: F.col("_id") + F.col("_shift"), **sized}).select(*[c for c in df.columns if c not in (name, size)], name, *sized)


def ordinal_join(left: DataFrame, right: DataFrame, group: list[str], left_order: list[str], right_order: list[str] | None = None) -> DataFrame:
    """Rows of ``left`` with those of ``right`` at the same place in their group.

    A group whose lengths differ, or that ``right`` lacks, keeps its rows with nulls.  The columns of ``right`` but for
    the group and its order are added; one that ``left`` has too is replaced.
    """
    right_order = right_order or left_order
    a = with_ordinals(left, left_order, group, "_at", "_many")
    b = with_ordinals(right, right_order, group, "_place", "_count")
    new = [c for c in right.columns if c not in (*group, *right_order)]
    b = b.select(*[F.col(g).alias(f"_{g}") for g in group], "_place", "_count", *[F.col(c).alias(f"+{c}") for c in new])
    test = (a["_at"] == b["_place"]) & (a["_many"] == b["_count"]) & _same(a, b, list(group)) if group else (a["_at"] == b["_place"]) & (a["_many"] == b["_count"])
    return a.join(b, test, "left").select(*[c for c in left.columns if c not in new], *[F.col(f"`+{c}`").alias(c) for c in new])
