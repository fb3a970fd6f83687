"""Scores that need more than one row: repeated bigrams, CIDEr over several orders, WUPS roll-up, sorting by any column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scorewright.functions.text import ngrams, tokens
from scorewright.operators.cider import gram_cosines


def repeated_bigrams(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, share): per cent of a text's words that stand in a bigram found twice or more; 0 for texts without bigrams.

    ``key`` names rows. Bigrams are counted by (key, bigram), so that one long text is spread over tasks.
    """
    words = df.select(key, tokens(text).alias("_words"))
    grams = words.select(key, F.posexplode(ngrams(F.col("_words"), 2)).alias("_at", "_gram"))
    again = grams.withColumn("_n", F.count("*").over(W.partitionBy(key, "_gram"))).where("_n > 1")
    marked = again.select(key, F.explode(F.array("_at", F.col("_at") + 1)).alias("_word")).distinct().groupBy(key).agg(F.count("*").alias("_marked"))
    share = F.coalesce(100.0 * F.try_divide(F.col("_marked"), F.size("_words")), F.lit(0.0))
    return words.join(marked, key, "left").select(key, share.alias("share"))


def cider_orders(df: DataFrame, key: str, prediction: Column, reference: Column, orders: int = 4) -> DataFrame:
    """(key, cider): mean over n = 1..orders of the cosine of TF-IDF n-gram vectors; an order without n-grams counts as 0.

    Document frequencies are taken over all references.
    """
    scores = gram_cosines(df, key, prediction, reference, list(range(1, orders + 1)))
    return scores.select(key, (F.aggregate("cosines", F.lit(0.0), lambda a, x: a + x) / orders).alias("cider"))


def wups_rollup(df: DataFrame, kind: str, score: str, threshold: float = 0.9, discount: float = 0.1) -> DataFrame:
    """(kind, n, wups, wups_high) by question type, and over all rows under the type ``all``; type TP counts as TN.

    A score below the threshold keeps a tenth of itself in ``wups_high``.
    """
    typed = df.select(F.when(F.col(kind) == "TP", "TN").otherwise(F.col(kind)).alias("kind"), F.col(score).alias("s"))
    high = F.when(F.col("s") >= threshold, F.col("s")).otherwise(F.col("s") * discount)
    figures = [F.count("*").alias("n"), (100 * F.avg("s")).alias("wups"), (100 * F.avg(high)).alias("wups_high")]
    return typed.groupBy("kind").agg(*figures).unionByName(typed.agg(*figures).select(F.lit("all").alias("kind"), "n", "wups", "wups_high"))


def sorted_by(rows: DataFrame, column: str, descending: bool, ties: list[Column]) -> DataFrame:
    """Rows by a column, missing values first when it rises and last when it falls; an unknown column changes nothing."""
    if column not in rows.columns:
        return rows
    return rows.orderBy(F.desc_nulls_last(column) if descending else F.asc_nulls_first(column), *ties)


def score_mean(rows: DataFrame, score: Column) -> DataFrame:
    """(score, n): sum of the scores over the number of rows, those without a score included; 0 for no rows."""
    return rows.agg(F.coalesce(F.try_divide(F.sum(score), F.count("*")), F.lit(0.0)).alias("score"), F.count("*").alias("n"))
