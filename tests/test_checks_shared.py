"""Checks that read parts made once, trigrams and repeats without quadratic steps, and Jaccard distances from one pass."""

import time

from pyspark.sql import functions as F

from scorewright.functions import checks, metrics as m


def test_parts_are_made_once_and_change_no_verdict(spark):
    df = spark.createDataFrame([("One two. Two three!\n\n* four",), ("",), (None,), ("a b a b a b a b a b a b",)], "said string").withColumn("n", F.lit(1))
    said = F.col("said")
    verdicts = lambda rows: [tuple(r) for r in rows.select(*[checks.strict(said, k, **({"prompt": F.lit("One b")} if k.startswith("repeat_") and k != "repeat_simple" else {"reference": F.lit("One two")} if k == "trigram_overlap" else {})).alias(k) for k in checks.CHECKS]).collect()]
    with checks.with_parts(df, said) as rows:
        assert "_bare_words" in rows.columns
        shared = verdicts(rows)
    assert shared == verdicts(df) and not checks._PARTS


def test_trigrams_and_repeats(spark):
    row = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert row(checks.trigrams(F.lit("a😀bcа"))) == ["a😀b", "😀bc", "bcа"]
    assert [row(checks.trigrams(F.lit(x))) for x in ("", "ab", "abc", "aaaa")] == [[""], ["ab"], ["abc"], ["aaa"]]
    assert [row(checks.at_most(F.array(*map(F.lit, "abcab")), n)) for n in (1, 2, 9)] == [False, True, True]
    began = time.perf_counter()
    assert row(F.size(checks.trigrams(F.repeat(F.lit("abcdefgh"), 50_000)))) == 8
    assert time.perf_counter() - began < 20  # to look each place up took steps by the square of the length


def test_jaccard_of_null_and_empty_texts(spark):
    df = spark.createDataFrame([(["a b", None, "a b c"], "a b"), ([""], ""), ([None], None), (["x"], None)], "l array<string>, p string")
    got = [tuple(r) for r in df.select(m.jaccard_distance(F.col("l"), F.col("p"), 1), m.jaccard_distance(F.col("l"), F.col("p"), 2)).collect()]
    assert got == [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 1.0)]
