"""Record shaping and roll-ups on small cases."""

import pytest
from pyspark.sql import functions as F

from scorewright.functions import records as rec
from scorewright.operators import rollup


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_options_names_and_budget(spark):
    got = one(spark, rec.inline_options(F.lit("Q? Options: A: red  car\nB: blue C: none")))
    assert [tuple(o) for o in got] == [("A", "red car"), ("B", "blue"), ("C", "none")]
    assert one(spark, rec.inline_options(F.lit("no options"))) == []
    assert one(spark, rec.safe_name(F.lit("org/model v1.5"))) == "org__model_v1_5"
    assert one(spark, rec.within_budget(F.lit("a b c d e f"), 4, 0.5)) == "a b ... e f"
    assert one(spark, rec.within_budget(F.lit("a b"), 4)) == "a b"
    items = F.array(F.lit(1), F.lit(2), F.lit(3))
    assert [one(spark, rec.budgeted_items(items, n)) for n in (None, 0, 2, -1)] == [[], [], [1, 2], [1, 2, 3]]


@pytest.mark.parametrize("text, letter", [("so (B) or (C)", "C"), ("it is A here", "A"), ("B. because", "B"), ("the red one", "A"), ("unclear", None)])
def test_choice_letter(spark, text, letter):
    assert one(spark, rec.choice_letter(F.lit(text), contents=F.array(F.lit("red"), F.lit("blue")))) == letter


def test_scores(spark):
    assert one(spark, rec.capital_letters(F.lit("aBcD"), 3)) == ["B", "D", ""]
    assert one(spark, rec.score_ratio(F.lit("1/2 and then 3/4"))) == 0.75
    assert one(spark, rec.score_ratio(F.lit("none"))) is None
    assert one(spark, rec.spider(F.lit(1.0), F.lit(None).cast("double"))) == 0.5


def test_rollups(spark):
    steps = spark.createDataFrame([(1, 0, True), (1, 1, True), (2, 0, True), (2, 1, False), (3, 0, False), (3, 1, True), (4, 0, False), (4, 1, False), (5, 0, True)], "p int, s int, ok boolean")
    out = rollup.step_consistency(steps, ["p"], F.col("s") == 0, F.col("ok"))
    assert {r.p: r.kind for r in out.collect()} == {1: "mastery", 2: "rote", 3: "unsure", 4: "lacking", 5: "mastery"}
    assert rollup.passes(steps, ["p"], ["s"], F.col("ok")).where("passed").count() == 4
    options = spark.createDataFrame([(1, 0, 3.0), (1, 1, 3.0), (2, 0, None), (2, 1, 5.0)], "d int, o int, ppl double")
    assert sorted(map(tuple, rollup.likeliest_option(options, ["d"], "o", "ppl").collect())) == [(1, 0), (2, 1)]
    assert rollup.fan_out(spark.range(1), F.array(F.lit("a"), F.lit(None), F.lit("a"), F.lit("b"))).count() == 2
