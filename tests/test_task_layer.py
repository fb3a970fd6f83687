"""The task layer's column builders and operators called directly, with nulls, empty tables and ties."""

import pytest
from pyspark.sql import functions as F

from scorewright.operators import tasks as op
from scorewright.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def pairs(**kv):
    return F.create_map(*[F.lit(x) for p in kv.items() for x in p]) if kv else F.create_map().cast("map<string,string>")


def test_overlay_and_renamed_keys(spark):
    assert one(spark, op.overlay(pairs(a="1", b="2"), pairs(b="3"), pairs(c="4"))) == {"a": "1", "b": "3", "c": "4"}
    assert one(spark, op.overlay(pairs(a="1"))) == {"a": "1"} and one(spark, op.overlay(pairs(), pairs())) == {}
    assert one(spark, op.renamed_key(pairs(a="1", b="2"), "a", "b")) == {"b": "1"}
    assert one(spark, op.renamed_key(pairs(b="2"), "a", "b")) == {"b": "2"}


@pytest.mark.parametrize(("text", "n", "wanted"), [("a<i>b<i>", 2, "a<i>b<i>"), ("a<i>b<i>c", 1, "a<i>bc"), ("a", 2, "<i><i>a"), ("", 0, ""), ("<i>", 0, ""), (None, 1, None)])
def test_tags_are_as_many_as_media(spark, text, n, wanted):
    assert one(spark, op.aligned_tags(F.lit(text).cast("string"), "<i>", F.lit(n))) == wanted


def test_eligibility_and_engines(spark):
    rows = [("x", "y", True), (" ", "y", False), (None, "y", False), ("x", None, False), ("x", "", False)]
    df = spark.createDataFrame([r[:2] for r in rows], "p string, l string")
    assert [r.x for r in df.select(op.eligible(F.col("p"), F.col("l")).alias("x")).collect()] == [r[2] for r in rows]
    engine = lambda e, wanted: one(spark, op.engine_matches(F.lit(e), wanted, ["a", "b"]))
    assert engine("a / -", ["a"]) and not engine("- / -", ["a"]) and engine("x", ["a", "b"]) and engine("my-b/a", ["b"])


def test_benchmark_names(spark):
    assert one(spark, op.base_name(F.lit("gsm__3"))) == "gsm" and one(spark, op.base_name(F.lit("gsm__x"))) == "gsm__x"
    assert [one(spark, op.real_benchmark(F.lit(n))) for n in ("gsm", "gsm__latency", "gsm__coverage", "latency")] == [True, False, False, True]


def test_instances_keep_their_order(spark):
    records = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    instances = spark.createDataFrame([(1, 2, 0.5), (1, 1, None), (2, 1, 0.1), (9, 1, 0.2)], "k long, o int, v double")
    got = {r.k: r.perplexities for r in op.instances_by_record(records, instances, "k", "o", "v").collect()}
    assert got == {1: [100.0, 0.5], 2: [0.1], 3: [100.0]}
    assert op.instances_by_record(records.where("false"), instances, "k", "o", "v").count() == 0


def test_keys_in_the_order_of_their_first_row(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 2), ("b", 0), ("c", 2), (None, 5)], "k string, o int")
    assert [(r.k, r.position) for r in op.key_union(rows, "k", "o").orderBy("position").collect()] == [("b", 0), ("a", 1), ("c", 2), (None, 3)]
    assert op.key_union(rows.where("false"), "k", "o").count() == 0


def test_weights(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 0.5), ("c", -1.0), ("d", None)], "k string, weight double")
    assert {r.k: r.weight for r in op.normalised_weights(df).collect()} == {"a": pytest.approx(2 / 3), "b": pytest.approx(1 / 3), "c": 0.0, "d": 0.0}
    assert {r.weight for r in op.normalised_weights(df.where("k in ('c', 'd')")).collect()} == {0.0}


def test_lines_and_single_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text("h\n1\n2\n")
    assert files.count_lines(spark, str(tmp_path / "a.csv")) == 3
    df = spark.createDataFrame([(0, "x"), (1, None)], "i int, v string")
    assert files.nth_record(df, "i", 1).collect() == [(1, None)] and files.nth_record(df, "i", 7).count() == 0
    with pytest.raises(ValueError):
        files.read_records(spark, "x.pkl")
