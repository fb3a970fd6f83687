"""Ordinals and joins by them, shared token budgets, streams into tables, and texts that would overflow recursive patterns."""

import random

import pytest
from pyspark.sql import functions as F

from scorewright.functions import checks, extract, records, text
from scorewright.operators import dataset, ordinals, tasks
from scorewright.streaming import live


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# --- ordinals


def test_one_large_group_is_spread(spark):
    df = spark.range(200_000).select(F.when(F.col("id") < 190_000, "hot").otherwise("b").alias("g"), (F.hash("id")).alias("o"), "id")
    got = ordinals.with_ordinals(df, ["o"], ["g"], size="n")
    assert "WindowGroupLimit" not in got._jdf.queryExecution().toString()
    hot = got.where("g = 'hot'")
    assert hot.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert hot.agg(F.min("ordinal"), F.max("ordinal"), F.countDistinct("ordinal"), F.max("n")).first() == (0, 189_999, 190_000, 190_000)
    pairs = hot.alias("a").join(hot.alias("b"), F.col("a.ordinal") + 1 == F.col("b.ordinal"))
    assert pairs.where("a.o > b.o").count() == 0


def test_ordinals_nulls_ties_and_empty(spark):
    rows = [(None, 1), (None, None), ("a", 2), ("a", 2), ("a", None), ("b", 0)]
    df = spark.createDataFrame(rows, "g string, o int").withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    got = sorted([(r.g or "", r.o if r.o is not None else -1, r.ordinal, r.n) for r in ordinals.with_ordinals(df, ["o"], ["g"], size="n").collect()])
    assert got == [("", -1, 0, 2), ("", 1, 1, 2), ("a", -1, 0, 3), ("a", 2, 1, 3), ("a", 2, 2, 3), ("b", 0, 0, 1)]
    assert [r.ordinal for r in dataset.numbered(df, "o").orderBy("ordinal").collect()] == list(range(6))
    assert ordinals.with_ordinals(df.where("false"), ["o"], ["g"]).count() == 0


def test_join_by_place(spark):
    left = spark.createDataFrame([("a", 10, "x"), ("a", 20, "y"), ("b", 1, "z"), (None, 5, "n"), ("c", 1, "w")], "g string, o int, v string")
    right = spark.createDataFrame([("a", 2, 0.2), ("a", 1, 0.1), ("b", 1, 0.3), ("b", 2, 0.4), (None, 9, 0.9)], "g string, o int, s double")
    got = {r.v: r.s for r in ordinals.ordinal_join(left, right, ["g"], ["o"]).collect()}
    assert got == {"x": 0.1, "y": 0.2, "z": None, "n": 0.9, "w": None}
    assert {r.v: r.s for r in tasks.merged_metrics(left, right, "g", "o").collect()} == got
    clash = ordinals.ordinal_join(left, right.withColumnRenamed("s", "v"), ["g"], ["o"])
    assert clash.columns == ["g", "o", "v"] and clash.where("g = 'a'").count() == 2
    assert ordinals.ordinal_join(left, right.where("false"), ["g"], ["o"]).where("s is not null").count() == 0
    whole = ordinals.ordinal_join(left.where("g = 'a'"), right.where("g = 'b'").select("o", "s"), [], ["o"])
    assert {r.v: r.s for r in whole.collect()} == {"x": 0.3, "y": 0.4}


# --- budgets


def test_shared_budget(spark):
    rng = random.Random(3)
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    rows = [(words(rng.randrange(300)), words(rng.randrange(300)), words(rng.randrange(300))) for _ in range(60)] + [(None, "p", "q"), ("r", None, words(500)), ("", "", "")]
    df = spark.createDataFrame(rows, "r string, p string, q string")
    for budget in (60, 200, 400):
        for before, after in zip(rows, records.shared_budget(df, "r", "p", "q", budget).collect(), strict=True):
            n = [len((x or "").split()) for x in before]
            m = [len((x or "").split()) for x in after]
            assert m == n if sum(n) <= budget else sum(m) <= budget + 48
            assert all(b == a or "truncated" in b or len(b.split()) <= 16 for a, b in zip(before, after, strict=True))
            assert all((b or "").split()[-1:] == (a or "").split()[-1:] for a, b in zip(before, after, strict=True))
    assert records.shared_budget(df, "r", "p", "q", 0).collect() == df.collect()


# --- streams


def test_stream_goes_to_a_table(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).select(F.col("id").alias("value"), (F.col("id") % 2).alias("k")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("value long, k long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = live.drain(live.incremental_best(stream, ["k"]), "best")
    assert sorted(map(tuple, out.collect())) == [(0, 28, 15), (1, 29, 15)]
    rows = live.drain(spark.readStream.schema("value long, k long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), "rows", "append")
    assert rows.count() == 30
    assert "MemoryPlan" not in out._jdf.queryExecution().toString()


# --- no pattern repeats a group

N = 100_000


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        (r"\boxed{" + "a" * N + "}", "a" * N), (r"\boxed{" + "{}" * N + "}", "{}" * N), (r"\boxed{" * 1000 + "x" + "}" * 1000, r"\boxed{" * 999 + "x" + "}" * 999),
        (r"\boxed{1} and \boxed{\frac{1}{2}}", r"\frac{1}{2}"), (r"\boxed{a {b} {c {d {e}}}}", "a {b} {c {d {e}}}"), (r"\boxed{open \boxed{in}", "in"), (r"\boxed{}", ""), ("} { " * N, None),
        (r"\boxed{never", None), ("no box", None), (None, None), (r"} \boxed{x} {", "x"), (r"\boxed{a} \b{c}", "a"),
    ],
)
def test_boxed_of_any_length(spark, given, wanted):
    assert one(spark, extract.boxed(F.lit(given).cast("string"))) == wanted


def test_csv_fields_of_any_length(spark):
    fields = lambda t: one(spark, checks.csv_rows(F.lit(t), ","))
    assert fields('a,"b,c",d\n"x""y",z\n') == [["a", '"b,c"', "d"], ['"x""y"', "z"]]
    assert fields('odd " one, two') == [['odd " one', " two"]]
    assert fields('"s,"q') == [['"s,"q']]
    assert fields("") == [[""]]
    assert [len(r) for r in fields(",".join(['"f,f"'] * N))] == [N]
    assert one(spark, checks.special_csv(F.lit(",".join(['"f,f"'] * N)))) is False


def test_articles_have_the_same_edges_on_both_sides(spark):
    import duckdb

    from scorewright.plans.registry import _squad

    rng = random.Random(8)
    texts = ["éançeau an", "the a an The", "a-the b", "1a a1 _a a_", "x—the—y", "thé the", "", "a"] + ["".join(rng.choice(["a", "an", "the", " ", "é", "-", "—", "1", "_", "x"]) for _ in range(12)) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.x for r in df.select("i", text.squad_normalize(F.col("t")).alias("x")).orderBy("i").collect()]
    con = duckdb.connect()
    assert got == [con.execute(f"SELECT {_squad('t')} FROM (SELECT ? AS t)", [t]).fetchone()[0] for t in texts]


def test_percent_texts(spark):
    rows = [("50%", 50.0), ("-5%", -5.0), ("1e3%", 1000.0), ("12345678901%", 12345678901.0), ("0.12345678", 0.12345678), (" 7 % ", 7.0), ("x%", None), (None, None), ("", None)]
    got = [r.x for r in spark.createDataFrame([(t,) for t, _ in rows], "t string").select(tasks.percent_text(F.col("t")).alias("x")).collect()]
    assert got == [x for _, x in rows]
