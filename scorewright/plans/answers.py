"""Queries of choice answers, places, open answers, kinds of benchmarks and submissions, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewright.functions import benchmarks, choices as ch, grounding, open_answers
from scorewright.operators import submission as sub
from scorewright.plans.registry import query
from scorewright.plans.views import spread, table


_LETTER = "substr('ABCD', CAST(p_size % 4 + 1 AS INTEGER), 1)"


@query(f"""WITH a AS (SELECT p_partkey, p_partkey % 6 AS way, p_size % 4 AS k, {_LETTER} AS gold FROM part)
SELECT p_partkey, CASE way WHEN 5 THEN NULL WHEN 3 THEN CAST(k + 1 AS VARCHAR) WHEN 4 THEN substr('①②③④', CAST(k + 1 AS INTEGER), 1) WHEN 1 THEN lower(gold) ELSE gold END AS found,
CASE way WHEN 3 THEN 'number' WHEN 4 THEN 'circled' ELSE 'letter' END AS scheme FROM a""")
def choice_by_scheme(spark, sf_dir):
    """The scheme comes from the question's lines, from options, or from contents; answers name the choice in many ways."""
    k, way = (F.col("p_size") % 4).cast("int"), F.col("p_partkey") % 6
    sign = lambda signs: F.substr(F.lit(signs), k + 1, F.lit(1))
    listed = lambda signs, mark: F.concat_ws("\n", F.lit("Which one?"), *[F.concat(F.lit(f"{s}{mark} "), "p_name") for s in signs])
    question = F.when(way == 3, listed("1234", ".")).when(way == 4, listed("①②③④", "")).otherwise(listed("ABCD", ")"))
    gold = sign("ABCD")
    said = (
        F.when(way == 0, F.concat(F.lit("<think>(B)?</think>The final answer is **("), gold, F.lit(")**, since "), "p_name"))
        .when(way == 1, F.concat(F.lit("I would go  with option "), F.lower(gold), F.lit("; as "), "p_type"))
        .when(way == 2, F.concat(F.lit("\\boxed{X} but \\boxed{"), gold, F.lit("}")))
        .when(way == 3, F.concat(F.lit("정답은 "), sign("1234"), F.lit("번입니다")))
        .when(way == 4, F.concat(F.lit("So the answer is "), sign("①②③④"), F.lit(", "), "p_name"))
        .otherwise(F.concat(F.lit("none of "), F.size(F.split("p_name", " "))))
    )
    options = F.when(way == 2, F.array(*map(F.lit, "ABCD")))
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size"), "p_partkey")
    rows = parts.select("p_partkey", question.alias("q"), said.alias("said"), options.alias("o"))
    return rows.select("p_partkey", ch.choice(F.col("said"), F.col("q"), F.col("o")).alias("found"), ch.scheme(F.col("q"), F.col("o")).alias("scheme"))


@query("""WITH b AS (SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS x1, CAST(o_orderkey % 50 AS DOUBLE) AS y1, o_custkey + 10.0 AS x2, o_orderkey % 50 + 5.0 AS y2, o_orderkey % 4 AS way FROM orders)
SELECT o_orderkey, CASE WHEN way = 3 THEN NULL ELSE x1 END AS x1, CASE WHEN way = 3 THEN NULL ELSE y2 END AS y2, CASE WHEN way = 3 THEN x1 ELSE (x1 + x2) / 2 END AS cx, CASE WHEN way = 3 THEN y1 ELSE (y1 + y2) / 2 END AS cy,
CASE WHEN way = 3 THEN NULL WHEN way = 1 THEN x1 ELSE x2 END AS corner FROM b""")
def place_shapes(spark, sf_dir):
    """Boxes, quads, full-width brackets and clicks as box, centre and corners."""
    x1, y1 = F.col("o_custkey"), F.col("o_orderkey") % 50
    x2, y2 = x1 + 10, y1 + 5
    listed = lambda *v: F.concat_ws(", ", *[c.cast("string") for c in v])
    way = F.col("o_orderkey") % 4
    said = (
        F.when(way == 0, F.concat(F.lit("First [1, 2, 3, 4], then ("), listed(x1, y1, x2, y2), F.lit(").")))
        .when(way == 1, F.concat(F.lit("Corners {"), listed(x1, y1, x1, y2, x2, y2, x2, y1), F.lit("} around [7, 7]")))
        .when(way == 2, F.concat(F.lit("<think>[0, 0, 0, 0]</think>［"), listed(x1, y1, x2, y2), F.lit("］")))
        .otherwise(F.concat(F.lit("left_click(x="), x1, F.lit(", y="), y1, F.lit(")")))
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", said.alias("said"))
    rows = rows.select("o_orderkey", *[grounding.place(F.col("said"), t).alias(t) for t in grounding.ARITY])
    return rows.select("o_orderkey", F.col("bbox")[0].alias("x1"), F.col("bbox")[3].alias("y2"), F.col("point")[0].alias("cx"), F.col("point")[1].alias("cy"), F.col("quad")[2].alias("corner"))


@query(f"""WITH a AS (SELECT p_type, p_partkey % 5 AS way, p_size, {_LETTER} AS gold FROM part)
SELECT p_type, count(*) AS n, round(avg(CASE way WHEN 0 THEN 1.0 WHEN 1 THEN CASE WHEN gold = 'B' THEN 1.0 ELSE 0 END WHEN 2 THEN 1.0 WHEN 3 THEN 1.0 ELSE 0 END), 6) AS acc FROM a GROUP BY p_type""")
def discipline_accuracy(spark, sf_dir):
    """Letters, contents and numbers as answers to questions with choices and to open ones."""
    way, gold = F.col("p_partkey") % 5, F.substr(F.lit("ABCD"), (F.col("p_size") % 4 + 1).cast("int"), F.lit(1))
    contents = F.array(*[F.concat(F.lit(f"the {n} part "), "p_name") for n in ("first", "second", "third", "fourth")])
    told = F.get(contents, (F.col("p_size") % 4).cast("int"))
    amount = F.format_number(F.col("p_size") * 1000 + 0.5, 2)
    said = (
        F.when(way == 0, F.concat(F.lit("Not (A) or (D), but ("), gold, F.lit(").")))
        .when(way == 1, F.lit("B."))
        .when(way == 2, F.concat(F.lit("I would say that it must have been "), F.initcap(told), F.lit("!")))
        .when(way == 3, F.concat(F.lit("we add\nthus the total = "), amount))
    )
    labels = F.when(way == 3, F.array((F.col("p_size") * 1000 + 0.5).cast("string"))).otherwise(F.array(gold))
    rows = table(spark, sf_dir, "part").select("p_type", said.alias("said"), labels.alias("labels"), F.when(way < 3, contents).alias("contents"), F.when(way == 3, "open-ended").alias("kind"))
    none = F.lit(None).cast("array<string>")
    score = open_answers.discipline_accuracy(F.col("said"), F.col("labels"), none, F.col("contents"), F.col("kind"))
    return rows.select("p_type", score.alias("s")).groupBy("p_type").agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("acc"))


def _any(name: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({name}), '{p}')" for p in parts) + ")"


_STATED = "CASE page_id % 6 WHEN 0 THEN 'Audio ' WHEN 1 THEN 'video' WHEN 2 THEN 'vision' WHEN 3 THEN 'text' END"


@query(f"""WITH p AS (SELECT page_id, coalesce(url, '') AS url, {_STATED} AS stated FROM pages)
SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'audio' WHEN page_id % 6 = 1 THEN 'video' WHEN {_any("url", benchmarks.AUDIO)} THEN 'audio' WHEN {_any("url", benchmarks.VIDEO)} THEN 'video'
WHEN {_any("url", benchmarks.IMAGE)} OR page_id % 6 = 2 THEN 'image' ELSE 'text' END AS modality,
CASE page_id % 6 WHEN 0 THEN FALSE WHEN 1 THEN TRUE WHEN 2 THEN TRUE WHEN 3 THEN FALSE ELSE {_any("url", benchmarks.ASKED_VISION)} END AS vision FROM p""")
def benchmark_modality(spark, sf_dir):
    """Kinds of names, some with a stated kind."""
    stated = F.element_at(F.array(F.lit("Audio "), F.lit("video"), F.lit("vision"), F.lit("text"), F.lit(None), F.lit(None)), (F.col("page_id") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", "url", stated.alias("stated"))
    return rows.select("page_id", benchmarks.modality(F.col("url"), F.col("stated")).alias("modality"), benchmarks.asked_for(["Vision"], F.col("url"), F.trim("stated")).alias("vision"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(source, '') AS question, coalesce(text, '') AS model_prediction, coalesce(lang, '') AS answer, '' AS choices, '' AS task, '' AS difficulty FROM documents")
def submission_audio(spark, sf_dir):
    meta = F.map_from_arrays(F.array(F.lit("question"), F.lit("answer")), F.array("source", "lang"))
    return sub.submission("mmau_test", table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prediction"), meta.alias("meta")), "doc_id")
