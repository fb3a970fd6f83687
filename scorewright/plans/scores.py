"""Queries of grounding, OCR and mathematical answers, repetition, CIDEr over four orders, and roll-ups of scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewright.functions import metrics as m, scores as s
from scorewright.operators import scores as op
from scorewright.plans.registry import query
from scorewright.plans.views import JUDGED, RUNS, judged, runs, short_batches, table, whole_records


def _iou_sql(x1: str, y1: str, x2: str, y2: str) -> str:
    inter = f"greatest(0.0, least({x2}, 0.6) - greatest({x1}, 0.1)) * greatest(0.0, least({y2}, 0.7) - greatest({y1}, 0.1))"
    return f"{inter} / (0.3 + ({x2} - {x1}) * ({y2} - {y1}) - {inter})"


@query(f"""WITH b AS (SELECT p_partkey, CAST(p_size % 40 AS DOUBLE) AS x, CAST(p_partkey % 30 AS DOUBLE) AS y FROM part),
c AS (SELECT p_partkey, CASE WHEN x <= 1 THEN x ELSE x / 100 END AS x1, CASE WHEN y <= 1 THEN y ELSE y / 80 END AS y1, (x + 50) / 100 AS x2, (y + 40) / 80 AS y2 FROM b),
d AS (SELECT *, (y1 * 80 + 10) / 100 AS p1, (y2 * 80 + 10) / 100 AS p2 FROM c)
SELECT p_partkey, round({_iou_sql("x1", "y1", "x2", "y2")}, 6) AS iou, {_iou_sql("x1", "y1", "x2", "y2")} > 0.5 AS over_half, round({_iou_sql("x1", "p1", "x2", "p2")}, 6) AS padded_iou FROM d""")
def grounding_iou(spark, sf_dir):
    """Boxes read from text, pixel axes scaled by a picture of 100 x 80, also within its padded square."""
    x, y = F.col("p_size") % 40, F.col("p_partkey") % 30
    text = F.format_string("[%d, %d, %d, %d]", x.cast("int"), y.cast("int"), (x + 50).cast("int"), (y + 40).cast("int"))
    w, h = F.lit(100), F.lit(80)
    rows = table(spark, sf_dir, "part").select("p_partkey", s.parsed_box(F.lit("[0.1, 0.1, 0.6, 0.7]")).alias("label"), s.scaled_box(s.parsed_box(text), w, h).alias("box"))
    iou, padded = m.box_iou(F.col("label"), F.col("box")), m.box_iou(F.col("label"), s.padded_box(F.col("box"), w, h))
    return rows.select("p_partkey", F.round(iou, 6).alias("iou"), (iou > 0.5).alias("over_half"), F.round(padded, 6).alias("padded_iou"))


@query(r"""WITH r AS (SELECT p_partkey, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' made of ' || p_type ELSE '' END AS label, CASE p_partkey % 2 WHEN 0 THEN 'It says ' || p_name ELSE p_type END AS answer FROM part),
n AS (SELECT *, len(list_filter(string_split_regex(label, '\s+'), lambda w: w <> '')) AS words, 1 - levenshtein(label, answer) / greatest(length(label), length(answer)) AS close FROM r)
SELECT p_partkey, round(CASE WHEN words < 5 THEN CAST(contains(answer, label) AS DOUBLE) WHEN close >= 0.5 THEN close ELSE 0 END, 6) AS score FROM n""")
def ocr_answer_score(spark, sf_dir):
    label = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" made of "), "p_type")).otherwise(""))
    answer = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("It says "), "p_name")).otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(s.ocr_answer(F.array(label), answer), 6).alias("score"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN 0.0 ELSE 1.0 END AS equal FROM part")
def math_equality(spark, sf_dir):
    """Answers boxed, as a fraction, with decimals and bare; every fifth is none."""
    n = F.col("p_size").cast("string")
    forms = F.array(F.concat(F.lit("\\boxed{"), n, F.lit("}")), F.concat(F.lit("$\\frac{"), (2 * F.col("p_size")).cast("string"), F.lit("}{2}$")), F.concat(n, F.lit(".0")), n, F.lit("no idea"))
    return table(spark, sf_dir, "part").select("p_partkey", s.math_equal(n, F.get(forms, (F.col("p_partkey") % 5).cast("int"))).alias("equal"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS words FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(words))) AS pos, unnest(list_zip(words[:-2], words[2:])) AS gram FROM w WHERE len(words) > 1),
m AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
k AS (SELECT doc_id, count(DISTINCT word) AS marked FROM (SELECT doc_id, unnest([pos, pos + 1]) AS word FROM m WHERE n > 1) GROUP BY doc_id)
SELECT w.doc_id, round(coalesce(100.0 * marked / nullif(len(words), 0), 0), 6) AS share FROM w LEFT JOIN k ON w.doc_id = k.doc_id""")
def repeated_bigram_share(spark, sf_dir):
    return op.repeated_bigrams(table(spark, sf_dir, "documents"), "doc_id", F.col("text")).withColumn("share", F.round("share", 6))


@query()
def trailing_repetition(spark, sf_dir):
    short_batches(spark)
    return table(spark, sf_dir, "documents").select("doc_id", s.trailing_repeat("text").alias("words"))


@query()
def cider_four_orders(spark, sf_dir):
    scores = op.cider_orders(whole_records(spark, sf_dir), "doc_id", F.col("prediction"), F.col("labels")[1])
    return scores.select("doc_id", F.round("cider", 6).alias("cider"))


@query(f"""WITH {JUDGED}, r AS (SELECT CASE WHEN source = 'TP' OR n_chars % 3 = 0 THEN 'TN' ELSE 'CW' END AS kind, least(n_chars, 1000) / 1000.0 AS s FROM judged),
f AS (SELECT kind, s, CASE WHEN s >= 0.9 THEN s ELSE s * 0.1 END AS h FROM r)
SELECT kind, count(*) AS n, round(100 * avg(s), 6) AS wups, round(100 * avg(h), 6) AS wups_high FROM f GROUP BY kind
UNION ALL SELECT 'all', count(*), round(100 * avg(s), 6), round(100 * avg(h), 6) FROM f""")
def wups_by_type(spark, sf_dir):
    rows = judged(spark, sf_dir).select(F.when(F.col("n_chars") % 3 == 0, "TP").otherwise("CW").alias("type"), (F.least("n_chars", F.lit(1000)) / 1000.0).alias("s"))
    out = op.wups_rollup(rows, "type", "s")
    return out.select("kind", "n", F.round("wups", 6).alias("wups"), F.round("wups_high", 6).alias("wups_high"))


@query(f"WITH {JUDGED} SELECT round(coalesce(sum(CASE WHEN toxic = 0 THEN quality * 5 END) / nullif(count(*), 0), 0), 6) AS score, count(*) AS n FROM judged")
def judge_score_mean(spark, sf_dir):
    return op.score_mean(judged(spark, sf_dir), F.when(F.col("toxic") == 0, F.col("quality") * 5)).withColumn("score", F.round("score", 6))


@query("SELECT conv_id, rtrim(coalesce(string_agg(CASE WHEN turn % 3 <> 1 AND role <> 'system' THEN text END, chr(10) ORDER BY turn), ''), ' ') AS query FROM conversations GROUP BY conv_id")
def message_query_text(spark, sf_dir):
    """Text contents of a message without those of the skipped prefix."""
    kind = F.when(F.col("turn") % 3 == 1, "image").otherwise("text")
    value = F.when(F.col("role") == "system", F.concat(F.lit("OCR: "), "text")).otherwise(F.col("text"))
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", kind.alias("kind"), value.alias("value")))).alias("contents"))
    return grouped.select("conv_id", s.query_text(F.col("contents"), ("OCR: ",)).alias("query"))


@query(f"WITH {RUNS}, a AS (SELECT model, benchmark, max(CASE WHEN run_index = 1 AND event_id % 2 = 0 AND model <> 'm3' THEN value END) AS best FROM runs GROUP BY 1, 2) SELECT model, benchmark, round(best, 6) AS best FROM a ORDER BY best ASC NULLS FIRST, model, benchmark LIMIT 12")
def column_sort(spark, sf_dir):
    best = F.max(F.when((F.col("run_index") == 1) & (F.col("event_id") % 2 == 0) & (F.col("model") != "m3"), F.col("value")))
    rows = runs(spark, sf_dir).groupBy("model", "benchmark").agg(best.alias("best"))
    return op.sorted_by(op.sorted_by(rows, "absent", True, []), "best", False, [F.col("model"), F.col("benchmark")]).limit(12).withColumn("best", F.round("best", 6))
