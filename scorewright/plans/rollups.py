"""Queries of benchmark roll-ups and record shaping, added to the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewright.functions import records as rec
from scorewright.operators import leaderboard as lb, rollup
from scorewright.plans.registry import query
from scorewright.plans.views import CHOICES, JUDGED, REC, RUNS, choices, judged, records, runs, table


@query("WITH s AS (SELECT l_orderkey, l_linenumber % 3 AS sample, bool_and(l_quantity > 10) AS ok FROM lineitem GROUP BY 1, 2), p AS (SELECT l_orderkey, bool_or(ok) AS ok FROM s GROUP BY 1) SELECT l_orderkey % 10 AS part, count(*) AS problems, round(avg(CASE WHEN ok THEN 1.0 ELSE 0 END), 6) AS pass_at_1 FROM p GROUP BY 1")
def pass_at_one_any(spark, sf_dir):
    tests = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("sample"), "l_quantity")
    passed = rollup.passes(tests, ["l_orderkey"], ["sample"], F.col("l_quantity") > 10)
    return passed.groupBy((F.col("l_orderkey") % 10).alias("part")).agg(F.count("*").alias("problems"), F.round(F.avg(F.col("passed").cast("int")), 6).alias("pass_at_1"))


@query("""WITH p AS (SELECT l_orderkey, coalesce(bool_or(CASE WHEN l_linenumber = 1 THEN l_quantity > 15 END), false) AS m, coalesce(bool_and(CASE WHEN l_linenumber <> 1 THEN l_quantity > 15 END), true) AS a, coalesce(bool_or(CASE WHEN l_linenumber <> 1 THEN l_quantity > 15 END), true) AS o FROM lineitem GROUP BY 1)
SELECT l_orderkey % 5 AS part, count(*) AS n, round(avg(CASE WHEN m AND a THEN 1.0 WHEN NOT m AND a THEN 0.5 ELSE 0 END), 6) AS strict, round(avg(CASE WHEN m AND (a OR o) THEN 1.0 WHEN NOT m AND a THEN 0.5 ELSE 0 END), 6) AS loose FROM p GROUP BY 1""")
def multi_step_consistency(spark, sf_dir):
    steps = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    problems = rollup.step_consistency(steps, ["l_orderkey"], F.col("l_linenumber") == 1, F.col("l_quantity") > 15).withColumn("part", F.col("l_orderkey") % 5)
    return rollup.consistency_scores(problems, "part").select("part", "n", F.round("strict", 6).alias("strict"), F.round("loose", 6).alias("loose"))


@query("WITH o AS (SELECT event_id // 4 AS doc, event_id % 4 AS opt, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS ppl FROM events), b AS (SELECT doc, arg_min(opt, (coalesce(ppl, 100.0), opt)) AS opt FROM o GROUP BY doc) SELECT opt, count(*) AS n, CAST(sum(CASE WHEN opt = doc % 4 THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM b GROUP BY opt")
def option_likelihood(spark, sf_dir):
    ppl = F.when(F.col("event_id") % 9 != 0, F.col("value"))
    options = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 4).alias("doc"), (F.col("event_id") % 4).alias("opt"), ppl.alias("ppl"))
    best = rollup.likeliest_option(options, ["doc"], "opt", "ppl")
    return best.groupBy("opt").agg(F.count("*").alias("n"), F.count_if(F.col("opt") == F.col("doc") % 4).alias("hits"))


@query("SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) GROUP BY lang")
def resume_filter(spark, sf_dir):
    return rollup.remaining(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"))


@query(f"WITH {JUDGED} SELECT category, count(*) AS n, round(avg(quality), 6) AS quality FROM (SELECT lang AS category, quality FROM judged UNION ALL SELECT source, quality FROM judged) WHERE category IS NOT NULL GROUP BY category")
def category_fan_out(spark, sf_dir):
    out = rollup.fan_out(judged(spark, sf_dir), F.array("lang", "source"))
    return out.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"))


@query("SELECT p_partkey, 'A,B,C' AS letters, p_brand || '|' || p_type || '|none of it' AS contents FROM part")
def options_inline(spark, sf_dir):
    text = F.concat(F.lit("Pick one.\nOptions: A: "), "p_brand", F.lit("\nB: "), "p_type", F.lit("  C: none  of it "))
    parsed = table(spark, sf_dir, "part").select("p_partkey", rec.inline_options(text).alias("o"))
    return parsed.select("p_partkey", F.array_join("o.letter", ",").alias("letters"), F.array_join("o.content", "|").alias("contents"))


@query("SELECT p_partkey, regexp_replace(replace(replace(p_type || '/v1.' || p_brand, '.', '_'), '/', '__'), '\\s+', '_', 'g') AS name FROM part")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", rec.safe_name(F.concat("p_type", F.lit("/v1."), "p_brand")).alias("name"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open: say why' WHEN 'F' THEN 'done' END AS prompt FROM orders")
def conditional_prompt(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", rec.conditional({"O": "open: say why", "F": "done"}, F.col("o_orderstatus")).alias("prompt"))


@query("SELECT o_orderkey, round(coalesce(rt, lat * n), 6) AS runtime_inference, round(least(greatest(o_totalprice / 262144, 0.0), 1.0), 6) AS coverage, round(lat * n, 6) AS benchmark_time, round(CASE WHEN coalesce(rt, lat * n) > 0 THEN n / coalesce(rt, lat * n) END, 6) AS throughput FROM (SELECT *, (o_custkey % 10) / CAST(8 AS DOUBLE) AS lat, o_orderkey % 100 AS n, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS rt FROM orders)")
def run_figures(spark, sf_dir):
    latency, runtime = (F.col("o_custkey") % 10) / F.lit(8.0), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice"))
    figures = rec.run_figures(latency, F.col("o_orderkey") % 100, runtime, F.col("o_totalprice") / 262144)
    return table(spark, sf_dir, "orders").select("o_orderkey", *[F.round(c, 6).alias(k) for k, c in figures.items()])


@query(f"WITH {CHOICES} SELECT gold, count(*) AS n, count(CASE WHEN p_partkey % 4 <> 3 THEN gold END) AS found, round(avg(CASE WHEN p_partkey % 4 <> 3 THEN 1.0 ELSE 0 END), 6) AS acc FROM choices GROUP BY gold")
def choice_letter_accuracy(spark, sf_dir):
    e = choices(spark, sf_dir).select("gold", rec.choice_letter(F.col("answer")).alias("letter"))
    return e.groupBy("gold").agg(F.count("*").alias("n"), F.count("letter").alias("found"), F.round(F.avg(F.coalesce(F.col("letter") == F.col("gold"), F.lit(False)).cast("int")), 6).alias("acc"))


@query(f"WITH {REC} SELECT doc_id, array_to_string(list_slice(list_concat(regexp_extract_all(prediction, '[A-Z]'), ['', '', '']), 1, 3), ',') AS letters FROM rec")
def composite_letters(spark, sf_dir):
    return records(spark, sf_dir).select("doc_id", F.array_join(rec.capital_letters(F.col("prediction"), 3), ",").alias("letters"))


@query(f"WITH {JUDGED} SELECT source, round(avg((doc_id % 6) / CAST(doc_id % 4 + 1 AS DOUBLE)), 6) AS ratio FROM judged GROUP BY source")
def checklist_ratio(spark, sf_dir):
    text = F.concat(F.lit("First 1/2, then overall score: "), F.col("doc_id") % 6, F.lit(" / "), F.col("doc_id") % 4 + 1)
    return judged(spark, sf_dir).groupBy("source").agg(F.round(F.avg(rec.score_ratio(text)), 6).alias("ratio"))


@query(f"WITH {RUNS} SELECT benchmark, round(avg(CASE WHEN value <= 1 THEN value * 100 WHEN value <= 100 THEN value WHEN value <= 1000 THEN value / 10 ELSE value END), 6) AS score FROM runs GROUP BY benchmark")
def leaderboard_rescale(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("benchmark").agg(F.round(F.avg(lb.rescale(F.col("value"))), 6).alias("score"))


@query(r"WITH w AS (SELECT item_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM (SELECT item_id, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS text FROM benchmark)) SELECT item_id, CASE WHEN len(w) > 20 THEN array_to_string(w[1:14], ' ') || ' ... ' || array_to_string(w[-6:], ' ') ELSE text END AS text FROM w")
def prompt_budget(spark, sf_dir):
    text = F.regexp_replace("text", r"[^\x00-\x7F]", "")
    return table(spark, sf_dir, "benchmark").select("item_id", rec.within_budget(text, 20).alias("text"))
