"""Queries over the test tables, each with its equivalent in SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scorewright.functions import checks, extract, metrics as m, text as t
from scorewright.operators import aggregate as agg, dataset as ds, leaderboard as lb, submission as sub
from scorewright.plans.views import CHOICES, JUDGED, REC, RUNS, choices, judged, records, runs, short_batches, table, whole_records
from scorewright.streaming import live

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def by_category(df: DataFrame, **named: Column) -> DataFrame:
    """Rounded means by category; a sample without labels has no metric."""
    scored = df.select("category", *[m.eligible(F.col("labels"), c).alias(k) for k, c in named.items()])
    out = agg.group_means(scored, F.col("category"), list(named))
    return out.select("category", "num_samples", *[F.round(k, 6).alias(k) for k in named])


# Parts of the SQL side: text helpers over a column expression.
def _squad(x: str) -> str:
    # Articles go in two passes, as a match takes the character on either side along.
    plain, article = rf"regexp_replace(lower({x}), '[!-/:-@\[-`{{-~]', '', 'g')", r"'(^|[^\p{L}\p{N}_])(a|an|the)($|[^\p{L}\p{N}_])', '\1 \3', 'g'"
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({plain}, {article}), {article}), '\s+', ' ', 'g'))"


def _toks(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


def _means(columns: dict[str, str], start: str = REC) -> str:
    return f"WITH {start} SELECT category, count(*) AS num_samples, {', '.join(f'round(avg({v}), 6) AS {k}' for k, v in columns.items())} FROM rec GROUP BY category"


_NUMBER = r"'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$'"
_EXACT = "list_max(list_transform(labels, lambda l: CAST(replace(trim(lower(l)), '.', '') = replace(trim(lower(prediction)), '.', '') AS DOUBLE)))"


# --- per-sample metrics


@query(_means({"exact_match": _EXACT}))
def exact_match_by_category(spark, sf_dir):
    return by_category(records(spark, sf_dir), exact_match=m.exact_match(F.col("labels"), F.col("prediction")))


@query(_means({"string_match": "list_max(list_transform(labels, lambda l: CAST(contains(replace(trim(prediction), chr(10), ' '), replace(trim(l), chr(10), ' ')) AS DOUBLE)))"}))
def string_match_by_category(spark, sf_dir):
    return by_category(records(spark, sf_dir), string_match=m.string_match(F.col("labels"), F.col("prediction")))


def _fenced(x: str) -> str:
    return rf"' ' || array_to_string(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}\p{{M}}]+|\S'), ' ') || ' '"


@query(_means({"substring_match": f"list_max(list_transform(labels, lambda l: CAST(contains({_fenced('prediction')}, {_fenced('l')}) AS DOUBLE)))"}))
def substring_match_by_category(spark, sf_dir):
    return by_category(records(spark, sf_dir), substring_match=m.substring_match(F.col("labels"), F.col("prediction")))


_F1 = f"""WITH {REC}, tk AS (SELECT category, {_toks(_squad('prediction'))} AS p, unnest(list_transform(labels, lambda l: {_toks(_squad('l'))})) AS l, doc_id FROM rec),
o AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(l, lambda y: y = x))))), 0) AS n FROM tk),
s AS (SELECT doc_id, category, max(CASE WHEN len(p) = 0 THEN 0.0 ELSE n / CAST(len(p) AS DOUBLE) END) AS pr, max(CASE WHEN len(l) = 0 THEN 1.0 ELSE n / CAST(len(l) AS DOUBLE) END) AS re,
  max(CASE WHEN len(p) = 0 AND len(l) = 0 THEN 1.0 WHEN n = 0 THEN 0.0 ELSE 2.0 * n / (len(p) + len(l)) END) AS f FROM o GROUP BY doc_id, category)
SELECT category, count(*) AS num_samples, round(avg(pr), 6) AS "precision", round(avg(re), 6) AS recall, round(avg(f), 6) AS f1 FROM s GROUP BY category"""


@query(_F1)
def token_f1_by_category(spark, sf_dir):
    plain = F.transform("labels", t.squad_normalize)
    scored = records(spark, sf_dir, even=True).withColumn("o", t.gram_overlaps(plain, t.squad_normalize(F.col("prediction")), F.lit(1))).withColumn("s", m.token_prf(F.col("o")))
    return by_category(scored, precision=m.best_field(F.col("s"), "p"), recall=m.best_field(F.col("s"), "r"), f1=m.best_field(F.col("s"), "f"))


@query()
def ned_anls_by_category(spark, sf_dir):
    """Whole documents; no SQL, as its distance is quadratic in their lengths."""
    longest = lambda x: F.greatest(F.char_length(x), F.char_length("prediction"))
    df = records(spark, sf_dir, even=True).withColumn("e", t.char_edits(F.transform("labels", F.lower), F.lower("prediction")))
    d = F.array_min(F.zip_with("e", "labels", lambda e, x: F.when(longest(x) == 0, F.lit(0.0)).otherwise(e / longest(x))))
    df = df.withColumn("d", d)
    return by_category(df, ned=F.col("d"), anls=F.when(F.col("d") < 0.5, 1 - F.col("d")).otherwise(0.0))


@query()
def cer_corpus(spark, sf_dir):
    """Character error rate of whole documents: each record's best reference, summed over the corpus."""
    labels = F.filter("labels", lambda x: x != "")
    rows = records(spark, sf_dir, even=True).withColumn("l", labels).where(F.size("l") > 0).withColumn("e", t.char_edits("l", "prediction"))
    best = F.array_min(F.zip_with("e", "l", lambda e, x: F.struct((e / F.char_length(x)).alias("rate"), F.char_length(x).alias("n"), e.alias("d"))))
    best = rows.select("category", best.alias("b"))
    return best.groupBy("category").agg(F.sum("b.d").cast("long").alias("edits"), F.sum("b.n").cast("long").alias("chars")).withColumn("cer", F.round(F.col("edits") / F.col("chars"), 6))


def _jaccard_sql() -> str:
    """Lists of n-grams are made once a text, as columns of their own."""
    two = lambda x: f"list_distinct(list_transform(range(1, len({x})), lambda i: {x}[i] || ' ' || {x}[i + 1]))"
    score = lambda n: f"min(CASE WHEN len(a{n}) + len(b{n}) = 0 THEN 1.0 ELSE 1 - len(list_intersect(a{n}, b{n})) / CAST(len(a{n}) + len(b{n}) - len(list_intersect(a{n}, b{n})) AS DOUBLE) END) AS j{n}"
    return f"""WITH {REC}, w AS (SELECT doc_id, category, string_split(prediction, ' ') AS p, string_split(unnest(labels), ' ') AS l FROM rec),
g AS (SELECT doc_id, category, list_distinct(p) AS a1, list_distinct(l) AS b1, {two('p')} AS a2, {two('l')} AS b2 FROM w),
s AS (SELECT doc_id, category, {score(1)}, {score(2)} FROM g GROUP BY doc_id, category)
SELECT category, count(*) AS num_samples, round(avg(j1), 6) AS jaccard_1, round(avg(j2), 6) AS jaccard_2 FROM s GROUP BY category"""


@query(_jaccard_sql())
def jaccard_uni_bi(spark, sf_dir):
    labels, prediction = F.col("labels"), F.col("prediction")
    rows = records(spark, sf_dir, even=True).withColumn("o", t.set_overlaps(labels, prediction, F.lit(2)))
    return by_category(rows, jaccard_1=m.jaccard_distance(labels, prediction, 1, F.col("o")), jaccard_2=m.jaccard_distance(labels, prediction, 2, F.col("o")))


@query(_means({"vqa": f"least(1.0, len(list_filter(labels, lambda l: {_squad('l')} = {_squad('prediction')})) / 3.0)"}))
def vqa_score(spark, sf_dir):
    return by_category(records(spark, sf_dir), vqa=m.vqa_score(F.col("labels"), F.col("prediction")))


@query(f"WITH {REC}, w AS (SELECT category, {_toks('prediction')} AS t FROM rec), g AS (SELECT category, CASE WHEN len(t) < 2 THEN [] ELSE list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) END AS g FROM w) SELECT category, count(*) AS num_samples, round(avg(CASE WHEN len(g) = 0 THEN 0.0 ELSE 1 - len(list_distinct(g)) / CAST(len(g) AS DOUBLE) END), 6) AS rep_2 FROM g GROUP BY category")
def repetition_bigrams(spark, sf_dir):
    return by_category(records(spark, sf_dir), rep_2=m.repetition_n(F.col("prediction"), 2))


@query()
def repetition_window_share(spark, sf_dir):
    df = whole_records(spark, sf_dir).withColumn("w", m.repetition_window(F.col("prediction")))
    return by_category(df, rep_w=F.col("w"))


@query("SELECT l_returnflag, count(*) AS n, round(avg(CASE WHEN u > 0 THEN i / u ELSE 0 END), 6) AS iou, CAST(sum(CASE WHEN u > 0 AND i / u > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM (SELECT l_returnflag, greatest(0, least(x + 20, y + 25) - greatest(x, y)) * 10.0 AS i, 20 * 10 + 25 * 10 - greatest(0, least(x + 20, y + 25) - greatest(x, y)) * 10.0 AS u FROM (SELECT l_returnflag, CAST(l_linenumber AS DOUBLE) AS x, l_quantity AS y FROM lineitem)) GROUP BY l_returnflag")
def bbox_iou(spark, sf_dir):
    x, y = F.col("l_linenumber").cast("double"), F.col("l_quantity")
    iou = m.box_iou(F.array(x, F.lit(0.0), x + 20, F.lit(10.0)), F.array(y, F.lit(0.0), y + 25, F.lit(10.0)))
    return table(spark, sf_dir, "lineitem").select("l_returnflag", iou.alias("iou")).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("iou"), 6).alias("iou"), F.count_if(F.col("iou") > 0.5).alias("hits"))


@query("SELECT l_linestatus, count(*) AS n, CAST(sum(CASE WHEN sqrt(power((l_quantity - (l_linenumber * 5 + l_linenumber * 5 + 10) / 2.0) / 60.0, 2) + power((10.0 - 12.0) / 60.0, 2)) <= 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM lineitem GROUP BY l_linestatus")
def click_distance(spark, sf_dir):
    x = F.col("l_linenumber") * 5
    hit = m.click_accuracy(F.array(F.col("l_quantity"), F.lit(10.0)), F.array(x.cast("double"), F.lit(7.0), (x + 10).cast("double"), F.lit(17.0)), F.lit(60.0), F.lit(60.0))
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.count("*").alias("n"), F.sum(hit).cast("long").alias("hits"))


_IV = "SELECT o_orderstatus, CASE WHEN greatest(e1, e2) - least(s1, s2) > 0 THEN greatest(0, least(e1, e2) - greatest(s1, s2)) / (greatest(e1, e2) - least(s1, s2)) ELSE 0 END AS iou FROM (SELECT o_orderstatus, CAST(o_custkey % 100 AS DOUBLE) AS s1, CAST(o_custkey % 100 + o_orderkey % 50 + 1 AS DOUBLE) AS e1, CAST(o_orderkey % 100 AS DOUBLE) AS s2, CAST(o_orderkey % 100 + 30 AS DOUBLE) AS e2 FROM orders)"


@query(f"SELECT o_orderstatus, round(avg(iou), 6) AS iou, CAST(sum(CASE WHEN iou >= 0.3 THEN 1 ELSE 0 END) AS BIGINT) AS r3, CAST(sum(CASE WHEN iou >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS r5, CAST(sum(CASE WHEN iou >= 0.7 THEN 1 ELSE 0 END) AS BIGINT) AS r7 FROM ({_IV}) GROUP BY o_orderstatus")
def temporal_iou_recall(spark, sf_dir):
    s1, s2 = (F.col("o_custkey") % 100).cast("double"), (F.col("o_orderkey") % 100).cast("double")
    iou = m.interval_iou(s1, s1 + F.col("o_orderkey") % 50 + 1, s2, s2 + 30)
    scored = table(spark, sf_dir, "orders").select("o_orderstatus", iou.alias("iou"))
    return scored.groupBy("o_orderstatus").agg(F.round(F.avg("iou"), 6).alias("iou"), *[F.count_if(F.col("iou") >= x / 10).alias(f"r{x}") for x in (3, 5, 7)])


@query()
def denotation_and_figures(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_brand", F.concat_ws("|", "p_size", "p_brand").alias("a"), F.concat_ws("|", "p_brand", F.concat(F.col("p_size"), F.lit(".0"))).alias("b"), F.concat(F.lit("$"), F.col("p_size"), F.lit(" thousand")).alias("c"), (F.col("p_size") * 1000).cast("string").alias("d"))
    return df.groupBy("p_brand").agg(F.avg(m.denotation_match(F.col("a"), F.col("b"))).alias("denotation"), F.avg(m.figure_match(F.col("c"), F.col("d"))).alias("figures"))


@query()
def option_words(spark, sf_dir):
    options = F.array(F.lit("polished steel"), F.lit("small brass"), F.lit("large tin"))
    df = table(spark, sf_dir, "part").select(F.lower("p_type").alias("kind"))
    return df.groupBy("kind").agg(F.avg(m.option_words_match(F.lit("polished steel"), F.col("kind"), options)).alias("mmau"))


# --- corpus metrics


@query()
def word_error_rate(spark, sf_dir):
    df = whole_records(spark, sf_dir).select("category", F.col("labels")[1].alias("l"), "prediction")
    edits = df.select("category", t.word_edits("l", "prediction").alias("e"), F.size(t.tokens(F.col("l"))).alias("n"))
    return edits.groupBy("category").agg(F.sum("e").alias("edits"), F.sum("n").alias("words")).withColumn("wer", F.round(F.col("edits") / F.col("words"), 6))


@query()
def rouge_l_by_category(spark, sf_dir):
    df = whole_records(spark, sf_dir).select("category", t.squad_normalize(F.col("labels")[0]).alias("l"), t.squad_normalize(F.col("prediction")).alias("p"))
    df = df.withColumn("c", t.common_subsequence("l", "p"))
    both = F.size(t.tokens(F.col("l"))) + F.size(t.tokens(F.col("p")))
    return df.groupBy("category").agg(F.round(F.avg(F.when(both > 0, 2 * F.col("c") / both).otherwise(0.0)), 6).alias("rouge_l"))


def _gram_sql(x: str, n: int) -> str:
    joined = " || ' ' || ".join(f"{x}[i + {k}]" if k else f"{x}[i]" for k in range(n))
    return f"CASE WHEN len({x}) < {n} THEN [] ELSE list_transform(range(1, len({x}) - {n - 2}), lambda i: {joined}) END"


_BLEU = f"WITH {REC}, tk AS (SELECT {_toks('lower(prediction)')} AS p, {_toks('lower(labels[2])')} AS r FROM rec), g AS (SELECT len(p) AS c, len(r) AS l, " + ", ".join(f"{_gram_sql('p', n)} AS p{n}, {_gram_sql('r', n)} AS r{n}" for n in (1, 2, 3, 4)) + " FROM tk), s AS (SELECT sum(c) AS c, sum(l) AS l, " + ", ".join(f"CAST(sum(coalesce(list_sum(list_transform(list_distinct(p{n}), lambda x: least(len(list_filter(p{n}, lambda y: y = x)), len(list_filter(r{n}, lambda y: y = x))))), 0)) AS BIGINT) AS m{n}, CAST(sum(len(p{n})) AS BIGINT) AS t{n}" for n in (1, 2, 3, 4)) + " FROM g) SELECT m1, m2, m3, m4, t1, t2, t3, t4, round(CASE WHEN c > l THEN 1 ELSE exp(1 - l / CAST(c AS DOUBLE)) END * exp((ln(m1 / CAST(t1 AS DOUBLE)) + ln(m2 / CAST(t2 AS DOUBLE)) + ln(m3 / CAST(t3 AS DOUBLE)) + ln(m4 / CAST(t4 AS DOUBLE))) / 4), 6) AS bleu FROM s"


@query(_BLEU)
def bleu_corpus(spark, sf_dir):
    out = agg.bleu(records(spark, sf_dir, even=True), F.col("prediction"), F.col("labels")[1])
    return out.withColumn("bleu", F.round("bleu", 6))


@query()
def cider_by_category(spark, sf_dir):
    df = whole_records(spark, sf_dir)
    scores = agg.cider(df, "doc_id", F.col("prediction"), F.col("labels")[1])
    return df.join(scores, "doc_id").groupBy("category").agg(F.round(F.avg("cider"), 6).alias("cider"))


def _rouge_sql(n: int) -> str:
    p, r = f"p{n}", f"r{n}"
    shared = f"coalesce(list_sum(list_transform(list_distinct({p}), lambda x: least(len(list_filter({p}, lambda y: y = x)), len(list_filter({r}, lambda y: y = x))))), 0)"
    return f"round(avg(CASE WHEN len({p}) + len({r}) = 0 THEN 0.0 ELSE 2.0 * {shared} / (len({p}) + len({r})) END), 6) AS rouge_{n}"


@query(f"WITH {REC}, tk AS (SELECT category, {_toks(_squad('prediction'))} AS p, {_toks(_squad('labels[2]'))} AS r FROM rec), g AS (SELECT category, " + ", ".join(f"{_gram_sql('p', n)} AS p{n}, {_gram_sql('r', n)} AS r{n}" for n in (1, 2)) + f" FROM tk) SELECT category, {_rouge_sql(1)}, {_rouge_sql(2)} FROM g GROUP BY category")
def rouge_1_2(spark, sf_dir):
    """F-measures of unigram and bigram overlap with the second label."""
    df = records(spark, sf_dir).select("category", t.gram_overlaps(F.array(t.squad_normalize(F.col("labels")[1])), t.squad_normalize(F.col("prediction")), F.lit(2))[0].alias("x"))

    def rouge(n: int) -> Column:
        shared, label, own = (F.col("x")[3 * (n - 1) + k] for k in range(3))
        return F.round(F.avg(F.when(label + own == 0, 0.0).otherwise(2.0 * shared / (label + own))), 6).alias(f"rouge_{n}")

    return df.groupBy("category").agg(rouge(1), rouge(2))


@query()
def mixed_error_rate(spark, sf_dir):
    """Word error rate in percent after Hangul syllables are set apart, at most 100."""
    spaced = lambda x: F.regexp_replace(x, r"([\x{AC00}-\x{D7A3}])", " $1 ")
    df = whole_records(spark, sf_dir).select("category", spaced(F.col("labels")[1]).alias("l"), spaced(F.col("prediction")).alias("p"))
    df = df.select("category", t.word_edits("l", "p").alias("e"), F.size(t.tokens(F.col("l"))).alias("n"))
    return df.groupBy("category").agg(F.round(F.avg(F.least(F.lit(100.0), F.when(F.col("n") > 0, 100 * F.col("e") / F.col("n")).otherwise(100.0))), 6).alias("mer"))


@query(f"WITH {JUDGED}, c AS (SELECT count(*) FILTER (n_chars > 1000 AND quality = 1) AS tp, count(*) FILTER (n_chars > 1000 AND quality = 0) AS fp, count(*) FILTER (n_chars <= 1000 AND quality = 1) AS fn, count(*) FILTER (n_chars <= 1000 AND quality = 0) AS tn FROM judged) SELECT tp, fp, fn, tn, round(tp / CAST(tp + fp AS DOUBLE), 6) AS \"precision\", round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall, round((tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE), 6) AS accuracy, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def binary_confusion(spark, sf_dir):
    out = agg.confusion(judged(spark, sf_dir), F.col("n_chars") > 1000, F.col("quality") == 1)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "accuracy", "f1")})


_BLOCKS = f"WITH {JUDGED}, o AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM judged), b AS (SELECT count(*) AS n, avg(least(n_chars, 5000) / 5000.0) AS c, avg(quality) AS a FROM o GROUP BY ordinal // 100)"


def _calibrated(spark, sf_dir, norm):
    df = ds.numbered(judged(spark, sf_dir), "doc_id")
    return agg.calibration(df, "ordinal", F.least(F.col("n_chars"), F.lit(5000)) / 5000.0, F.col("quality"), norm=norm).select(F.round("calibration_error", 6).alias("calibration_error"))


@query(_BLOCKS + " SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS calibration_error FROM b")
def calibration_error_p1(spark, sf_dir):
    return _calibrated(spark, sf_dir, 1)


@query(_BLOCKS + " SELECT round(sqrt(sum(n * power(c - a, 2)) / sum(n)), 6) AS calibration_error FROM b")
def calibration_error_p2(spark, sf_dir):
    return _calibrated(spark, sf_dir, 2)


@query(_BLOCKS + " SELECT round(max(abs(c - a)), 6) AS calibration_error FROM b")
def calibration_error_inf(spark, sf_dir):
    return _calibrated(spark, sf_dir, float("inf"))


@query(f"WITH {REC} SELECT round(avg(length(trim(prediction, ' '))), 6) AS avg_num_chars, round(avg(len({_toks('prediction')})), 6) AS avg_num_words, round(count(*) FILTER (prediction <> '') / CAST(count(*) AS DOUBLE), 6) AS coverage FROM rec")
def text_statistics(spark, sf_dir):
    p = F.col("prediction")
    return records(spark, sf_dir).agg(F.round(F.avg(F.char_length(F.trim(p))), 6).alias("avg_num_chars"), F.round(F.avg(F.size(t.tokens(p))), 6).alias("avg_num_words"), F.round(F.count_if(p != "") / F.count("*"), 6).alias("coverage"))


# --- runs


@query(f"WITH {RUNS}, r AS (SELECT benchmark, run_index, avg(value) AS v FROM runs GROUP BY benchmark, run_index) SELECT benchmark, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(*) AS num_runs FROM r GROUP BY benchmark")
def multi_run_mean_std(spark, sf_dir):
    by_run = runs(spark, sf_dir).groupBy("benchmark", "run_index").agg(F.avg("value").alias("value"))
    return agg.across_runs(by_run, ["benchmark"]).select("benchmark", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "num_runs")


@query(f"WITH {RUNS}, s AS (SELECT inference, sample, max(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS a, min(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS b FROM runs GROUP BY inference, sample) SELECT inference, round(avg(a), 6) AS any_rate, round(avg(b), 6) AS all_rate FROM s GROUP BY inference")
def multi_run_any_all(spark, sf_dir):
    out = agg.any_all(runs(spark, sf_dir), ["inference"], "sample", F.col("value") > 50)
    return out.select("inference", F.round("any_rate", 6).alias("any_rate"), F.round("all_rate", 6).alias("all_rate"))


@query(f"WITH {RUNS}, r AS (SELECT benchmark, model, run_index, avg(value) AS v, count(*) AS n FROM runs GROUP BY benchmark, model, run_index) SELECT benchmark, model, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, CAST(sum(n) AS BIGINT) AS num_samples FROM r GROUP BY benchmark, model")
def group_multi_run(spark, sf_dir):
    by_run = runs(spark, sf_dir).groupBy("benchmark", "model", "run_index").agg(F.avg("value").alias("v"), F.count("*").alias("n"))
    return by_run.groupBy("benchmark", "model").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"), F.sum("n").alias("num_samples"))


@query()
def bootstrap_stderr(spark, sf_dir):
    return agg.bootstrap_error(judged(spark, sf_dir), F.col("quality").cast("double"), 50, "doc_id").select(F.round("stderr", 6).alias("stderr"))


# --- judges


@query(f"WITH {JUDGED} SELECT rubric, source, round(avg(score), 6) AS score, count(*) AS n FROM (SELECT 'quality' AS rubric, source, quality AS score FROM judged UNION ALL SELECT 'toxic', source, toxic FROM judged) GROUP BY rubric, source")
def judge_rubric_rollup(spark, sf_dir):
    long = judged(spark, sf_dir).select("source", F.explode(F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic")).alias("rubric", "score"))
    return long.groupBy("rubric", "source").agg(F.round(F.avg("score"), 6).alias("score"), F.count("*").alias("n"))


@query(f"WITH {JUDGED}, j AS (SELECT lang, source, avg(quality) AS q FROM judged GROUP BY lang, source) SELECT lang, round(avg(q), 6) AS mean_over_judges, count(*) AS judges FROM j GROUP BY lang")
def judge_multi_model_mean(spark, sf_dir):
    each = judged(spark, sf_dir).groupBy("lang", "source").agg(F.avg("quality").alias("q"))
    return each.groupBy("lang").agg(F.round(F.avg("q"), 6).alias("mean_over_judges"), F.count("*").alias("judges"))


@query(f"""WITH {JUDGED}, v AS (SELECT lang, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN quality = 1 THEN 'A' ELSE 'B' END AS ab, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN toxic = 1 THEN 'A' ELSE 'B' END AS ba FROM judged),
w AS (SELECT lang, ab, CASE ba WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' END AS f FROM v), r AS (SELECT lang, CASE WHEN ab IS NULL AND f IS NULL THEN 'tie' WHEN f IS NULL THEN ab WHEN ab IS NULL THEN f WHEN ab = f THEN ab ELSE 'tie' END AS w FROM w)
SELECT lang, round(avg(CASE WHEN w = 'A' THEN 1.0 ELSE 0 END), 6) AS win_rate, round(avg(CASE w WHEN 'A' THEN 1.0 WHEN 'tie' THEN 0.5 ELSE 0 END), 6) AS win_point FROM r GROUP BY lang""")
def pairwise_swap(spark, sf_dir):
    ab = F.when(F.col("doc_id") % 7 == 0, None).when(F.col("quality") == 1, "A").otherwise("B")
    ba = F.when(F.col("doc_id") % 5 == 0, None).when(F.col("toxic") == 1, "A").otherwise("B")
    v = judged(spark, sf_dir).select("lang", agg.swap_verdict(ab, ba).alias("w"))
    return v.groupBy("lang").agg(F.round(F.avg(agg.win_rate(F.col("w"))), 6).alias("win_rate"), F.round(F.avg(agg.win_point(F.col("w"))), 6).alias("win_point"))


@query()
def judge_scores_parsed(spark, sf_dir):
    response = F.concat(F.lit("Reasoning here.\nScore: "), F.col("doc_id") % 10, F.lit("\nrating: "), F.col("quality"))
    df = judged(spark, sf_dir).select("lang", extract.last_match(response, r"(?i)score\s*[:=]\s*(\d+(?:\.\d+)?)").cast("double").alias("s"), extract.last_match(response, r"(?im)^rating:\s*([01])\s*$").cast("int").alias("r"))
    return df.groupBy("lang").agg(F.round(F.avg(F.when(F.col("s") <= 10, F.col("s") / 10).otherwise(F.col("s"))), 6).alias("rating"), F.round(F.avg("r"), 6).alias("verified"))


# --- extraction


@query(f"WITH {CHOICES}, e AS (SELECT gold, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE gold END AS letter FROM choices) SELECT gold, count(*) AS n, count(letter) AS found, round(avg(CASE WHEN letter = gold THEN 1.0 ELSE 0 END), 6) AS acc FROM e GROUP BY gold")
def extract_multichoice(spark, sf_dir):
    e = choices(spark, sf_dir).select("gold", extract.multichoice(F.col("answer")).alias("letter"))
    return e.groupBy("gold").agg(F.count("*").alias("n"), F.count("letter").alias("found"), F.round(F.avg(F.when(F.col("letter") == F.col("gold"), 1.0).otherwise(0.0)), 6).alias("acc"))


@query(rf"""WITH {CHOICES}, e AS (SELECT CASE WHEN regexp_matches(lower(trim(answer)), '^(no|false)') THEN 'no' WHEN regexp_matches(lower(trim(answer)), '^(yes|true)') THEN 'yes' WHEN regexp_matches(lower(answer), '\b(no|not|false|incorrect)\b') THEN 'no' WHEN regexp_matches(lower(answer), '\b(yes|true|correct)\b') THEN 'yes' END AS verdict FROM choices) SELECT coalesce(verdict, 'none') AS verdict, count(*) AS n FROM e GROUP BY 1""")
def extract_binary(spark, sf_dir):
    return choices(spark, sf_dir).select(F.coalesce(extract.binary(F.col("answer")), F.lit("none")).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CAST(o_custkey % 100 AS VARCHAR) AS answer, 'thinking about ' || CAST(o_orderkey AS VARCHAR) AS reasoning FROM orders")
def extract_think_boxed(spark, sf_dir):
    raw = F.concat(F.lit("<think>thinking about "), F.col("o_orderkey"), F.lit("</think> so \\boxed{"), F.col("o_custkey") % 100, F.lit("}"))
    parts = table(spark, sf_dir, "orders").select("o_orderkey", extract.think(raw).alias("t"))
    return parts.select("o_orderkey", extract.boxed(F.col("t.answer")).alias("answer"), F.col("t.reasoning").alias("reasoning"))


@query("SELECT o_orderkey, CAST((o_custkey % 60) * 60 + 5 AS DOUBLE) AS start_s, CAST((o_custkey % 60) * 60 + 35 AS DOUBLE) AS end_s FROM orders")
def extract_temporal(spark, sf_dir):
    minute = F.col("o_custkey") % 60
    raw = F.concat(F.lit("It happens at "), minute, F.lit(":05 - "), minute, F.lit(":35."))
    return table(spark, sf_dir, "orders").select("o_orderkey", extract.interval(raw).alias("i")).select("o_orderkey", F.col("i.start").alias("start_s"), F.col("i.end").alias("end_s"))


@query("SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS x1, CAST(o_orderkey % 50 AS DOUBLE) AS y1, CAST(o_custkey + 10 AS DOUBLE) AS x2, CAST(o_orderkey % 50 + 5 AS DOUBLE) AS y2 FROM orders")
def extract_spatial(spark, sf_dir):
    y = F.col("o_orderkey") % 50
    raw = F.concat(F.lit("The box is ["), F.col("o_custkey"), F.lit(", "), y, F.lit(", "), F.col("o_custkey") + 10, F.lit(", "), y + 5, F.lit("]."))
    b = table(spark, sf_dir, "orders").select("o_orderkey", extract.box(raw).alias("b"))
    return b.select("o_orderkey", *[F.col("b")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


@query("SELECT p_partkey, p_name AS span, 'x = ' || CAST(p_size AS VARCHAR) AS code, lower(p_name) AS heard FROM part")
def extract_freeform_code_asr(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    answer = F.concat(F.lit("Well.\nFinal answer: "), F.col("p_name"), F.lit("."))
    code = F.concat(F.lit("Here:\n```python\nx = "), F.col("p_size"), F.lit("\n```\nDone"))
    said = F.concat(F.lit("Transcription: \""), F.lower("p_name"), F.lit("\""))
    return p.select("p_partkey", extract.freeform(answer).alias("span"), F.trim(F.regexp_replace(extract.code_block(code), "\n$", "")).alias("code"), extract.transcript(said).alias("heard"))


# --- datasets


@query("SELECT dataset_name, count(*) AS n, CAST(sum(k) AS BIGINT) AS keys FROM (SELECT 'documents' AS dataset_name, doc_id AS k FROM documents UNION ALL SELECT 'benchmark', item_id FROM benchmark UNION ALL SELECT 'conversations', conv_id FROM conversations) GROUP BY dataset_name")
def dataset_concatenate(spark, sf_dir):
    parts = {"documents": ("doc_id",), "benchmark": ("item_id",), "conversations": ("conv_id",)}
    return ds.concatenate({k: table(spark, sf_dir, k).select(F.col(c).alias("k")) for k, (c,) in parts.items()}).groupBy("dataset_name").agg(F.count("*").alias("n"), F.sum("k").alias("keys"))


@query("SELECT d.doc_id, d.lang, l.quality, c.turn FROM documents d JOIN labels l ON l.doc_id = d.doc_id JOIN (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id) c ON c.conv_id = d.doc_id")
def dataset_join_n_way(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = table(spark, sf_dir, "labels").withColumn("turn", F.lit(0))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn")
    joined = ds.join_all({"documents": docs, "labels": labels, "conversations": turns}, "doc_id", "turn")
    return joined.select("doc_id", "lang", F.col("labels.quality").alias("quality"), F.col("conversations.turn").alias("turn"))


@query("SELECT lang, source, count(*) AS n FROM documents WHERE lang IN ('en', 'de') AND source IN ('src0', 'src1', 'src2') GROUP BY lang, source")
def dataset_subset(spark, sf_dir):
    return ds.subset(table(spark, sf_dir, "documents").select("lang", "source"), {"lang": ["en", "de"], "source": ["src0", "src1", "src2"]}).groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, chr(CAST(65 + (p_size % 4 + p_partkey % 3) % 4 AS INTEGER)) AS label, CASE p_partkey % 3 WHEN 0 THEN 'a b c d' WHEN 1 THEN 'd a b c' ELSE 'c d a b' END AS contents FROM part")
def option_rotation(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.char(F.col("p_size") % 4 + 65).alias("label"), F.array(*map(F.lit, "abcd")).alias("options"))
    return ds.rotate_options(df, "options", "label", (F.col("p_partkey") % 3).cast("int")).select("p_partkey", "label", F.array_join("options", " ").alias("contents"))


@query("WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS o, count(*) OVER () AS t FROM documents), s AS (SELECT doc_id, CASE WHEN o < (t % 7) * (t // 7 + 1) THEN o // (t // 7 + 1) ELSE t % 7 + (o - (t % 7) * (t // 7 + 1)) // (t // 7) END AS shard FROM n) SELECT CAST(shard AS INTEGER) AS shard, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM s GROUP BY shard")
def shard_contiguous(spark, sf_dir):
    return ds.shards(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7).groupBy("shard").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("SELECT lang, CAST(count(*) * 3 AS BIGINT) AS n, CAST(2 AS INTEGER) AS last FROM documents GROUP BY lang")
def sample_repetition(spark, sf_dir):
    return ds.repeat(table(spark, sf_dir, "documents").select("lang"), 3).groupBy("lang").agg(F.count("*").alias("n"), F.max("repetition").alias("last"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_user_message(spark, sf_dir):
    return ds.last_of_role(table(spark, sf_dir, "conversations"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'Read: ' || url WHEN 2 THEN url || chr(10) || 'Answer it.' ELSE 'Only this' END AS prompt FROM pages")
def prompt_rendering(spark, sf_dir):
    k = F.col("page_id") % 4
    template = F.when(k == 0, None).when(k == 1, "Read: {query}").when(k == 2, "Answer it.").otherwise("{query} Only this")
    return table(spark, sf_dir, "pages").select("page_id", ds.render_prompt(template, F.when(k == 3, None).otherwise(F.col("url"))).alias("prompt"))


# --- leaderboard

_MERGED = f"WITH {RUNS}, b AS (SELECT model, checkpoint, source, benchmark, metric, CASE WHEN metric = 'latency' THEN min(value) ELSE max(value) END AS value, array_to_string(list_sort(list(DISTINCT inference)), ' / ') AS inference FROM runs GROUP BY model, checkpoint, source, benchmark, metric)"


@query(_MERGED + " SELECT model, checkpoint, source, benchmark, metric, value, inference FROM b")
def leaderboard_best_merge(spark, sf_dir):
    return lb.best_merge(runs(spark, sf_dir))


_WEIGHTS = [("click", 2.0), ("view", 0.5)]


@query(_MERGED + " SELECT model, round(sum(value * w) / sum(w), 6) AS average, count(*) AS num_benchmarks FROM (SELECT model, value, CASE benchmark WHEN 'click' THEN 2.0 WHEN 'view' THEN 0.5 ELSE 1.0 END AS w FROM b WHERE metric = 'score') GROUP BY model")
def leaderboard_weighted_avg(spark, sf_dir):
    weights = spark.createDataFrame(_WEIGHTS, "benchmark string, weight double")
    return lb.weighted_average(lb.best_merge(runs(spark, sf_dir)).where("metric = 'score'"), weights).withColumn("average", F.round("average", 6))


@query(_MERGED + " SELECT benchmark, CASE WHEN max(value) - min(value) > 1e-9 THEN min(value) END AS low, CASE WHEN max(value) - min(value) > 1e-9 THEN max(value) END AS high FROM b GROUP BY benchmark")
def leaderboard_minmax(spark, sf_dir):
    return lb.extremes(lb.best_merge(runs(spark, sf_dir)))


@query(_MERGED + ", k AS (SELECT model, checkpoint, benchmark, metric, value, inference FROM b) SELECT * FROM k ORDER BY lower(model), lower(inference), checkpoint, benchmark, metric LIMIT 20 OFFSET 20")
def leaderboard_page(spark, sf_dir):
    rows = lb.best_merge(lb.normal_models(runs(spark, sf_dir))).select("model", "checkpoint", "benchmark", "metric", "value", "inference")
    return lb.page(rows, [*lb.default_order(), F.col("benchmark"), F.col("metric")], 1, 20)


@query(f"WITH {RUNS}, c AS (SELECT * FROM runs WHERE benchmark <> 'click' OR metric = 'latency') SELECT benchmark, metric, count(*) AS n, round(max(value), 6) AS top FROM c GROUP BY benchmark, metric")
def leaderboard_metric_override(spark, sf_dir):
    chosen = spark.createDataFrame([("click", "latency")], "benchmark string, metric string")
    return lb.metric_override(runs(spark, sf_dir), chosen).groupBy("benchmark", "metric").agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("top"))


@query(_MERGED + ", s AS (SELECT model, round(avg(value), 6) AS score FROM b WHERE metric = 'score' GROUP BY model) SELECT model, score, CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, model) AS INTEGER) AS rank FROM s")
def leaderboard_rank(spark, sf_dir):
    scores = lb.best_merge(runs(spark, sf_dir)).where("metric = 'score'").groupBy("model").agg(F.round(F.avg("value"), 6).alias("score"))
    return lb.ranked(scores, "score")


@query(f"WITH {RUNS} SELECT model, CASE WHEN regexp_matches(lower(benchmark), 'video|movie|clip') THEN 'video' WHEN regexp_matches(lower(benchmark), 'image|vision|view|click|chart|doc') THEN 'image' WHEN regexp_matches(lower(benchmark), 'audio|speech|voice|asr') THEN 'audio' ELSE 'text' END AS modality, count(DISTINCT benchmark) AS benchmarks FROM runs GROUP BY 1, 2")
def model_counts_by_modality(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("model", lb.modality(F.col("benchmark")).alias("modality")).agg(F.countDistinct("benchmark").alias("benchmarks"))


@query(_MERGED + " SELECT model, round(sum(value), 6) AS total_time FROM b WHERE metric = 'latency' GROUP BY model")
def leaderboard_time_sum(spark, sf_dir):
    return lb.best_merge(runs(spark, sf_dir)).where(lb.lower_better(F.col("metric"))).groupBy("model").agg(F.round(F.sum("value"), 6).alias("total_time"))


@query(f"WITH {RUNS} SELECT model, round(count(DISTINCT benchmark) / CAST((SELECT count(DISTINCT benchmark) FROM runs) AS DOUBLE), 6) AS coverage FROM runs WHERE value > 99 GROUP BY model")
def leaderboard_coverage(spark, sf_dir):
    df = runs(spark, sf_dir)
    every = df.agg(F.countDistinct("benchmark").alias("n")).first().n
    return df.where("value > 99").groupBy("model").agg(F.round(F.countDistinct("benchmark") / F.lit(every), 6).alias("coverage"))


@query(_MERGED + " SELECT model, checkpoint, max(CASE WHEN benchmark = 'click' THEN value END) AS click, max(CASE WHEN benchmark = 'view' THEN value END) AS view, max(CASE WHEN benchmark = 'error' THEN value END) AS error, max(CASE WHEN benchmark = 'purchase' THEN value END) AS purchase, max(CASE WHEN benchmark = 'signup' THEN value END) AS signup FROM b WHERE metric = 'score' GROUP BY model, checkpoint")
def leaderboard_pivot(spark, sf_dir):
    return lb.best_merge(runs(spark, sf_dir)).where("metric = 'score'").groupBy("model", "checkpoint").pivot("benchmark", ["click", "view", "error", "purchase", "signup"]).agg(F.max("value"))


# --- submissions


@query(f"WITH {REC} SELECT CAST(doc_id AS INTEGER) AS \"questionId\", prediction AS answer FROM rec")
def submission_rrc(spark, sf_dir):
    return sub.rrc(records(spark, sf_dir), "doc_id")


@query(f"WITH {REC} SELECT CAST(doc_id AS VARCHAR) AS question_id, prediction AS answer FROM rec")
def submission_evalai(spark, sf_dir):
    return sub.eval_server(records(spark, sf_dir), "doc_id")


@query(f"WITH {REC} SELECT 'VizWiz_test_' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.jpg' AS image, lower(prediction) AS answer FROM rec")
def submission_vizwiz(spark, sf_dir):
    return sub.vizwiz(records(spark, sf_dir), "doc_id")


@query(f"WITH {REC} SELECT CAST(doc_id AS VARCHAR) AS \"questionId\", prediction, labels[1] AS gt FROM rec")
def submission_chart(spark, sf_dir):
    return sub.chart(records(spark, sf_dir), "doc_id")


@query(f"WITH {REC} SELECT l.doc_id, l.quality, coalesce(r.prediction, '') AS prediction FROM labels l LEFT JOIN (SELECT * FROM rec WHERE category = 'en') r ON r.doc_id = l.doc_id")
def submission_template_left_join(spark, sf_dir):
    template = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return sub.fill_template(template, records(spark, sf_dir).where("category = 'en'"), "doc_id").select("doc_id", "quality", "prediction")


# --- roll-ups


@query("SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS n, round(100.0 * sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) / count(*), 6) AS acc FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def rollup_four_dim(spark, sf_dir):
    hit = F.count_if(F.col("l_quantity") > 25)
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(agg.safe_percentage(hit, F.count("*")), 6).alias("acc")).select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n", "acc")


@query("SELECT coalesce(r_name, 'overall') AS domain, coalesce(n_name, 'all') AS subject, count(*) AS n, round(avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0 END), 5) AS acc FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_domain_subject(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rolled = joined.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.avg((F.col("c_acctbal") > 0).cast("double")), 5).alias("acc"))
    return rolled.select(F.coalesce("r_name", F.lit("overall")).alias("domain"), F.coalesce("n_name", F.lit("all")).alias("subject"), "n", "acc")


@query(f"WITH {JUDGED} SELECT round(avg(m), 6) AS macro, count(*) AS groups FROM (SELECT source, avg(quality) AS m FROM judged GROUP BY source)")
def macro_average(spark, sf_dir):
    return agg.macro_average(judged(spark, sf_dir), "source", F.col("quality")).withColumn("macro", F.round("macro", 6))


@query(f"WITH {JUDGED} SELECT lang, round(100.0 * count(*) FILTER (quality = 1) / count(*), 6) AS accuracy FROM judged GROUP BY lang")
def yes_no_accuracy(spark, sf_dir):
    return judged(spark, sf_dir).groupBy("lang").agg(F.round(agg.safe_percentage(F.count_if(F.col("quality") == 1), F.count("*")), 6).alias("accuracy"))


# --- instruction checks

_INSTRUCTIONS = {"word_count_range": {"low": 5, "high": 40}, "number_count": {"n": 0}, "no_whitespace": {}, "contains_phrase": {"phrase": "the"}, "reversed_phrase": {"phrase": "the"}}


def _instructed(df, how):
    return df.select("doc_id", "category", *[how(F.col("prediction"), k, **v).alias(k) for k, v in _INSTRUCTIONS.items()])


_STRICT = f"WITH {REC}, s AS (SELECT doc_id, category, prediction <> '' AND len({_toks('prediction')}) BETWEEN 5 AND 40 AS a, prediction <> '' AND NOT regexp_matches(prediction, '\\d') AS b, prediction <> '' AND NOT regexp_matches(prediction, '\\s') AS c, contains(lower(prediction), 'the') AS d, contains(lower(prediction), 'eht') AS e FROM rec)"


@query(_STRICT + " SELECT category, round(avg(CASE WHEN a AND b AND d THEN 1.0 ELSE 0 END), 6) AS prompt_acc FROM s GROUP BY category")
def if_strict_prompt(spark, sf_dir):
    return _instructed(records(spark, sf_dir), checks.strict).groupBy("category").agg(F.round(F.avg((F.col("word_count_range") & F.col("number_count") & F.col("contains_phrase")).cast("double")), 6).alias("prompt_acc"))


@query(_STRICT + " SELECT round((sum(CAST(a AS INT)) + sum(CAST(b AS INT)) + sum(CAST(c AS INT)) + sum(CAST(d AS INT)) + sum(CAST(e AS INT))) / CAST(5 * count(*) AS DOUBLE), 6) AS inst_acc FROM s")
def if_instruction_level(spark, sf_dir):
    flat = _instructed(records(spark, sf_dir), checks.strict).select(F.explode(F.array(*_INSTRUCTIONS)).alias("ok"))
    return flat.agg(F.round(F.avg(F.col("ok").cast("double")), 6).alias("inst_acc"))


@query()
def if_loose_prompt(spark, sf_dir):
    return _instructed(whole_records(spark, sf_dir, even=True), checks.loose).groupBy("category").agg(*[F.round(F.avg(F.col(k).cast("double")), 6).alias(k) for k in _INSTRUCTIONS])


@query()
def if_all_checks(spark, sf_dir):
    """Every check of the catalogue over all records, one rate each."""
    short_batches(spark)
    df = whole_records(spark, sf_dir, even=True).withColumn("reference", F.col("labels")[1])
    said, reference = F.col("prediction"), F.col("reference")
    extra = {"trigram_overlap": {"reference": reference}, "repeat_change": {"prompt": reference}, "repeat_span": {"prompt": reference}}
    with checks.with_parts(df, said, reference) as rows:
        return rows.agg(*[F.round(F.avg(checks.strict(said, k, **extra.get(k, {})).cast("double")), 6).alias(k) for k in checks.CHECKS])


# --- streaming


@query("SELECT event_type, count(*) AS n, round(max(value), 6) AS best FROM events GROUP BY event_type")
def stream_incremental_leaderboard(spark, sf_dir):
    source = f"{sf_dir}/events.parquet"
    stream = live.event_stream(spark, f"{source}*", spark.read.parquet(source).schema)
    return live.drain(live.incremental_best(stream, ["event_type"]), "live_best").select("event_type", "n", F.round("best", 6).alias("best"))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start_ts, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_throughput_window(spark, sf_dir):
    source = f"{sf_dir}/events.parquet"
    stream = live.event_stream(spark, f"{source}*", spark.read.parquet(source).schema)
    out = live.drain(live.throughput(stream, "ts", "1 hour", keys=["event_type"]), "live_windows")
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start_ts"), "event_type", "n", F.round("total", 4).alias("total"))


from scorewright.plans import answers, catalogue, rollups, scores, tasks  # noqa: E402, F401  (they add their queries to this registry)
