"""Queries of the task layer: records, messages, alignment with engine output, filters and views of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewright.functions import messages as msg
from scorewright.operators import leaderboard as lb, tasks as op
from scorewright.plans.registry import query
from scorewright.plans.views import JUDGED, RUNS, judged, runs, table


@query("""SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS "index", rtrim('Q: ' || text, ' ') AS prompt, role AS label, 'no' AS option_1,
CASE WHEN turn = 0 THEN 'first' ELSE 'task' END AS stage, CAST(conv_id AS VARCHAR) AS conv FROM conversations""")
def record_build(spark, sf_dir):
    samples = table(spark, sf_dir, "conversations")
    none = F.array().cast("array<string>")
    task = F.create_map(F.lit("stage"), F.lit("task"), F.lit("conv"), F.lit("?"))
    own = F.when(F.col("turn") == 0, F.create_map(F.lit("stage"), F.lit("first"))).otherwise(F.create_map().cast("map<string,string>"))
    built = op.build_records(samples, F.col("conv_id") * 1000 + F.col("turn"), F.concat(F.lit("Q: "), "text"), F.array("role", F.lit(None)), none, ["yes", "no"], task, F.create_map(F.lit("conv"), F.col("conv_id").cast("string")), own)
    return built.select("index", "prompt", F.col("labels")[0].alias("label"), F.col("options")[1].alias("option_1"), F.col("meta")["stage"].alias("stage"), F.col("meta")["conv"].alias("conv"))


def _messages(spark, sf_dir):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("messages"))


@query("SELECT conv_id, string_agg(upper(role[1]) || role[2:] || ': ' || text, chr(10) ORDER BY turn) AS prompt, count(*) AS n FROM conversations GROUP BY conv_id")
def role_prompts(spark, sf_dir):
    return _messages(spark, sf_dir).select("conv_id", op.dialogue(F.col("messages")).alias("prompt"), F.size("messages").cast("long").alias("n"))


@query("""SELECT conv_id, coalesce(string_agg(CASE WHEN role = 'system' THEN text END, chr(10) ORDER BY turn), '') AS system,
string_agg(CASE WHEN role = 'system' THEN NULL WHEN role = 'assistant' THEN 'model' ELSE 'user' END, ',' ORDER BY turn) AS roles,
count(*) FILTER (role <> 'system') AS contents FROM conversations GROUP BY conv_id""")
def vendor_messages(spark, sf_dir):
    """Messages as services take them: the system's text apart, answers under the role ``model``."""
    content = lambda m: F.array(F.struct(F.lit("text").alias("type"), m["text"].alias("value")))
    m = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), content(m).alias("content")))
    shaped = _messages(spark, sf_dir).select("conv_id", msg.model_parts(m).alias("s"))
    roles = F.transform(F.from_json("s.contents", "array<struct<role:string,parts:array<struct<text:string>>>>"), lambda x: x["role"])
    return shaped.select("conv_id", F.coalesce("s.system", F.lit("")).alias("system"), F.nullif(F.array_join(roles, ","), F.lit("")).alias("roles"), F.size(roles).cast("long").alias("contents"))


@query("""WITH i AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'image' ELSE 'audio' END AS kind, text FROM conversations)
SELECT conv_id, count(*) FILTER (kind <> 'audio') AS kept, CAST(coalesce(sum(length(text)) FILTER (kind = 'text'), 0) AS BIGINT) AS stripped_chars, CAST(coalesce(sum(length(text)) FILTER (kind <> 'audio'), 0) AS BIGINT) AS chars FROM i GROUP BY conv_id""")
def media_items(spark, sf_dir):
    """Items without audio; payloads of media are taken out, and come back by position where the kind is the same."""
    kind = F.element_at(F.array(F.lit("text"), F.lit("image"), F.lit("audio")), (F.col("turn") % 3 + 1).cast("int"))
    items = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", kind.alias("kind"), F.col("text").alias("value")))).alias("items"))
    items = items.withColumn("kept", F.filter("items", lambda x: x["kind"] != "audio"))
    items = items.withColumn("bare", F.transform("kept", lambda x: F.struct(x["kind"].alias("kind"), F.when(x["kind"] == "text", x["value"]).alias("value"))))
    items = items.withColumn("back", F.zip_with("bare", "kept", lambda a, b: F.coalesce(a["value"], F.when(a["kind"] == b["kind"], b["value"]))))
    total = lambda c, f: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + F.coalesce(F.char_length(f(x)), F.lit(0)))
    return items.select("conv_id", F.size("kept").cast("long").alias("kept"), total("bare", lambda x: x["value"]).alias("stripped_chars"), total("back", lambda x: x).alias("chars"))


@query("SELECT p_partkey, p_brand AS maker, p_type AS kind FROM part")
def key_rename(spark, sf_dir):
    fields = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("kind"), F.col("p_type"))
    fields = op.renamed_key(op.renamed_key(fields, "brand", "maker"), "absent", "kind")
    return table(spark, sf_dir, "part").withColumn("m", fields).select("p_partkey", F.col("m")["maker"].alias("maker"), F.col("m")["kind"].alias("kind"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 >= p_partkey % 4 THEN repeat('<image>', CAST(p_size % 3 - p_partkey % 4 AS BIGINT)) || repeat('<image> x ', CAST(p_partkey % 4 AS BIGINT)) || p_brand
ELSE repeat('<image> x ', CAST(p_size % 3 AS BIGINT)) || repeat(' x ', CAST(p_partkey % 4 - p_size % 3 AS BIGINT)) || p_brand END AS text FROM part""")
def tag_alignment(spark, sf_dir):
    text = F.concat(F.repeat(F.lit("<image> x "), (F.col("p_partkey") % 4).cast("int")), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", op.aligned_tags(text, "<image>", F.col("p_size") % 3).alias("text"))


@query(r"SELECT page_id, regexp_matches(url, '^(https?|ftp)://[^\s/]+') AS is_url, regexp_full_match(trim(CAST(page_id AS VARCHAR)), '[+-]?[0-9]+') AS is_int, 'j' || CAST(page_id AS VARCHAR) AS parsed FROM pages")
def typed_strings(spark, sf_dir):
    """Tests of strings, and a string read as JSON where it is JSON."""
    raw = F.concat(F.lit('{"k": "j'), "page_id", F.lit('"}'))
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").rlike(r"^(https?|ftp)://[^\s/]+").alias("is_url"), F.trim(F.col("page_id").cast("string")).rlike(r"^[+-]?[0-9]+$").alias("is_int"), F.coalesce(F.get_json_object(raw, "$.k"), raw).alias("parsed"))


_ANSWERS = "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS prediction, CASE WHEN event_id % 3 = 0 THEN 'click' ELSE '' END AS label FROM events"


def _answers(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 5 == 0, "").otherwise(F.col("event_type")).alias("prediction"), F.when(F.col("event_id") % 3 == 0, "click").otherwise("").alias("label"))


@query(f"WITH a AS ({_ANSWERS}) SELECT count(*) AS miss_rows, count(*) FILTER (coalesce(prediction, '') = '') AS miss_empty, count(prediction) AS skip_rows, count(*) FILTER (coalesce(prediction, 'none') = 'none') AS fallback_rows FROM a")
def null_policies(spark, sf_dir):
    p = F.col("prediction")
    return _answers(spark, sf_dir).agg(F.count("*").alias("miss_rows"), F.count_if(F.coalesce(p, F.lit("")) == "").alias("miss_empty"), F.count(p).alias("skip_rows"), F.count_if(F.coalesce(p, F.lit("none")) == "none").alias("fallback_rows"))


@query(f"WITH a AS ({_ANSWERS}) SELECT event_id, coalesce(prediction, '') <> '' AND label <> '' AS eligible, CASE WHEN coalesce(prediction, '') <> '' AND label <> '' THEN CAST(prediction = label AS INTEGER) END AS verified FROM a")
def verifier_scatter(spark, sf_dir):
    """Verdicts of the eligible records, put back beside all records by their key."""
    rows = _answers(spark, sf_dir).withColumn("eligible", op.eligible(F.col("prediction"), F.col("label")))
    verdicts = rows.where("eligible").select("event_id", (F.col("prediction") == F.col("label")).cast("int").alias("verified"))
    return rows.join(verdicts, "event_id", "left").select("event_id", "eligible", "verified")


@query("WITH g AS (SELECT l_orderkey, list(coalesce(CASE WHEN l_quantity > 5 THEN l_quantity END, 100.0) ORDER BY l_linenumber) AS p FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey AS l_orderkey, coalesce(len(p), 1) AS options, -coalesce(list_min(p), 100.0) AS log_likelihood FROM orders LEFT JOIN g ON l_orderkey = o_orderkey")
def instance_alignment(spark, sf_dir):
    """Perplexities of a record's options in the order of the engine's instances."""
    found = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 5, F.col("l_quantity")).alias("ppl"))
    out = op.instances_by_record(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), found, "l_orderkey", "l_linenumber", "ppl")
    return out.select("l_orderkey", F.size("perplexities").cast("long").alias("options"), (-F.array_min("perplexities")).alias("log_likelihood"))


@query("""WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS at, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
b AS (SELECT conv_id, length(text) AS score, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS at, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role <> 'system')
SELECT a.conv_id, a.turn, b.score FROM a LEFT JOIN b ON a.conv_id = b.conv_id AND a.at = b.at AND a.n = b.n""")
def sample_metrics_merge(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    scores = turns.where("role <> 'system'").select("conv_id", "turn", F.char_length("text").cast("long").alias("score"))
    return op.merged_metrics(turns.select("conv_id", "turn"), scores, "conv_id", "turn").select("conv_id", "turn", "score")


@query(f"WITH {RUNS} SELECT sample, arg_min(benchmark, (model, benchmark)) FILTER (benchmark <> 'error') AS question, count(DISTINCT model) AS models, count(*) AS total FROM runs GROUP BY sample")
def viewer_samples(spark, sf_dir):
    """One sample beside all models: the first that has a question gives it."""
    q = F.when(F.col("benchmark") != "error", F.col("benchmark"))
    first = F.min(F.when(q.isNotNull(), F.struct("model", q.alias("q"))))["q"]
    return runs(spark, sf_dir).groupBy("sample").agg(first.alias("question"), F.countDistinct("model").alias("models"), F.count("*").alias("total"))


@query(f"WITH {RUNS}, e AS (SELECT inference || ' / -' AS inference, model, value FROM runs) SELECT inference, count(*) AS n, count(*) FILTER (model NOT LIKE 'debug__%') AS normal FROM e WHERE contains(inference, 'e1') OR contains(inference, 'e2') GROUP BY inference")
def engine_filter(spark, sf_dir):
    rows = runs(spark, sf_dir).withColumn("inference", F.concat("inference", F.lit(" / -")))
    kept = rows.where(op.engine_matches(F.col("inference"), ["e1", "e2"], ["e0", "e1", "e2", "e3"]))
    return kept.groupBy("inference").agg(F.count("*").alias("n"), F.count_if(~F.lower("model").startswith("debug__")).alias("normal"))


@query(f"WITH {RUNS}, c AS (SELECT DISTINCT benchmark || '__' || CASE WHEN metric = 'latency' THEN 'latency' ELSE CAST(run_index AS VARCHAR) END AS name FROM runs) SELECT regexp_replace(name, '__[0-9]+$', '') AS benchmark, count(*) AS columns FROM c WHERE name NOT LIKE '%\\_\\_latency' ESCAPE '\\' GROUP BY 1")
def benchmark_columns(spark, sf_dir):
    name = F.concat("benchmark", F.lit("__"), F.when(F.col("metric") == "latency", "latency").otherwise(F.col("run_index").cast("string")))
    columns = runs(spark, sf_dir).select(name.alias("name")).distinct().where(op.real_benchmark(F.col("name")))
    return columns.groupBy(op.base_name(F.col("name")).alias("benchmark")).agg(F.count("*").alias("columns"))


@query(f"WITH {RUNS} SELECT benchmark, arg_min(inference, event_id) AS inference, count(*) FILTER (source IN ('local', 's3')) AS from_sources, count(*) FILTER (inference IN ('e0', 'e1')) AS with_likelihood FROM runs GROUP BY benchmark")
def benchmark_engines(spark, sf_dir):
    rows = runs(spark, sf_dir)
    counts = rows.groupBy("benchmark").agg(F.count_if(F.col("source").isin("local", "s3")).alias("from_sources"), F.count_if(F.col("inference").isin("e0", "e1")).alias("with_likelihood"))
    return op.first_written(rows, "benchmark", "inference", "event_id").join(counts, "benchmark")


@query(f"WITH {RUNS}, f AS (SELECT benchmark || '/' || metric AS key, min(event_id) AS first FROM runs GROUP BY 1) SELECT key, CAST(row_number() OVER (ORDER BY first, key) - 1 AS INTEGER) AS position FROM f")
def metric_key_union(spark, sf_dir):
    return op.key_union(runs(spark, sf_dir).withColumn("key", F.concat("benchmark", F.lit("/"), "metric")), "key", "event_id")


@query("SELECT p_brand, arg_min(p_name, (CASE WHEN p_size > 25 THEN 0 ELSE 1 END, p_partkey)) AS media, count(*) AS copies FROM part GROUP BY p_brand")
def media_dedup(spark, sf_dir):
    """One of several copies of a medium: an embedded one before a reference."""
    rows = table(spark, sf_dir, "part").withColumn("rank", F.struct((F.col("p_size") <= 25).cast("int").alias("r"), "p_partkey"))
    return rows.groupBy("p_brand").agg(F.min_by("p_name", "rank").alias("media"), F.count("*").alias("copies"))


@query(f"""WITH {RUNS}, g AS (SELECT model, inference, benchmark, CASE WHEN inference = 'e0' THEN 0 ELSE run_index END AS run, avg(value) AS v FROM runs GROUP BY 1, 2, 3, 4),
s AS (SELECT model, inference, benchmark, count(*) AS n, avg(v) AS m, stddev_pop(v) AS s, max(v) AS a, min(v) AS b FROM g GROUP BY 1, 2, 3)
SELECT model, inference, benchmark, x.statistic AS statistic, round(x.value, 6) AS value FROM (SELECT model, inference, benchmark, unnest(CASE WHEN n = 1 THEN [{{'statistic': 'value', 'value': m}}] ELSE [{{'statistic': 'mean', 'value': m}}, {{'statistic': 'std', 'value': s}}, {{'statistic': 'any', 'value': a}}, {{'statistic': 'all', 'value': b}}] END) AS x FROM s)""")
def run_passthrough(spark, sf_dir):
    by_run = runs(spark, sf_dir).groupBy("model", "inference", "benchmark", F.when(F.col("inference") == "e0", 0).otherwise(F.col("run_index")).alias("run")).agg(F.avg("value").alias("value"))
    return op.run_statistics(by_run, ["model", "inference", "benchmark"]).withColumn("value", F.round("value", 6))


@query(f"WITH {JUDGED} SELECT lang, round(100.0 * sum(quality) / nullif(sum(toxic), 0), 6) AS ratio, round(coalesce(100.0 * sum(toxic) / nullif(count(*), 0), 0), 6) AS toxic_share FROM judged GROUP BY lang")
def safe_percentages(spark, sf_dir):
    g = judged(spark, sf_dir).groupBy("lang").agg(F.sum("quality").alias("q"), F.sum("toxic").alias("t"), F.count("*").alias("n"))
    return g.select("lang", F.round(F.when(F.col("t") != 0, op.percentage(F.col("q"), F.col("t"))), 6).alias("ratio"), F.round(op.percentage(F.col("t"), F.col("n")), 6).alias("toxic_share"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_retailprice ELSE p_size END AS total, CAST(p_size AS DOUBLE) AS parsed FROM part")
def kit_results(spark, sf_dir):
    """The total of a kit's result under one of its usual names, and a percentage written as text."""
    metrics = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("overall"), F.col("p_retailprice"))).otherwise(F.create_map(F.lit("avg"), F.col("p_size").cast("double"), F.lit("x"), F.lit(1.0)))
    return table(spark, sf_dir, "part").select("p_partkey", op.picked_metric(metrics).alias("total"), op.percent_text(F.concat(F.lit(" "), "p_size", F.lit("% "))).alias("parsed"))


@query(f"WITH {JUDGED}, r AS (SELECT lang, source, 'quality' AS rubric, quality * 10.0 AS v FROM judged UNION ALL SELECT lang, source, 'safety', (1 - toxic) * 10.0 FROM judged) SELECT lang, rubric, round(avg(v), 6) AS score, round(sum(v), 6) AS rubric_sum, count(*) AS n FROM r GROUP BY lang, rubric")
def judge_collection(spark, sf_dir):
    """Rubric scores of a judge as long rows; the excluded rubric ``style`` goes."""
    rubrics = F.create_map(F.lit("quality"), F.col("quality") * 10.0, F.lit("safety"), (1 - F.col("toxic")) * 10.0, F.lit("style"), F.lit(5.0))
    rows = judged(spark, sf_dir).select("lang", F.explode(rubrics).alias("rubric", "v")).where("rubric <> 'style'")
    return rows.groupBy("lang", "rubric").agg(F.round(F.avg("v"), 6).alias("score"), F.round(F.sum("v"), 6).alias("rubric_sum"), F.count("*").alias("n"))


@query("WITH g AS (SELECT event_type, avg(value) AS m FROM events GROUP BY event_type) SELECT round(avg(m * CASE WHEN event_type = 'click' THEN 0.2 ELSE 1 END), 6) AS macro, count(*) AS num_groups FROM g")
def voice_suite(spark, sf_dir):
    return op.macro_average(table(spark, sf_dir, "events"), "event_type", "value", {"click": 0.2}).withColumn("macro", F.round("macro", 6))


@query("SELECT event_type, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS score, count(*) AS n FROM events GROUP BY event_type")
def chart_judge(spark, sf_dir):
    """Scores in the judge's JSON, by group; one that is no number counts as none."""
    score = F.get_json_object("props", "$.k").try_cast("double")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg(score), 6).alias("score"), F.count("*").alias("n"))


@query(f"WITH {JUDGED}, o AS (SELECT lang, quality, least(n_chars, 5000) / 50.0 AS c FROM judged WHERE n_chars % 4 <> 0) SELECT lang, count(*) AS n, round(100 * avg(quality), 6) AS accuracy, round(avg(c), 6) AS confidence FROM o WHERE c <> 0 GROUP BY lang")
def confidence_by_category(spark, sf_dir):
    """Accuracy and mean stated confidence; answers that state none take no part."""
    stated = F.when(F.col("n_chars") % 4 != 0, F.least(F.col("n_chars"), F.lit(5000)) / 50.0)
    rows = judged(spark, sf_dir).withColumn("c", stated).where("c is not null and c <> 0")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.round(100 * F.avg("quality"), 6).alias("accuracy"), F.round(F.avg("c"), 6).alias("confidence"))


@query("WITH w AS (SELECT n_name AS benchmark, least(greatest(n_nationkey / 10.0 - 0.5, 0), 1) AS weight FROM nation) SELECT benchmark, round(weight / (SELECT sum(weight) FROM w), 9) AS weight FROM w")
def weight_normalise(spark, sf_dir):
    weights = table(spark, sf_dir, "nation").select(F.col("n_name").alias("benchmark"), (F.col("n_nationkey") / 10.0 - 0.5).alias("weight"))
    return op.normalised_weights(weights).withColumn("weight", F.round("weight", 9))


_CELLS = "c AS (SELECT s_suppkey % 40 AS model, s_nationkey AS benchmark, max(s_acctbal) AS value FROM supplier GROUP BY 1, 2)"


@query(f"""WITH {_CELLS}, m1 AS (SELECT model FROM c GROUP BY model ORDER BY count(*) DESC, model LIMIT 7), b1 AS (SELECT benchmark FROM c WHERE model IN (SELECT model FROM m1) GROUP BY benchmark ORDER BY count(*) DESC, benchmark LIMIT 7),
m2 AS (SELECT model FROM c WHERE benchmark IN (SELECT benchmark FROM b1) GROUP BY model ORDER BY count(*) DESC, model LIMIT 7), b2 AS (SELECT benchmark FROM c WHERE model IN (SELECT model FROM m2) GROUP BY benchmark ORDER BY count(*) DESC, benchmark LIMIT 7)
SELECT * FROM c WHERE model IN (SELECT model FROM m2) AND benchmark IN (SELECT benchmark FROM b2)""")
def dense_top_grid(spark, sf_dir):
    cells = table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 40).alias("model"), F.col("s_nationkey").alias("benchmark")).agg(F.max("s_acctbal").alias("value"))
    return op.dense_grid(cells).select("model", "benchmark", "value")


@query(f"WITH {RUNS}, a AS (SELECT model, avg(value) AS v FROM runs GROUP BY model) SELECT model, round(v, 6) AS average FROM a ORDER BY v DESC, model LIMIT 5")
def chart_top_n(spark, sf_dir):
    average = runs(spark, sf_dir).groupBy("model").agg(F.avg("value").alias("v"))
    return lb.page(average, [F.desc("v"), F.col("model")], 0, 5).select("model", F.round("v", 6).alias("average"))


@query("SELECT event_id, CASE WHEN s >= 3600 THEN printf('%dh %dm', s // 3600, s % 3600 // 60) WHEN s >= 60 THEN printf('%dm %ds', s // 60, s % 60) ELSE printf('%ds', s) END AS took FROM (SELECT event_id, CAST(event_id * 37 % 9000 AS BIGINT) AS s FROM events)")
def duration_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", lb.duration(F.col("event_id") * 37 % 9000).alias("took"))


@query("SELECT p_partkey, list_reduce(list_prepend('', list_filter(regexp_extract_all(p_type, 'STEEL|TIN|BRASS|COPPER|NICKEL|steel|tin|brass|copper|nickel'), lambda x: x <> '')), lambda a, b: b) AS last FROM part")
def tail_candidate(spark, sf_dir):
    names = ["STEEL", "TIN", "BRASS", "COPPER", "NICKEL", "steel", "tin", "brass", "copper", "nickel"]
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(op.last_candidate(F.col("p_type"), names), F.lit("")).alias("last"))


@query("SELECT page_id, 'bench' || CAST(page_id % 7 AS VARCHAR) AS benchmark, 'm' || CAST(page_id % 3 AS VARCHAR) AS model, 'bench' || CAST(page_id % 7 AS VARCHAR) || '__engine.json' AS file FROM pages")
def path_columns(spark, sf_dir):
    """Benchmark and model from a result file's path, and the name that a benchmark's file gets."""
    from scorewright.sources.files import benchmark_of, output_name

    path = F.concat(F.lit("/out/m"), F.col("page_id") % 3, F.lit("/bench"), F.col("page_id") % 7, F.lit("__engine.json"))
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return rows.select("page_id", benchmark_of(F.col("path")).alias("benchmark"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("model"), output_name(benchmark_of(F.col("path")), F.lit("engine")).alias("file"))


@query("""SELECT event_id, 'm' || CAST(user_id % 10 AS VARCHAR) AS model, round(value, 2) AS score, round(coalesce(CASE WHEN event_id % 4 = 0 THEN 10.0 END, 0.5 * (event_id % 100)), 6) AS runtime_inference, least(greatest(event_id % 3 - 0.5, 0), 1) AS coverage FROM events""")
def result_metrics(spark, sf_dir):
    """Figures and names read from a run's JSON; missing ones come from their next place."""
    from scorewright.sources.files import derived_figures, first_path

    body = F.to_json(F.struct(F.struct(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("m"), F.col("user_id") % 10)).alias("model_name")).alias("meta"), F.struct(F.concat(F.lit("m"), F.col("user_id") % 10).alias("model")).alias("config"), F.struct(F.round("value", 2).alias("score"), F.lit(0.5).alias("latency"), (F.col("event_id") % 100).alias("num_samples"), F.when(F.col("event_id") % 4 == 0, 10.0).alias("runtime_inference"), (F.col("event_id") % 3 - 0.5).alias("coverage")).alias("evaluation")))
    rows = table(spark, sf_dir, "events").select("event_id", body.alias("body"))
    figures = derived_figures(F.col("body"))
    return rows.select("event_id", first_path(F.col("body"), "$.meta.model_name", "$.config.model").alias("model"), first_path(F.col("body"), "$.evaluation.score").cast("double").alias("score"), F.round(figures["runtime_inference"], 6).alias("runtime_inference"), figures["coverage"].alias("coverage"))
