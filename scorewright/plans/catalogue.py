"""Queries that run built-in tasks from their configuration alone, over samples and answers derived from the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from scorewright.functions import detections, edits, judgements, trees
from scorewright.plans.registry import query
from scorewright.plans.views import short_batches, spread, table
from scorewright.tasks.catalogue import GENRES, VOCAL_SOUNDS, list_tasks, task_config
from scorewright.tasks.run import Task


def _report(name: str, parts: dict[str, DataFrame], prediction: Column, mode: str = "direct", run: int = 0, judgement: Column | None = None, even: bool = False) -> DataFrame:
    """The task's report; the answer is an expression over the sample that a record came from.

    ``even`` spreads the records over tasks, for metrics that take long for a record.
    """

    def answered(rows: DataFrame) -> DataFrame:
        rows = (spread(rows, "index") if even else rows).withColumn("prediction", prediction)
        return rows if judgement is None else rows.withColumn("judgement", judgement)

    out = Task(task_config(name)).evaluate(parts, answered, mode, run)
    return out.select("task", "grp", "whole", "num_samples", *[F.round(c, 6).alias(c) for c in out.columns[4:]])


def _sql(name: str, rows: str, group: str, **scores: str) -> str:
    """The report in SQL: a mean for each group and over all rows."""
    named = ", ".join(f"{v} AS {k}" for k, v in scores.items())
    means = ", ".join(f"round(avg({k}), 6) AS {k}" for k in scores)
    return f"WITH s AS ({rows}), x AS (SELECT {group} AS g, {named} FROM s) SELECT '{name}' AS task, CASE WHEN grouping(g) = 1 THEN 'all' ELSE g END AS grp, grouping(g) = 1 AS whole, count(*) AS num_samples, {means} FROM x GROUP BY CUBE (g)"


def _pick(by: Column, *values: Column | str | None) -> Column:
    """The value whose place is ``by`` modulo their number."""
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(F.pmod(by, F.lit(len(values))) == i, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


S = lambda c: F.col(f"sample.{c}")
_PART = "SELECT *, substr('ABC', p_size % 3 + 1, 1) AS letter, CASE p_size % 3 WHEN 0 THEN 'the ' || p_name WHEN 1 THEN p_brand ELSE p_type END AS content FROM part"


def _parts(spark, sf_dir: str) -> DataFrame:
    """Questions with three or four choices, of which one of the first three is right."""
    letter = F.substr(F.lit("ABC"), (F.col("p_size") % 3 + 1).cast("int"), F.lit(1))
    last = F.when(F.col("p_size") % 2 == 0, F.lit("none of these"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("index"), F.col("p_partkey").alias("id"), F.col("p_name").alias("question"), F.concat(F.lit("the "), F.col("p_name")).alias("choice_a"), F.col("p_brand").alias("choice_b"), F.col("p_type").alias("choice_c"), last.alias("choice_d"), letter.alias("answer"), F.col("p_type").alias("category"), "p_size")
    return rows.withColumn("content", _pick(F.col("p_size"), F.col("choice_a"), F.col("choice_b"), F.col("choice_c"))).withColumn("choices", F.array_compact(F.array("choice_a", "choice_b", "choice_c", "choice_d")))


#: Answers to these questions: after thoughts that name another letter, in brackets, not at all, one letter for all, and null.
def _said(letter: Column) -> Column:
    return _pick(S("id"), F.concat(F.lit("<think>B or D?</think>The answer is "), letter), F.concat(F.lit("I say ("), letter, F.lit(")")), "no idea", "B", None)


_SAID = "CASE WHEN p_partkey % 5 IN (0, 1) OR (p_partkey % 5 = 3 AND letter = 'B') THEN 1.0 ELSE 0.0 END"


@query(_sql("kdtcbench_test", _PART, "p_type", exact_match=_SAID))
def task_kdtcbench_test(spark, sf_dir):
    return _report("kdtcbench_test", {"test": _parts(spark, sf_dir)}, _said(S("answer")), "reasoning")


@query(_sql("kseed_test", _PART, "p_type", exact_match=_SAID))
def task_kseed_test(spark, sf_dir):
    return _report("kseed_test", {"test": _parts(spark, sf_dir)}, _said(S("answer")), "reasoning")


@query(_sql("m3cot_test", _PART, "p_type", exact_match="CASE WHEN p_partkey % 5 IN (0, 1) OR (p_partkey % 5 = 3 AND chr(65 + (p_size % 3 + 1) % (3 + CAST(p_size % 2 = 0 AS INT))) = 'B') THEN 1.0 ELSE 0.0 END"))
def task_m3cot_second_run(spark, sf_dir):
    """The second of the runs that move the choices by one place each: the right letters move along."""
    moved = F.substr(F.lit("ABCD"), F.pmod(S("p_size") % 3 + 1, F.size(S("choices"))).cast("int") + 1, F.lit(1))
    return _report("m3cot_test", {"test": _parts(spark, sf_dir)}, _said(moved), "reasoning", run=1)


@query(_sql("zebralogic_mc_test", _PART, "'zebralogic_mc'", exact_match="CASE WHEN p_partkey % 3 = 0 OR (p_partkey % 3 = 1 AND letter = 'C') THEN 1.0 ELSE 0.0 END"))
def task_zebralogic_mc_test(spark, sf_dir):
    """Labels that name the content of a choice, answers in boxes."""
    samples = _parts(spark, sf_dir).withColumn("letter", F.col("answer")).withColumns({"answer": F.col("content"), "puzzle": F.lit("A puzzle.")})
    said = _pick(S("id"), F.concat(F.lit("<think>A</think>so \\boxed{"), S("letter"), F.lit("}")), "\\boxed{C}", "I do not know")
    return _report("zebralogic_mc_test", {"test": samples}, said, "reasoning")


_MMAU = "CASE WHEN p_partkey % 4 IN (0, 1) THEN 1.0 ELSE 0.0 END"


@query(_sql("mmau_test", _PART, "p_type", mmau_string_match=_MMAU, exact_match="CASE WHEN p_partkey % 4 = 0 THEN 1.0 ELSE 0.0 END"))
def task_mmau_test(spark, sf_dir):
    """Answers that name the right choice alone, in a sentence, together with another choice, or not at all."""
    own = [F.concat(F.lit("brass "), F.col("index"), F.lit(" x"), F.col("p_size") % 3), F.concat(F.lit("steel "), F.col("index"), F.lit(" y")), F.concat(F.lit("tin "), F.col("index"), F.lit(" z"))]
    samples = _parts(spark, sf_dir).withColumn("choices", F.array(*own)).withColumn("answer", F.get("choices", (F.col("p_size") % 3).cast("int")))
    other = F.get(S("choices"), F.pmod(S("p_size") + 1, F.lit(3)).cast("int"))
    said = _pick(S("id"), S("answer"), F.concat(F.lit("it must be "), S("answer"), F.lit(" then")), F.concat(S("answer"), F.lit(" or "), other), "nothing")
    return _report("mmau_test", {"test": samples}, said)


@query(_sql("gtzan_test", "SELECT *, 1 AS one FROM part", "'gtzan_test'", exact_match="CASE WHEN p_partkey % 4 = 0 OR p_partkey % 4 = 1 OR (p_partkey % 4 = 2 AND p_size % 10 = 5) THEN 1.0 ELSE 0.0 END"))
def task_gtzan_test(spark, sf_dir):
    """Labels by class number; both letters and names are right."""
    samples = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("index"), (F.col("p_size") % 10).alias("label"), F.lit(None).cast("string").alias("audio"))
    names = F.array(*[F.lit(g) for g in GENRES])
    said = _pick(S("index"), F.get(names, S("label").cast("int")), F.substr(F.lit("ABCDEFGHIJ"), S("label").cast("int") + 1, F.lit(1)), "Jazz.", "noise")
    return _report("gtzan_test", {"test": samples}, said)


@query(_sql("vocal_sound_test", "SELECT * FROM part", "'vocal_sound_test'", exact_match="CASE WHEN p_partkey % 3 = 0 OR (p_partkey % 3 = 1 AND p_size % 6 = 1) THEN 1.0 ELSE 0.0 END"))
def task_vocal_sound_test(spark, sf_dir):
    """Labels in any case of letters."""
    names = F.array(*[F.lit(v) for v in VOCAL_SOUNDS])
    samples = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("index"), F.upper(F.get(names, (F.col("p_size") % 6).cast("int"))).alias("answer"), F.lit("f").alias("audio"))
    return _report("vocal_sound_test", {"test": samples}, _pick(S("index"), F.concat(F.lit("<think>x</think> "), F.lower(S("answer"))), "B", "C or D"), "reasoning")


@query(_sql("mmmu_validation", "SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'even' ELSE 'odd' END AS half FROM part", "half", exact_match="CASE WHEN half = 'even' THEN CAST(p_size % 3 = 1 AS INT) ELSE CAST(p_size % 3 <> 0 AS INT) END"))
def task_mmmu_validation(spark, sf_dir):
    """Two parts put together; the kind of question chooses the prompt and the steps."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("question"), "p_size")
    choice = rows.where("id % 2 = 0").withColumns({"options": F.concat(F.lit("['it\\'s one', \"two\", '"), F.col("id"), F.lit("']")), "answer": F.lit("B"), "question_type": F.lit("multiple-choice")})
    open_ = rows.where("id % 2 = 1").withColumns({"options": F.lit("[]"), "answer": F.col("p_size").cast("string"), "question_type": F.lit("open")})
    said = F.when(S("question_type") == "open", F.when(S("p_size") % 3 == 0, "I say so").otherwise(F.concat(F.lit("The final answer is "), S("p_size"), F.lit(".")))).otherwise(_pick(S("p_size"), "The answer is A.", "(B) two", "C"))
    return _report("mmmu_validation", {"even": choice, "odd": open_}, said)


@query(_sql("polymath_en_test", "SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'low' ELSE 'high' END AS level FROM orders", "level", exact_match="CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE 0.0 END"))
def task_polymath_en_test(spark, sf_dir):
    """Parts whose names become the category; answers in boxes with braces of their own."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("How much?").alias("question"), F.concat(F.lit("$\\frac{"), F.col("o_custkey"), F.lit("}{7}$")).alias("answer"), "o_custkey")
    box = F.concat(F.lit("<think>\\boxed{0}</think> first \\boxed{1}, no: \\boxed{\\frac{"), S("o_custkey"), F.lit("}{7}}. Done."))
    return _report("polymath_en_test", {"low": rows.where("id % 3 = 0"), "high": rows.where("id % 3 <> 0")}, _pick(S("id"), box, "\\boxed{\\frac{1}{8}}"), "reasoning")


@query(_sql("hmmt_nov_2025_test", "SELECT * FROM orders", "'hmmt_nov_2025'", exact_match="CASE WHEN o_orderkey % 3 < 2 THEN 1.0 ELSE 0.0 END"))
def task_hmmt_nov_2025_test(spark, sf_dir):
    """Numbers are equal in all their spellings."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("problem_idx"), F.lit("Find it.").alias("problem"), F.concat(F.lit("$"), F.col("o_custkey"), F.lit("$")).alias("answer"), "o_custkey")
    return _report("hmmt_nov_2025_test", {"test": rows}, _pick(S("problem_idx"), F.concat(F.lit("\\boxed{"), S("o_custkey"), F.lit("}")), F.concat(F.lit("\\boxed{"), S("o_custkey"), F.lit(".0}")), "\\boxed{x}"))


@query(_sql("vlms_are_biased_test", "SELECT * FROM part", "p_type", exact_match="CASE WHEN p_partkey % 3 = 0 OR (p_partkey % 3 = 1 AND p_size = 4) THEN 1.0 ELSE 0.0 END"))
def task_vlms_are_biased_test(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("How many legs?").alias("prompt"), F.col("p_size").cast("string").alias("ground_truth"), F.lit("4").alias("expected_bias"), F.col("p_type").alias("topic"), F.lit("f").alias("image"))
    return _report("vlms_are_biased_test", {"test": rows}, _pick(S("id"), F.concat(F.lit("There are {"), S("ground_truth"), F.lit("} legs")), "{4}", "{many} {}"))


@query(_sql("cruxeval_o_test", "SELECT * FROM part", "'cruxeval_o'", exact_match="CASE WHEN p_partkey % 4 < 2 OR (p_partkey % 4 = 2 AND p_size = 7) THEN 1.0 ELSE 0.0 END"))
def task_cruxeval_o_test(spark, sf_dir):
    """Literals are equal in all their spellings."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("def f(x): ..").alias("code"), F.lit("1").alias("input"), F.concat(F.lit("['a', "), F.col("p_size"), F.lit("]")).alias("output"), "p_size")
    said = _pick(S("id"), F.concat(F.lit('["a",'), S("p_size"), F.lit("]")), S("output"), "['a', 7,]", "f(x)")
    return _report("cruxeval_o_test", {"test": rows}, said)


@query(_sql("meld_emotion_test", "SELECT * FROM labels", "''", judge_binary="CASE WHEN doc_id % 5 = 0 THEN NULL ELSE quality END", judge_rating="CASE WHEN doc_id % 5 = 0 THEN NULL ELSE (doc_id % 6) / 5.0 END"))
def task_meld_emotion_test(spark, sf_dir):
    """Scores read from what a judge has said; samples that it has not judged have none."""
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("index"), F.lit("Which emotion?").alias("instruction"), F.lit("joy").alias("answer"), F.lit("f").alias("context"), "quality")
    judged = F.when(S("index") % 5 == 0, "").otherwise(F.concat(F.when(S("quality") == 1, "Yes").otherwise("No"), F.lit(", I give 3 of 5, no: "), S("index") % 6))
    return _report("meld_emotion_test", {"test": rows}, F.lit("joy"), judgement=judged)


_NED = "levenshtein(lower(c_name), lower(c_mktsegment || c_name)) / CAST(greatest(length(c_name), length(c_mktsegment || c_name)) AS DOUBLE)"


@query(_sql("example", "SELECT * FROM customer", "''", edit_distance=_NED, anls=f"CASE WHEN {_NED} < 0.5 THEN 1 - {_NED} ELSE 0 END"))
def task_example(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("index"), F.lit("Who?").alias("question"), F.col("c_name").alias("answer"), "c_mktsegment")
    return _report("example", {"test": rows}, F.concat(S("c_mktsegment"), S("answer")))


@query("""WITH j AS (SELECT doc_id % 7 AS judge, doc_id % 4 = 0 AS silent, quality, toxic, doc_id % 10 AS score FROM labels)
SELECT CAST(judge AS INTEGER) AS judge, count(*) AS n, round(avg(CASE WHEN NOT silent THEN score / 10.0 END), 6) AS fluency, round(avg(CASE WHEN NOT silent THEN (quality + (1 - toxic)) / 2.0 END), 6) AS accuracy FROM j GROUP BY judge""")
def judgements_by_rubric(spark, sf_dir):
    """Scores and verdicts by rubric, read from what judges have said."""
    rows = table(spark, sf_dir, "labels")
    yes = lambda c, good: F.when(F.col(c) == good, "true").otherwise("false, I fear")
    said = F.concat(F.lit("**Fluency**: I give "), F.col("doc_id") % 10, F.lit("\n- quality: "), yes("quality", 1), F.lit("\n- safe (no toxic words): "), yes("toxic", 0), F.lit("\n[REASON]: 3, as said"))
    rows = rows.select((F.col("doc_id") % 7).cast("int").alias("judge"), F.when(F.col("doc_id") % 4 == 0, "I cannot tell.").otherwise(said).alias("said"))
    fluency = judgements.by_rubric(F.col("said"), ["fluency"], lambda x: judgements.score(x, 10))["fluency"]
    share = judgements.verdict_share(judgements.by_rubric(F.col("said"), ["quality", "safe (no toxic words)"], judgements.verdict), 2)
    return rows.groupBy("judge").agg(F.count("*").alias("n"), F.round(F.avg(fluency), 6).alias("fluency"), F.round(F.avg(share), 6).alias("accuracy"))


@query("""WITH o AS (SELECT l_orderkey, min(l_linenumber) FILTER (l_returnflag = 'R') AS r, min(l_linenumber) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n FROM lineitem GROUP BY l_orderkey)
SELECT count(*) AS images, count(*) FILTER (r IS NOT NULL AND a IS NOT NULL AND a > r) AS right_of, count(*) FILTER (r IS NOT NULL AND a IS NOT NULL AND a > r AND n < 2) AS alone FROM o""")
def detection_clauses(spark, sf_dir):
    """Lines of an order as objects of an image, side by side: an A to the right of the first R, and at most one N."""
    at = F.col("l_linenumber").cast("double") * 10
    seen = F.struct("l_linenumber", F.col("l_returnflag").alias("class"), F.array(at, F.lit(0.0), at + 2, F.lit(2.0)).alias("box"), F.lit(None).cast("string").alias("color"))
    images = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(seen)).alias("o"))
    objects = F.transform("o", lambda x: F.struct(x["class"].alias("class"), x["box"].alias("box"), x["color"].alias("color"))).cast(detections.OBJECTS)
    wanted = F.lit('[{"class": "R", "count": 1}, {"class": "A", "count": 1, "relation": "right of", "other": 0}]')
    barred = F.lit('[{"class": "N", "count": 2}]')
    images = images.select(objects.alias("o"), F.from_json(wanted, detections.CLAUSES).alias("a"), F.from_json(barred, detections.CLAUSES).alias("b"))
    met = images.select(detections.clauses_met(F.col("o"), F.col("a")).alias("x"), detections.clauses_met(F.col("o"), F.col("a"), F.col("b")).alias("y"))
    return met.agg(F.count("*").alias("images"), F.count_if("x").alias("right_of"), F.count_if("y").alias("alone"))


# --- no SQL: word edits, alignments, trees and automata; tested against plain versions


def _spoken(spark, sf_dir: str) -> DataFrame:
    """Whole turns as what was said."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", F.coalesce("text", F.lit("")).alias("text"), F.lit("f").alias("audio"))
    return turns.withColumn("heard", F.concat(F.lit("Transcription: "), F.regexp_replace(F.lower("text"), " (de|die|the|el) ", " ")))


@query()
def task_librispeech_test_clean(spark, sf_dir):
    return _report("librispeech_test_clean", {"test": _spoken(spark, sf_dir)}, S("heard"), even=True)


@query()
def task_fleurs_en2ko_test(spark, sf_dir):
    """The label is the text of the joined sample of the other language."""
    rows = _spoken(spark, sf_dir).withColumn("transcription", F.concat(F.lit("한국어 "), "text", F.lit(" 끝")))
    said = F.concat(F.lit("한국어 "), F.regexp_replace(S("text"), " (de|die|the|el) ", " "), F.lit(" 끝"))
    return _report("fleurs_en2ko_test", {"en_us": _spoken(spark, sf_dir), "ko_kr": rows}, said, even=True)


def _tagged(spark, sf_dir: str) -> DataFrame:
    """Whole documents with their capitalised words tagged, and answers that miss some words."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").alias("category"), F.lit("f").alias("audio"))
    pairs = F.to_json(F.array(F.struct(F.lit("버그").alias("Korean"), F.lit("bug").alias("English"))))
    return docs.withColumns({"text_pier_labeled": F.regexp_replace(F.lower("text"), r"(?<![\p{L}\p{N}<>])([\p{L}]{9,})(?![\p{L}\p{N}])", "<tag $1>"), "loanwords": pairs, "cs_level": F.lit("word")})


@query()
def task_hike_test(spark, sf_dir):
    """Errors on tagged words of whole documents."""
    said = F.concat(F.lit("버그 "), F.regexp_replace(S("text"), "e", "a"))
    return _report("hike_test", {"test": _tagged(spark, sf_dir)}, said, even=True)


@query()
def tagged_word_errors(spark, sf_dir):
    """Rates on tagged words of whole documents, whose answers lack the words of two letters."""
    rows = _tagged(spark, sf_dir).withColumn("said", F.regexp_replace(F.lower("text"), r"(?<![\p{L}\p{N}])\p{L}{2}(?![\p{L}\p{N}])", ""))
    scored = rows.select("category", edits.pier(F.array("text_pier_labeled"), "said").alias("p"))
    return scored.groupBy("category").agg(F.count("*").alias("num_samples"), F.round(F.avg("p.rate"), 6).alias("rate"), F.round(F.avg("p.pier"), 6).alias("pier"))


@query()
def soft_repetition(spark, sf_dir):
    """Highest (occurrences - 1) x length of a phrase, over whole documents."""
    short_batches(spark)
    rows = table(spark, sf_dir, "documents").select("lang", edits.soft_repeat("text").alias("r"))
    return rows.groupBy("lang").agg(F.count("*").alias("num_samples"), F.round(F.avg("r.score"), 6).alias("score"), F.round(F.avg("r.count"), 6).alias("occurrences"), F.max("r.score").alias("highest"))


@query()
def tree_edit_by_language(spark, sf_dir):
    """Whole pages against themselves with items of lists run together, or without paragraphs."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html").where("html is not null"), "page_id")
    changed = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("html", "</li><li>", " ")).otherwise(F.regexp_replace("html", "<p>", ""))
    rows = pages.select(F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"), trees.tree_edit_score(F.array("html"), changed, F.lit(None).cast("string")).alias("score"))
    return rows.groupBy("lang").agg(F.count("*").alias("num_samples"), F.round(trees.tree_edit_mean(F.col("score")), 6).alias("tree_edit_score"))


def available() -> dict[str, Callable]:
    """Built-in tasks by name, compiled."""
    return {name: Task(task_config(name)) for name in list_tasks()}
