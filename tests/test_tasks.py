"""Tasks from configuration: checking, record builders, conditional keys, chains of steps, and reports."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scorewright.functions import bleu, literals
from scorewright.tasks import config, records, run
from scorewright.tasks.catalogue import TASKS, list_tasks, task_config


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# --- configuration


def test_every_built_in_task_compiles():
    assert len(list_tasks()) == len(TASKS) > 35
    for name in list_tasks():
        assert run.Task(task_config(name)).name == name
        assert run.Task(json.loads(json.dumps(task_config(name)))).name == name  # plain data
    with pytest.raises(ValueError):
        task_config("no such task")


@pytest.mark.parametrize(
    "bad",
    [
        {}, {"task": ""}, {"task": "t", "extra": 1}, {"task": "t", "dataset": {"combine": "zip"}}, {"task": "t", "dataset": {"combine": "join"}},
        {"task": "t", "evaluation": {"target_metrics": {"text_evaluator": {"null_prediction_policy": "x"}}}}, {"task": "t", "evaluation": {"target_metrics": {"text_evaluator": {"no_metric": {}}}}},
    ],
)
def test_wrong_configurations_are_errors(bad):
    with pytest.raises(ValueError):
        run.Task(bad)


def test_files_and_modes(tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"task": "t", "postprocess": {"direct": {"pipeline": ["boxed"]}, "reasoning": None}}))
    task = run.Task(str(path))
    assert config.of_mode(task.config["postprocess"], "direct") == {"pipeline": ["boxed"]}
    assert config.of_mode(task.config["postprocess"], "reasoning") == {} == config.of_mode(None, "direct")
    assert config.of_mode({"asr": {}}, "direct") == {"asr": {}}
    with pytest.raises(ValueError):
        config.of_mode({}, "other")
    assert config.metrics_of({"evaluation": {"target_metrics": {"text_evaluator": {"metrics": {"wer": None}, "group_field": "x"}}}}) == {"wer": {}}


# --- record builders


def built(spark, spec, rows, schema, options=None):
    return records.build(spark.createDataFrame(rows, schema), spec, options).collect()


def test_choices_and_labels(spark):
    spec = {"query": "Q {q}", "choices": {"columns": ["a", "b", "c"], "heading": "\nPick:"}, "label": {"column": "answer", "kinds": ["raw", "content"]}, "category": "q", "meta": ["a", "n"]}
    schema = "index long, q string, a string, b string, c string, answer string, n array<int>"
    got = built(spark, spec, [(1, "x", "one", "two", None, "B", [1]), (2, None, "one", "", "3", "Z", None), (3, "y", None, None, None, None, None)], schema, ["yes", "no"])
    assert [(r["index"], r.query, r.labels, r.options, r.option_contents) for r in got] == [
        ("1", "Q x\nPick:\nA. one\nB. two", ["B", "two"], ["A", "B"], ["one", "two"]),
        ("2", "Q \nPick:\nA. one\nB. \nC. 3", ["Z"], ["A", "B", "C"], ["one", "", "3"]),
        ("3", "Q y", [], ["yes", "no"], []),
    ]
    assert [r.meta for r in got] == [{"a": "one", "n": "[1]", "category": "x"}, {"a": "one"}, {"category": "y"}]
    skip = built(spark, spec | {"choices": {"columns": ["a", "b", "c"], "empty": "skip"}}, [(2, None, "one", "", "3", "3", None)], schema)
    assert skip[0].option_contents == ["one", "3"] and skip[0].labels == ["3"] and skip[0].query == "Q"
    none = built(spark, spec | {"choices": {"columns": ["a", "b", "c"], "null": "None"}}, [(2, None, None, "b", "c", "A", None)], schema)
    assert none[0].labels == ["A", "None"]


def test_kinds_of_labels(spark):
    schema = "index long, answer string, o array<string>, t string"
    rows = [(1, "beta", ["alpha", "Beta"], "['x', \"y z\"]"), (2, " b ", ["alpha", "Beta"], "not a list"), (3, "BETA", None, None), (4, None, ["alpha"], "[1, (2,)]")]
    fold = {"choices": {"list": "o"}, "query": "", "label": {"column": "answer", "fold": True, "kinds": ["letter", "content"]}}
    assert [r.labels for r in built(spark, fold, rows, schema)] == [["B", "Beta"], ["B", "Beta"], [], []]
    either = fold | {"label": {"column": "answer", "kinds": ["letter|raw"]}}
    assert [r.labels for r in built(spark, either, rows, schema)] == [["beta"], ["B"], ["BETA"], []]
    listed = fold | {"choices": {"literal": "t"}}
    assert [r.option_contents for r in built(spark, listed, rows, schema)] == [["x", "y z"], [], [], ["1", "(2,)"]]
    inline = {"choices": {"inline": "answer"}, "query": "", "label": {"column": "t"}}
    assert built(spark, inline, [(1, "Pick. Options: A: red hat, B: blue  hat", None, "A")], schema)[0].option_contents == ["red hat,", "blue hat"]
    named = {"choices": {"fixed": ["bus", "car"]}, "query": "", "label": {"column": "answer", "clean": "map", "map": {0: "bus", 1: "car"}, "kinds": ["letter", "content"]}}
    assert [r.labels for r in built(spark, named, [(1, "1", None, None), (2, "car", None, None), (3, "x", None, None)], schema)] == [["B", "car"], ["B", "car"], []]
    with pytest.raises(ValueError):
        built(spark, {"label": {"column": "answer", "clean": "odd"}, "query": ""}, rows, schema)


def test_instructions_index_and_media(spark):
    spec = {"index": {"name": "set", "number": "n", "width": 4}, "query": "", "instructions": ["one", "two"], "media": {"audio": "f", "image": "g"}}
    rows = [("a", i, "x.wav" if i % 2 else None, None) for i in range(40)]
    got = built(spark, spec, rows, "set string, n int, f string, g string")
    assert got[3]["index"] == "a-0003" and {r.query for r in got} == {"one", "two"}
    assert [len(r.media) for r in got[:2]] == [0, 1] and got[1].media[0].type == "audio"
    assert built(spark, spec, rows, "set string, n int, f string, g string")[5].query == got[5].query
    assert built(spark, spec, [], "set string, n int, f string, g string") == []


# --- prompts, steps and runs


def test_conditional_keys(spark):
    c = {
        "task": "t", "record": {"query": "{q}", "label": {"column": "answer"}, "meta": ["kind"]},
        "prompts": {"conditional_on": "kind", "direct": {"system_prompt": "  ", "task_prompt": {"a": "{}\nShort.", "b": "First: {}"}}, "reasoning": {"system_prompt": "S", "task_prompt": "Think."}},
        "postprocess": {"conditional_on": "kind", "direct": {"pipeline": {"a": ["boxed"], "b": ["think", "multichoice"]}}},
        "evaluation": {"target_metrics": {"text_evaluator": {"exact_match": {}, "group_field": "kind"}}},
    }
    rows = spark.createDataFrame([(1, "q1", "7", "a", "\\boxed{7}"), (2, "q2", "B", "b", "<think>A</think> (B)"), (3, "q3", "x", None, "x"), (4, "q4", None, "a", None)], "index long, q string, answer string, kind string, said string").withColumn("answer", F.col("answer"))
    task = run.Task(c)
    recs = {r["index"]: r for r in task.records({"x": rows}).collect()}
    assert [recs[k].prompt for k in "123"] == ["q1\nShort.", "First: q2", "q3"] and recs["1"].system is None
    assert task.records({"x": rows}, "reasoning").where("system = 'S'").count() == 4
    task.config["record"]["choices"] = {"fixed": ["m", "n"]}
    report = {(r.grp, r.whole): (r.num_samples, r.exact_match) for r in task.evaluate({"x": rows}, lambda r: r.withColumn("prediction", F.col("sample.said"))).collect()}
    assert report == {("a", False): (2, 1.0), ("b", False): (1, 1.0), ("", False): (1, 1.0), ("all", True): (4, 1.0)}


def test_null_policies(spark):
    rows = spark.createDataFrame([(1, "x", None), (2, "x", "x"), (3, "x", "")], "index long, answer string, said string")
    for policy, wanted in (("miss", (3, 1 / 3)), ("skip", (2, 0.5)), ("fallback", (3, 2 / 3))):
        c = {"task": "t", "record": {"query": "q", "label": {"column": "answer"}}, "evaluation": {"target_metrics": {"text_evaluator": {"exact_match": {}, "null_prediction_policy": policy, "fallback_value": "x"}}}}
        got = run.Task(c).evaluate({"a": rows}, lambda r: r.withColumn("prediction", F.col("sample.said"))).where("whole").first()
        assert (got.num_samples, got.exact_match) == pytest.approx(wanted)


def test_runs_turn_choices_and_labels(spark):
    rows = spark.createDataFrame([(1, ["p", "q", "r"], "C"), (2, [], "C"), (3, ["p", "q"], "p")], "id long, choices array<string>, answer string").withColumns({"question": F.lit("?"), "category": F.lit("c")})
    task = run.Task(task_config("m3cot_test"))
    for r, wanted in ((0, [(["p", "q", "r"], ["C"]), ([], ["C"]), (["p", "q"], ["A"])]), (1, [(["r", "p", "q"], ["A"]), ([], ["C"]), (["q", "p"], ["B"])]), (4, [(["r", "p", "q"], ["A"]), ([], ["C"]), (["p", "q"], ["A"])])):
        assert [(x.option_contents, x.labels) for x in task.records({"a": rows}, run=r).orderBy("index").collect()] == wanted


def test_parts_are_put_together(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, transcription string").withColumn("audio", F.lit("f"))
    b = spark.createDataFrame([(1, "eins"), (3, "drei")], "id long, transcription string").withColumn("audio", F.lit("g"))
    joined = run.Task(task_config("fleurs_en2ko_test")).records({"en": a, "ko_kr": b}).collect()
    assert [(r["index"], r.labels) for r in joined] == [("1", ["eins"])]
    both = run.Task({"task": "t", "dataset": {"combine": "concatenate"}, "record": {"index": "id", "query": "", "category": "dataset_name"}}).records({"en": a, "ko": b})
    assert sorted(r.meta["category"] for r in both.collect()) == ["en", "en", "ko", "ko"]
    some = run.Task({"task": "t", "dataset": {"subset": {"id": [2, 3]}}, "record": {"index": "id", "query": ""}}).records({"en": a})
    assert [r["index"] for r in some.collect()] == ["2"]
    with pytest.raises(ValueError):
        run.Task({"task": "t"}).samples({"en": a, "ko": b})


def test_steps_of_speech(spark):
    assert one(spark, run.spoken(F.lit("Transcription: 'hello there'"))) == "hello there"
    assert one(spark, run.spoken(F.lit("The text is 안녕 bug 하세요. ok"), "default_korean")) == "안녕 bug 하세요."
    assert one(spark, run.spoken(F.lit("plain words"), "default_chinese")) == "plain words"
    assert one(spark, run.spoken(F.lit("好"), "default_chinese")) == "好"
    pairs = F.lit(json.dumps([{"Korean": "버그", "English": "bug"}], ensure_ascii=False))
    assert one(spark, run.code_switched(F.lit("버그는 <eng> It's   DONE, won't—stop!"), pairs)) == "bug 는 it is done will not stop"
    assert one(spark, run.code_switched(F.lit("a" * 100_000 + "가"), F.lit(None).cast("string"))) == "a" * 100_000 + " 가"
    assert one(spark, run.code_switched(F.lit(None).cast("string"))) is None


def test_own_steps_metrics_and_builder(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, "cd")], "id long, v string")
    c = {"task": "own", "postprocess": {"reverse": {"times": 1}}, "evaluation": {"target_metrics": {"text_evaluator": {"same": {}}}}}
    builder = lambda s, _: records.build(s, {"index": "id", "query": "{v}", "label": {"column": "v"}})
    task = run.Task(c, steps={"reverse": lambda x, times: F.reverse(x)}, metrics={"same": lambda labels, p: F.array_contains(labels, p).cast("double")}, builder=builder)
    assert task.evaluate({"a": rows}, lambda r: r.withColumn("prediction", F.lit("ba"))).where("whole").first().same == 0.5
    with pytest.raises(ValueError):
        run.Task(c | {"postprocess": {"none": {}}}, metrics={"same": lambda labels, p: F.lit(1.0)}).answers(rows.withColumn("prediction", F.lit("x")))


# --- literals and BLEU


def test_literals(spark):
    rows = [("[1,2 , 'x']", "[1, 2, 'x']"), ("{ 'b':1 }", "{'b': 1}"), ("{3,1}", "{1, 3}"), ("(1,)", "(1,)"), ("  plain text ", "plain text"), ("__import__('os')", "__import__('os')"), (None, None), ("", ""), ("[" * 5000, "[" * 5000), ("set()", "set()"), ("-1.50", "-1.5")]
    assert [r.x for r in spark.createDataFrame([(t,) for t, _ in rows], "t string").select(literals.canonical_literal("t").alias("x")).collect()] == [x for _, x in rows]


def plain_bleu(pairs, order, smooth, length):
    said = reference = 0
    match, total = [0] * order, [0] * order
    for labels, text in pairs:
        p, refs = bleu.tokens_13a(text), [bleu.tokens_13a(x) for x in labels]
        said += len(p)
        reference += min((abs(len(r) - len(p)), len(r)) for r in refs)[1] if length == "closest" else min(map(len, refs))
        for n in range(order):
            grams = lambda w: Counter(tuple(w[i : i + n + 1]) for i in range(len(w) - n))  # noqa: B023, E731
            for g, c in grams(p).items():
                match[n] += min(c, max(grams(r)[g] for r in refs))
            total[n] += max(0, len(p) - n)
    if not match[0]:
        return 0.0
    k, logs, used = 0, 0.0, 0
    for m, t in zip(match, total, strict=True):
        if smooth and not t:
            continue
        if not m:
            if not smooth:
                return 0.0
            k += 1
            m = 0.5**k
        logs, used = logs + math.log(m / t), used + 1
    return (1.0 if said >= reference else math.exp(1 - reference / said)) * math.exp(logs / used)


def test_bleu_is_that_of_the_definition(spark):
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice(["a", "b", "c.", "d,e", "1.5"]) for _ in range(rng.randrange(1, 12)))
    pairs = [([text() for _ in range(rng.randrange(1, 4))], text()) for _ in range(60)] + [(["a b"], ""), (["x y z"], "a")]
    df = spark.createDataFrame([(i, labels, p) for i, (labels, p) in enumerate(pairs)], "i long, labels array<string>, p string")
    for length in ("closest", "shortest"):
        stats = df.select("i", bleu.bleu_stats("labels", "p", F.lit(length)).alias("s"))
        for order in (1, 2, 4):
            assert stats.agg(bleu.corpus_score(F.col("s"), order).alias("x")).first().x == pytest.approx(plain_bleu(pairs, order, False, length))
        rows = stats.orderBy("i").select(bleu.score(bleu.fields(F.col("s")), smooth=True).alias("x")).collect()
        assert [r.x for r in rows] == pytest.approx([plain_bleu([pair], 4, True, length) for pair in pairs])
    odd = spark.createDataFrame([(None, "a"), ([], "a"), ([None], "a"), (["a"], None)], "labels array<string>, p string")
    assert odd.agg(bleu.corpus_score(bleu.bleu_stats("labels", "p", F.lit("closest")))).first()[0] == 0.0


def test_13a_tokens():
    assert bleu.tokens_13a("Hello, world! It's 3.14 (pi); no-one &amp; a-\nb 5-6.") == ["Hello", ",", "world", "!", "It's", "3.14", "(", "pi", ")", ";", "no-one", "&", "ab", "5", "-", "6", "."]


# --- reports without SQL, against plain Python


def test_speech_report_is_that_of_plain_python(spark, sf):
    from scorewright.plans.catalogue import _spoken, task_librispeech_test_clean

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rows = [(r.text.lower(), r.heard.removeprefix("Transcription: ").strip()) for r in _spoken(spark, sf).collect() if r.text]
    got = task_librispeech_test_clean(spark, sf).where("whole").first()
    assert got.num_samples >= len(rows)
    assert got.wer == pytest.approx(sum(edits(a.split(), b.split()) for a, b in rows) / sum(len(a.split()) for a, _ in rows), abs=2e-6)


def test_steps_of_places_and_versions_and_accuracy_over_disciplines(spark):
    config = {
        "task": "places", "record": {"index": "i", "query": "{q}", "label": {"column": "a"}, "meta": ["question_type"]},
        "postprocess": {"direct": {"pipeline": {"spatial_grounding": {"version_name": "point"}}}, "reasoning": {"pipeline": {"multichoice": {"version_name": "numeric"}}}},
        "evaluation": {"target_metrics": {"text_evaluator": {"mmmu_accuracy": {}}}},
    }
    task = run.Task(config)
    samples = spark.createDataFrame([(1, "where?", "3", "open")], "i long, q string, a string, question_type string")
    rows = task.records({"all": samples}).withColumn("prediction", F.lit("정답은 3번 (1, 2, 3, 4)"))
    assert [r["answer"] for r in task.answers(rows).collect()] == ["[2.0, 3.0]"]
    scored = task.scored(task.answers(rows, mode="reasoning")).first()
    assert (scored["answer"], scored["mmmu_accuracy"]) == ("3", 1.0)
