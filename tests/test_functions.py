"""Metrics, extraction and checks on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from scorewright.functions import checks, extract, metrics as m, text as t
from scorewright.operators import aggregate as agg, dataset as ds, leaderboard as lb
from scorewright.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def labels(*xs):
    return F.array(*map(F.lit, xs))


@pytest.mark.parametrize(
    "want, got, relative, score",
    [("yes", "yes", None, 1), ("yes", "no", None, 0), ("Cat.", "cat", None, 1), ("3.0", "3", None, 1), ("1", "①", None, 1), ("100", "103", None, 0), ("100", "103", 0.05, 1), ("100", "106", 0.05, 0), ("0", "0", 0.05, 0), ("3f", "3", None, 0)],
)
def test_exact_match(spark, want, got, relative, score):
    assert one(spark, m.exact_match(labels(want), F.lit(got), relative)) == score


def test_string_and_substring(spark):
    assert one(spark, m.string_match(labels("b c"), F.lit("a b c d"))) == 1
    assert one(spark, m.string_match(labels("a b"), F.lit("a\nb c"))) == 1
    assert one(spark, m.string_match(labels(""), F.lit("x"))) == 1
    assert one(spark, m.string_match(labels("z"), F.lit("a"))) == 0
    assert one(spark, m.substring_match(labels("b c"), F.lit("a b c d"))) == 1
    assert one(spark, m.substring_match(labels("x y"), F.lit("a b c d"))) == 0


@pytest.mark.parametrize("want, got, d", [("abc", "abc", 0), ("abc", "abxc", 0.25), ("abc", "abd", 1 / 3), ("kitten", "sitting", 3 / 7), ("abc", "xabc", 0.25), ("", "", 0), ("é", "e", 1)])
def test_edit_distance(spark, want, got, d):
    assert one(spark, m.ned_min(labels(want), F.lit(got))) == pytest.approx(d)


def test_anls_and_jaccard(spark):
    assert one(spark, m.anls(labels("abc"), F.lit("abd"))) == pytest.approx(2 / 3)
    assert one(spark, m.anls(labels("ab"), F.lit("xb"))) == 0
    assert one(spark, m.jaccard_distance(labels("a b"), F.lit("a b c"))) == pytest.approx(1 / 3)


def test_token_f1(spark):
    scores = m.token_prf(t.gram_overlaps(labels("cat dog bird"), F.lit("cat dog"), F.lit(1)))
    p, r, f = (one(spark, m.best_field(scores, k)) for k in "prf")
    assert (p, r, f) == (1, pytest.approx(2 / 3), pytest.approx(0.8))
    assert one(spark, t.squad_normalize(F.lit("The A Cat."))) == "cat"
    assert one(spark, t.gram_overlaps(labels("a a b", ""), F.lit("a a  a\nc"), F.lit(2))) == [[2, 3, 4, 1, 2, 3], [0, 0, 4, 0, 0, 3]]


def test_vqa_and_options(spark):
    for n in (1, 2, 3):
        assert one(spark, m.vqa_score(labels(*["cat"] * n), F.lit("cat"))) == pytest.approx(n / 3)
    options = labels("cat", "dog")
    for got, score in (("the cat", 1), ("dog", 0), ("cat dog", 0), ("", 0)):
        assert one(spark, m.option_words_match(F.lit("cat"), F.lit(got), options)) == score


def test_boxes_and_intervals(spark):
    box = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    assert one(spark, m.box_iou(box(0, 0, 10, 10), box(5, 0, 15, 10))) == pytest.approx(1 / 3)
    assert one(spark, m.box_iou(box(0, 0, 10), box(5, 0, 15, 10))) == 0
    for b, iou in (((10, 20), 1), ((15, 25), 1 / 3), ((30, 40), 0)):
        assert one(spark, m.interval_iou(F.lit(10.0), F.lit(20.0), *[F.lit(float(x)) for x in b])) == pytest.approx(iou)


def test_extraction(spark):
    x = lambda column: one(spark, column)
    assert x(extract.boxed(F.lit(r"so \boxed{1} and \boxed{\frac{1}{2}}"))) == r"\frac{1}{2}"
    assert x(extract.boxed(F.lit("none"))) is None
    assert [x(extract.multichoice(F.lit(s))) for s in ("The answer is (C)", "I say (B).", "text\nD.\n", "it is A", "hmm")] == ["C", "B", "D", "A", None]
    assert [x(extract.binary(F.lit(s))) for s in ("Yes, it is.", "No it isn't.", "That is not true", "correct", "maybe")] == ["yes", "no", "no", "yes", None]
    assert x(extract.think(F.lit("<think>a b</think> c"))).asDict() == {"reasoning": "a b", "answer": "c"}
    assert x(extract.interval(F.lit("1:05 - 2:10 and then 3:00 to 1:00:01"))).asDict() == {"start": 180.0, "end": 3601.0}
    assert x(extract.box(F.lit("at [1, 2, 3, 4] or (5, 6)"))) == [1, 2, 3, 4]
    assert x(extract.code_block(F.lit("a\n```py\nx\n```"))) == "x\n"
    assert x(extract.transcript(F.lit("Transcript: 'hello'"))) == "hello"
    assert x(extract.chain(F.lit("<think>q</think> \\boxed{7}"), [lambda c: extract.think(c)["answer"], extract.boxed, extract.curly])) == "7"


CASES = [
    ("word_count_range", "a b c", {"low": 2, "high": 3}, True), ("unique_words", "a a b", {"n": 3}, False), ("number_count", "1 22 x3", {"n": 3}, True),
    ("alphabet_loop", "ask bob can", {}, True), ("alphabet_loop", "ask can", {}, False), ("alphabet_loop", "zoo ant", {}, True), ("consonant_clusters", "trip stop", {}, True),
    ("nested_parentheses", "((([{x}])))", {}, True), ("nested_parentheses", "(((())", {}, False), ("prime_lengths", "ab abc", {}, True), ("prime_lengths", "abcd", {}, False),
    ("newline_words", "a\nb\n", {}, True), ("equal_sentences", "Abc. Def. Ghi.", {}, True), ("limited_repeats", "a a a", {"n": 2}, False), ("last_word_first_next", "Go home. Home is far.", {}, True),
    ("no_consecutive_first_letter", "ask all", {}, False), ("indent_stairs", "a\n b\n  c", {}, True), ("print_multiples", "7, 14, 21, 28, 35, 42", {}, False), ("print_multiples", "14 21 28 35 42 49", {}, True),
    ("date_list", "1769-01-01, 1800-02-28", {}, True), ("date_list", "1800-02-30", {}, False), ("title_case", "All Of It", {}, True), ("no_whitespace", "abc", {}, True), ("no_whitespace", "a b", {}, False),
    ("incrementing_words", "One. Two words. Three words here.", {}, True), ("words_position", "in the end of the day", {}, True), ("words_position", "in the end of the day", {"word": "end"}, False),
    ("quote_explanation", '"a" "b"', {}, False), ("output_template", "My Answer: x My Conclusion: y Future Outlook: z", {}, True), ("stop_word_percentage", "", {}, False),
]


@pytest.mark.parametrize("name, text, parameters, ok", CASES)
def test_checks(spark, name, text, parameters, ok):
    assert one(spark, checks.strict(F.lit(text), name, **parameters)) == ok


def test_loose_and_unknown_checks(spark):
    assert one(spark, checks.strict(F.lit("Sure!\n**abc**"), "no_whitespace")) is False
    assert one(spark, checks.loose(F.lit("Sure!\n**abc**"), "no_whitespace")) is True
    with pytest.raises(ValueError):
        checks.strict(F.lit("x"), "no such check")


@pytest.mark.parametrize("ab, ba, w", [(None, None, "tie"), ("A", None, "A"), (None, "B", "A"), ("A", "B", "A"), ("B", "A", "B"), ("A", "A", "tie")])
def test_swap(spark, ab, ba, w):
    assert one(spark, agg.swap_verdict(F.lit(ab).cast("string"), F.lit(ba).cast("string"))) == w


def test_dataset_operators(spark):
    df = spark.createDataFrame([(i, f"k{i % 3}") for i in range(10)], "i long, k string")
    assert [r.ordinal for r in ds.numbered(df, "i").orderBy("i").collect()] == list(range(10))
    assert [r.n for r in ds.shards(df, "i", 4).groupBy("shard").agg(F.count("*").alias("n")).orderBy("shard").collect()] == [3, 3, 2, 2]
    assert ds.subset(df, {"k": ["k1"], "i": [1, 4]}).count() == 2 and ds.subset(df, {"absent": 1}).count() == 0
    assert ds.null_policy(df.withColumn("p", F.lit(None).cast("string")), "p", "skip").count() == 0
    nan = spark.createDataFrame([("a", 1.0), ("a", float("nan")), (None, 5.0)], "g string, v double")
    assert agg.group_means(nan, F.col("g"), ["v"]).collect()[0].asDict() == {"category": "a", "num_samples": 2, "v": 1.0}


def test_leaderboard_helpers(spark):
    assert [one(spark, lb.rescale(F.lit(x))) for x in (0.5, 50.0, 500.0)] == [50, 50, 50]
    assert [one(spark, lb.duration(F.lit(x))) for x in (5, 65, 3700)] == ["5s", "1m 5s", "1h 1m"]
    assert [one(spark, lb.checkpoint_number(F.lit(x))) for x in ("step12", "base")] == [12, -1]


def test_files(spark, tmp_path):
    folder = tmp_path / "m1"
    folder.mkdir()
    (folder / "quiz__direct.json").write_text(json.dumps({"metrics": {"acc": 0.5, "f1": 0.25}}))
    got = files.metric_rows(files.scan_results(spark, f"{tmp_path}/*/*.json", "metrics map<string,double>")).select("model", "benchmark", "metric", "value").collect()
    assert sorted(map(tuple, got)) == [("m1", "quiz", "acc", 0.5), ("m1", "quiz", "f1", 0.25)]
    files.write_records(spark.createDataFrame([(1, float("nan"))], "i long, v double"), str(tmp_path / "out.jsonl"))
    assert "NaN" not in "".join(p.read_text() for p in (tmp_path / "out.jsonl").glob("part*"))
    assert files.read_records(spark, str(tmp_path / "out.jsonl")).count() == 1
    with pytest.raises(ValueError):
        files.read_records(spark, "x.pkl")
