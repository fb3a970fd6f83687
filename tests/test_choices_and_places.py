"""Choices, places, open answers, kinds of benchmarks and submissions: cases with a defined result, long texts, nulls."""

import time

import pytest
from pyspark.sql import functions as F

from scorewright.functions import benchmarks, choices as ch, grounding, open_answers as oa
from scorewright.operators import submission as sub

LIST = "Pick:\nA) x\nB) y\nC) z"
LONG = ["answer is" + " " * 100_000 + "!", "\n" * 100_000 + "A) x\n", "(" * 100_000, "\\boxed{" * 20_000, "<point " * 20_000, "[1," * 50_000, "1" * 100_000 + "x", "1" + ",234" * 100_000, "A " * 100_000, " " * 200_000 + "x", "is " * 50_000, "=1" * 50_000, "so " + "1," * 50_000]


def over(spark, column, data, schema):
    return [r["x"] for r in spark.createDataFrame(data, schema).coalesce(1).select(column.alias("x")).collect()]


@pytest.mark.parametrize("version, said", [
    ("numeric", {"①": "1", "정답은 2번": "2", "3번": "3", "x\n(4)": "4", "answer: 12": None, "ans: 5 because": "5", "\\boxed{**7**}": "7", "": None}),
    ("alpha", {"answer is b": "B", "Ｃ": "C", "x\nd) foo": "D", "Answer: Apple": None, "select  (e)": "E", "option F is right": "F", "\\boxed{A} so \\boxed{ (b) }": "B", "a\nb\nc\nz\ny\nx": None, "one\n`g`": "G"}),
    ("circled", {"③ 8": "③", "answer: ②": "②", "정답은 1입니다": "①", "⑤": "⑤", "none": None}),
])
def test_choice_of_a_fixed_scheme(spark, version, said):
    found = over(spark, ch.choice(F.col("t"), version=version), [(t,) for t in said], "t string")
    assert dict(zip(said, found, strict=True)) == said


def test_choice_by_the_question(spark):
    said = {"The answer is (C)": "C", "I choose option B.": "B", "정답은 B입니다": "B", "reason\nmore\n**C**": "C", "no idea": None, "Ｂ": "Ｂ", "(A)</think> C. because": "C", "answer is 3": None, "b": "b", "": None}
    assert dict(zip(said, over(spark, ch.choice(F.col("t"), F.col("q")), [(t, LIST) for t in said], "t string, q string"), strict=True)) == said
    assert over(spark, ch.choice(F.col("t"), F.col("q")), [(None, LIST), ("the answer is A", None), ("the answer is A", "no list")], "t string, q string") == [None] * 3
    # A find that is no choice of the list counts only where no other find is one.
    assert over(spark, ch.choice(F.col("t"), options=F.col("o")), [("answer: a, or select B", ["A", "B"]), ("answer: a", ["A", "B"]), ("answer: a, or select B", ["a", "b"])], "t string, o array<string>") == ["B", "a", "a"]


def test_scheme(spark):
    asked = {LIST: "letter", "1. a\n2. b": "number", "(A) x (b) y": "letter", "① a\n② b": "circled", "A) 1\n1) 2\n2) 3\n3) 4": "number", "A) a\nB) b\n1) 1\n2) 2": "letter", "A. only\nA. again": None, "none": None, "": None}
    assert dict(zip(asked, over(spark, ch.scheme(F.col("t")), [(t,) for t in asked], "t string"), strict=True)) == asked
    rows = [(LIST, ["1", " 2 "], None), (LIST, None, ["①", "⑩"]), (LIST, [], []), (LIST, ["x", None], None), (None, ["A", "1"], ["1"]), (None, None, None)]
    assert over(spark, ch.scheme(F.col("q"), F.col("o"), F.col("c")), rows, "q string, o array<string>, c array<string>") == ["number", "circled", "letter", None, "letter", None]
    with pytest.raises(ValueError, match="korean"):
        ch.choice(F.lit("a"), version="korean")


def test_science_letter(spark):
    said = {"Answer: $\\boxed{c}$": "C", "answer: $ b $": "B", "Answer: Z": "Z", "\\boxed{A} \\boxed{\\text{d}}": "D", "\\boxed{A} \\boxed{b}": "B", "": "", "so it is": ""}
    assert dict(zip(said, over(spark, ch.science_letter(F.col("t")), [(t,) for t in said], "t string"), strict=True)) == said


def test_place(spark):
    said = ["at [1, 2, 3, 4] or (5,6)", "<points x1='580' y1=\"701\" alt='k'>", "<point><x>3, 4</x></point>", "pyautogui.click(x=5, y=.5)", "[0,0,2,0,2,2,0,2] and [1,1]", "so 1 2 3 4 5", "none", None, "", "<think>[9,9,9,9]</think> {1,2,3,4}", "［1，2，3，4］", "[1,2,3] [7,8]", "<point y1=1 x1=2> (3, 4)"]
    expected = {
        "bbox": [[1, 2, 3, 4], None, None, None, [0, 0, 2, 2], [2, 3, 4, 5], None, None, None, [1, 2, 3, 4], [1, 2, 3, 4], None, None],
        "point": [[2, 3], [580, 701], [3, 4], [5, 0.5], [1, 1], [4, 5], None, None, None, [2, 3], [2, 3], [7, 8], [3, 4]],
        "quad": [[1, 2, 3, 2, 3, 4, 1, 4], None, None, None, [0, 0, 2, 0, 2, 2, 0, 2], None, None, None, None, [1, 2, 3, 2, 3, 4, 1, 4], [1, 2, 3, 2, 3, 4, 1, 4], None, None],
    }
    for target, places in expected.items():
        assert over(spark, grounding.place(F.col("t"), target), [(t,) for t in said], "t string") == places
    assert over(spark, grounding.as_text(grounding.place(F.col("t"))), [("(0.05, .35, -0.26, 1)",)], "t string") == ["[0.05, 0.35, -0.26, 1.0]"]
    with pytest.raises(ValueError, match="circle"):
        grounding.place(F.lit("a"), "circle")


ROW = "p string, l array<string>, o array<string>, c array<string>, k string"


def accuracy(spark, data):
    return over(spark, oa.discipline_accuracy(*map(F.col, "plock")), data, ROW)


def test_discipline_accuracy_of_choices(spark):
    data = [("(A) no, (B)", ["B"], None, ["red", "blue"], None), ("A B said", ["B"], None, ["x", "y"], None), ("It is A.", ["A"], ["A", "B"], None, None), ("B.", ["B"], None, ["x", None], None), ("well the colour must surely be blue", ["B"], None, ["red", "blue"], ""),
            ("red then blue and then more red", ["A"], None, ["red", "blue"], "multiple-choice"), ("RED it is, so it seems now", ["A"], None, ["red", ""], None), ("(A)", None, None, ["x"], None), ("(A)", [None, "A"], None, ["x"], None), ("x", ["y"], None, None, "multiple-choice")]
    assert accuracy(spark, data) == [1, 1, 1, 1, 1, 1, 1, 0, 1, 0]
    # Without a named choice one is drawn: always the same, and always a choice.
    drawn = [(f"hm{i}", [w], None, ["x", "y"], None) for i in range(20) for w in "AB"]
    first = accuracy(spark, drawn)
    assert first == accuracy(spark, drawn) and all(a + b == 1 for a, b in zip(first[::2], first[1::2], strict=True)) and len(set(first[::2])) == 2


def test_discipline_accuracy_of_open_answers(spark):
    data = [("so the answer is 1,234.50", ["1234.5"], None, None, "open"), ("x = 5\nthus y = 7.", ["7"], None, None, None), ("x = 5\nthus y = 7.", ["5"], None, None, None), (None, ["a"], None, None, "open"), ("is a", ["a"], None, None, "open-ended"), ("the cat", ["a"], None, None, "open"),
            ("1e3 wins", ["1000"], None, None, ""), ("nan", ["nan"], None, None, None), ("is paris france", ["France"], [], [], ""), ("q", None, None, None, None), ("the result is 0.333", ["0.33"], None, None, None), ("it is -3", ["3"], ["A"], None, "open")]
    assert accuracy(spark, data) == [1, 1, 0, 0, 1, 0, 1, 0, 1, 0, 1, 0]
    (forms,) = over(spark, oa.open_forms(F.col("t")), [("is 1.25, and -3 or 12,345 then 2.5e3 a5",)], "t string")
    assert [f["number"] for f in forms[1:]] == [12345, 2500, 1, -3, 345, 2, 3, 5]


def test_long_texts_take_linear_time(spark):
    t = F.col("t")
    began = time.monotonic()
    none = F.lit(None).cast("array<string>")
    found = F.struct(ch.choice(t, t), ch.choice(t, version="alpha"), ch.science_letter(t), grounding.place(t, "point"), oa.open_match(t, F.array(F.lit("zz"))), oa.discipline_accuracy(t, F.array(F.lit("Q")), none, F.array(F.lit("q1"), F.lit("q2")), F.lit(None).cast("string")))
    assert len(over(spark, found, [(x,) for x in LONG], "t string")) == len(LONG)
    assert time.monotonic() - began < 60


def test_modality(spark):
    rows = [("mmau_test", None, None), ("longvideobench", "vision", None), ("video_mmmu", None, None), ("MMStar", None, None), ("gsm8k", "vision", None), ("gsm8k", " Audio ", "text"), ("mmau", "video", "image"), ("gsm8k", None, None), (None, None, None)]
    of = over(spark, benchmarks.modality(F.col("n"), F.col("s"), F.col("m")), rows, "n string, s string, m string")
    assert of == ["audio", "video", "video", "image", "image", "audio", "image", "text", "text"]
    asked = [("mmstar", ""), ("mmstar", "text"), ("x", "video"), ("asr_x", None), ("x", None)]
    for kinds, wanted in {("vision",): [True, False, True, False, False], ("audio",): [False, False, False, True, False], ("text",): [False, True, False, False, True], ("text", "Vision", "audio"): [True] * 5, ("other",): [False] * 5, (): [True] * 5}.items():
        assert over(spark, benchmarks.asked_for(list(kinds), F.col("n"), F.col("s")), asked, "n string, s string") == wanted
    assert over(spark, benchmarks.stated_or_engine(F.col("n"), F.col("s")), [(None, " Audio-Bench"), ("text", "audio_bench"), (None, None)], "n string, s string") == ["audio", "text", None]


def test_submission_formats(spark):
    names = {"DocVQA_test": "rrc", "docvqa_validation": None, "chartqa_test": None, "vqav2_test": "eval_server", "mmau_test": "audio_server", "VizWiz_test": "vizwiz", "mmbench_test": "template", "mmbench_dev_en": None, "x": None}
    assert {n: sub.format_of(n) for n in names} == names
    df = spark.createDataFrame([(1, None, {"task": "sound"}), (2, "Yes", None)], "k long, prediction string, meta map<string,string>")
    assert [tuple(r) for r in sub.submission("mmau_test", df, "k").orderBy("id").collect()] == [("1", "", "", "", "", "sound", ""), ("2", "", "Yes", "", "", "", "")]
    assert sub.submission("x", df, "k") is None
    template = spark.createDataFrame([(2, "q2"), (3, "q3")], "k long, question string")
    assert sorted((r["k"], r["prediction"]) for r in sub.submission("mmbench_test", df, "k", template).collect()) == [(2, "Yes"), (3, "")]
    with pytest.raises(ValueError, match="template"):
        sub.submission("mmbench_test", df, "k")
