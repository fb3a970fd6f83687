"""Parsers of judgements, and clauses over detected objects."""

import pytest
from pyspark.sql import functions as F

from scorewright.functions import detections as d, judgements as j


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("(good, bad)", ["good", "bad"]), ("good, bad", ["good", "bad"]), ("only one", ["only one", None]), ("(a (x,y), b)", ["a (x,y)", "b"]), ("a, b, c", ["a", "b, c"]), ("(a), (b)", ["(a)", "(b)"]),
        ("((a, b))", ["(a, b)", None]), ("", ["", None]), (None, None), (") , x", [")", "x"]), ("a (b, c", ["a (b, c", None]), ("(" * 3000 + "a,b" + ")" * 3000 + ",c", ["(" * 3000 + "a,b" + ")" * 3000, "c"]),
    ],
)
def test_split_top(spark, text, parts):
    got = one(spark, j.split_top(F.lit(text).cast("string")))
    assert got == parts or (text is None and (got is None or got == [None, None]))


def test_reasons_scores_and_verdicts(spark):
    s = lambda f, *a: [one(spark, f(F.lit(t).cast("string"), *a)) for t in ("[REASON]: it is good", "Reason: clear", "no tag", None, "")]
    assert s(j.reason) == ["it is good", "clear", None, None, None]
    for text, most, wanted in (("Score: 8", None, 8.0), ("Score: 8", 10, 0.8), ("I give 3 of 5", None, 5.0), ("", None, None), ("no number here", None, None), ("[Rating]: [7.5]\nof 10", 10, 0.75)):
        assert one(spark, j.score(F.lit(text), most)) == wanted
    for text, wanted in (("the answer is true", True), ("definitely false", False), ("Yes, but no", False), ("unknown", None), ("", None), ("incorrect", False)):
        assert one(spark, j.verdict(F.lit(text))) is wanted
    for text, wanted in (("Choice: A", "A"), ("[[B]]", "B"), ("winner = tie", "TIE"), ("Choice: Another", None), ("", None)):
        assert one(spark, j.choice(F.lit(text))) == wanted


def test_rubrics(spark):
    names = ["coherence", "fluency (1-5)"]
    text = F.lit("**coherence**: 8\n- Fluency (1-5): 6 of 9\nother: 1")
    assert one(spark, j.by_rubric(text, names)) == {"coherence": 8.0, "fluency (1-5)": 9.0}
    assert one(spark, j.by_rubric(F.lit("coherence: well written"), ["coherence"], lambda x: x)) == {"coherence": "well written"}
    yes = j.by_rubric(F.lit("coherence: true\nfluency (1-5): false"), names, j.verdict)
    assert one(spark, yes) == {"coherence": True, "fluency (1-5)": False} and one(spark, j.verdict_share(yes, 2)) == 0.5
    assert one(spark, j.verdict_share(j.by_rubric(F.lit("none"), names, j.verdict), 2)) is None


def test_relations(spark):
    box = lambda x, y: F.array(*[F.lit(float(v)) for v in (x - 1, y - 1, x + 1, y + 1)])
    for (x, y), wanted in (((9, 0), ["right of"]), ((-9, 0), ["left of"]), ((0, -9), ["above"]), ((0, 9), ["below"]), ((9, 9), ["right of", "below"]), ((0, 0), []), ((0.3, 0.3), []), ((9, 1), ["right of"])):
        assert one(spark, d.relations(box(x, y), box(0, 0))) == wanted


def test_clauses(spark):
    obj = [("cat", [0.0, 0.0, 2.0, 2.0], "red"), ("cat", [0.0, 5.0, 2.0, 7.0], "blue"), ("dog", [10.0, 0.0, 12.0, 2.0], None)]
    clause = lambda name, n=1, color=None, relation=None, other=None: (name, n, color, relation, other)
    table = [
        ([clause("cat")], [], True), ([clause("cat", 2)], [], True), ([clause("cat", 3)], [], False), ([clause("bird")], [], False), ([clause("cat", 1, "red")], [], True), ([clause("cat", 1, "blue")], [], False),
        ([clause("cat", 2, "red")], [], False), ([clause("dog", 1, "red")], [], False), ([clause("cat"), clause("dog", 1, None, "right of", 0)], [], True), ([clause("cat"), clause("dog", 1, None, "left of", 0)], [], False),
        ([clause("bird"), clause("dog", 1, None, "right of", 0)], [], False), ([clause("dog", 1, None, "right of", 5)], [], False), ([clause("cat")], [clause("dog")], False), ([clause("cat")], [clause("dog", 2)], True),
        ([], [], True), (None, None, True), ([clause("cat", 2), clause("dog", 1, None, "right of", 0)], [], True),
    ]
    df = spark.createDataFrame([(i, obj, a, b) for i, (a, b, _) in enumerate(table)], f"i int, o {d.OBJECTS}, a {d.CLAUSES}, b {d.CLAUSES}")
    assert [r.x for r in df.orderBy("i").select(d.clauses_met(F.col("o"), F.col("a"), F.col("b")).alias("x")).collect()] == [w for _, _, w in table]
    assert spark.createDataFrame([(None, [clause("cat")])], f"o {d.OBJECTS}, a {d.CLAUSES}").select(d.clauses_met(F.col("o"), F.col("a"))).first()[0] is False
