"""Scores against plain versions, and checks by example."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scorewright.functions import checks, scores as s, text as t
from scorewright.operators import scores as op


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def table_distance(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    c = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            c[i][j] = c[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(c[i - 1][j], c[i][j - 1])
    return d[-1][-1], c[-1][-1]


def test_bit_rows_equal_the_tables():
    r = random.Random(5)
    for _ in range(400):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(90))] for _ in range(2))
        assert (t._edits(a, b), t._common(a, b)) == table_distance(a, b)


def test_trailing_repeat_equals_the_plain_search():
    def plain(words):
        best = 0
        for n in range(1, len(words) // 2 + 1):
            count = 1
            while n * (count + 1) <= len(words) and words[len(words) - n * (count + 1) : len(words) - n * count] == words[len(words) - n :]:
                count += 1
            best = max(best, n * count if count > 1 else 0)
        return best

    r = random.Random(7)
    for _ in range(500):
        words = [r.choice("ab") for _ in range(r.randrange(8))] + [r.choice("abc") for _ in range(r.randrange(1, 5))] * r.randrange(1, 5)
        assert s._trailing(words) == plain(words)


def test_trailing_repeat_of_odd_texts(spark):
    rows = spark.createDataFrame([(None,), ("",), ("x",), ("go on go on",)], "t string")
    assert [r[0] for r in rows.select(s.trailing_repeat("t")).collect()] == [0, 0, 0, 4]


def test_cider_orders_equals_the_plain_formula(spark):
    rows = [(1, "the cat sat on the mat", "a cat sat on the mat"), (2, "dogs run", "the dogs run fast today"), (3, "", "nothing here"), (4, "the cat", "")]
    got = {r.k: r.cider for r in op.cider_orders(spark.createDataFrame(rows, "k int, p string, r string"), "k", F.col("p"), F.col("r")).collect()}
    grams = lambda x, n: Counter(tuple(x.split()[i : i + n]) for i in range(len(x.split()) - n + 1))
    for key, p, r in rows:
        total = 0.0
        for n in range(1, 5):
            seen = Counter(g for _, _, ref in rows for g in grams(ref, n))
            df = {g: sum(g in grams(ref, n) for _, _, ref in rows) for g in seen}
            vector = lambda x: {g: c * (math.log(len(rows)) - math.log(max(df.get(g, 0), 1))) for g, c in grams(x, n).items()}
            a, b = vector(p), vector(r)
            norm = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))
            total += sum(v * b.get(g, 0) for g, v in a.items()) / norm if norm else 0
        assert got.get(key, 0.0) == pytest.approx(total / 4)


def test_repeated_bigrams(spark):
    rows = spark.createDataFrame([(1, "a b c a b"), (2, "x"), (3, None), (4, "z z z")], "k int, t string")
    got = {r.k: r.share for r in op.repeated_bigrams(rows, "k", F.col("t")).collect()}
    assert got == {1: 80.0, 2: 0.0, 3: 0.0, 4: 100.0}


@pytest.mark.parametrize("label, answer, ok", [("3", "\\boxed{3}", 1), ("0.5", "$\\frac{1}{2}$", 1), ("-0.5", "-1/2", 1), ("1,000", "1000", 1), ("x+1", "$x + 1$", 1), ("2", "3", 0), ("2", None, 0)])
def test_math_equal(spark, label, answer, ok):
    assert one(spark, s.math_equal(F.lit(label), F.lit(answer).cast("string"))) == ok


def test_boxes_and_answers(spark):
    assert one(spark, s.parsed_box(F.lit("[1, 2, x, 4]"))) is None
    assert one(spark, s.scaled_box(s.parsed_box(F.lit("[50, 0.5, 100, 40]")), F.lit(100), F.lit(80))) == [0.5, 0.5, 1.0, 0.5]
    assert one(spark, s.ocr_answer(F.array(F.lit("Main St")), F.lit("it reads\nMain St."))) == 1
    assert one(spark, s.ocr_answer(F.array(F.lit("one two three four five")), F.lit("one two three four fire"))) == pytest.approx(1 - 1 / 23)
    assert one(spark, s.ocr_answer(F.array(F.lit("大 街")), F.lit("在大街上"), joined=True)) == 1


OPTIONS = "\nA. one\nB. two\nC. three\nD. four\nE. five\n"
ROWS = "ProductID,Category,Brand,Price,Stock\n" + "\n".join(f'{i},tea,"A,{i}&co",3,4' for i in range(14))


@pytest.mark.parametrize(
    "name, text, ok",
    [
        ("incrementing_alliteration", "One red apple. Big bad dog. Silly sad seals sing.", True),
        ("incrementing_alliteration", "Big bad dog. One red apple.", False),
        ("nested_quotes", "\"a 'b \"c\" d' e\"", True),
        ("nested_quotes", "\"a 'b' c\"", False),
        ("emoji_sentences", "Hello 😀. Bye! 🎉", True),
        ("emoji_sentences", "Hello. Bye 🎉.", False),
        ("choice_questions", "".join(f"Question {i}. Why{'y' * i}?{OPTIONS}" for i in range(1, 5)), True),
        ("choice_questions", "".join(f"Question {i}. Why?{OPTIONS}" for i in range(1, 5)), False),
        ("reversed_words", "high flies eagle bald The", True),
        ("reversed_words", "The bald eagle flies", False),
        ("special_csv", ROWS, True),
        ("special_csv", ROWS.replace('"', ""), False),
        ("special_csv", ROWS + "\n1,2,3,4,5", False),
        ("quoted_csv", "\n".join("\t".join(f'"{x}"' for x in ("StudentID", "Subject", "Grade", "Semester", "Score")) for _ in range(4)), True),
        ("quoted_csv", "StudentID\tSubject\tGrade\tSemester\tScore\n" + "\n".join('"a"\t"b"\t"c"\t"d"\t"e"' for _ in range(3)), False),
    ],
)
def test_new_checks(spark, name, text, ok):
    assert one(spark, checks.strict(F.lit(text), name)) is ok
