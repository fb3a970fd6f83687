"""Checks over odd texts: a prompt without words is no error, and what is told in short ways is what the plain ways tell."""

import re
import string
import time

import pytest
from pyspark.sql import functions as F

from scorewright.functions import checks, text as t
from scorewright.plans import registry

ODD = ["", " \n\t", "A.", "...", "--a-- 'b'. \"C!\" d-e f..g", "a.b.c", "Äb äB. ΑΣ. ας σ!", "😀a 😀b\n\nc", "x" + "-" * 5000 + "y z", "one two. two three! three one", "b c d e\n * f - g", "1 f g", "z a b"]


def bare(text):
    return [w for w in (w.strip(string.punctuation) for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower())) if w]


def grams(text):
    return {text[i : i + 3] for i in range(len(text) - 2)} if len(text) > 3 else {text}


def test_prompt_without_words_is_no_error(spark):
    rows = [("A.", ""), ("A.", " \n"), ("A. b", ""), ("A.", "B"), ("A.", "A."), (" ", ""), ("A.", None), (None, ""), ("A b  c", "x b c"), ("A b c", "x b d")]
    df = spark.createDataFrame(rows, "said string, prompt string")
    got = [r.x for r in df.select(checks.strict(F.col("said"), "repeat_change", prompt=F.col("prompt")).alias("x")).collect()]
    assert got == [True, True, False, True, False, False, False, False, True, False]  # one word instead of none is a changed first word


def test_parts_of_odd_texts(spark):
    said = F.col("said")
    rows = spark.createDataFrame([(x,) for x in ODD], "said string").select("said", checks.bare_words(said).alias("bare"), checks.initials(said).alias("initials"), checks.both_ends(said).alias("ends"), checks.plain(said).alias("plain")).collect()
    for r in rows:
        words = bare(r.said)
        assert (r.bare, r.initials) == (words, "".join(w[0] for w in words))
        assert (r.ends.first, r.ends.last) == ((words[0], words[-1]) if words else ("", ""))
        assert r.plain == r.said.lower().translate(str.maketrans("", "", string.punctuation))


def test_neighbours_with_the_same_letter(spark):
    texts = ["", "a", "A an, (apple) b", "a b a", "b b a a a c"]
    got = [r.x for r in spark.createDataFrame([(x,) for x in texts], "s string").select(checks.alliteration(F.col("s")).alias("x")).collect()]
    assert got == [0, 0, 3, 0, 5]
    rising = ["a b. c c d. e e e f.", "a b. c d.", "a.b.c", "One. Two two. " + "x x x. " * 2]
    got = [r.x for r in spark.createDataFrame([(x,) for x in rising], "s string").select(checks.strict(F.col("s"), "incrementing_alliteration").alias("x")).collect()]
    assert got == [True, False, False, False]


def test_share_of_trigrams(spark):
    pairs = [(a, b) for a in ODD for b in ODD] + [(None, "a"), ("a", None), ("ab", "ab"), ("ab", "abc"), ("abcd", "xbcdabc"), ("\0", "")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", t.trigram_share(F.col("a"), F.col("b")).alias("x")).collect()
    for r in rows:
        assert r.x == (None if r.a is None or r.b is None else 100.0 * len(grams(r.a) & grams(r.b)) / len(grams(r.a)))


@pytest.mark.parametrize("mark", ["trigram_share", "_initials"])
def test_all_checks_share_their_parts(spark, sf, mark):
    plan = registry.queries()["if_all_checks"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert mark in plan and plan.count("trigram_share(") <= 2


def test_nesting_takes_linear_steps(spark):
    verdict = lambda text, name: spark.range(1).select(checks.strict(text, name).alias("x")).first().x
    for text, ok in (("{[([(a)])]}", True), ("([{([", False), ("([{([)])]}([{([])])", True), ("((((", False), ("]" + "(" * 9 + ")", True), ("(((((]" + "(" * 4 + ")", False)):
        assert verdict(F.lit(text), "nested_parentheses") is ok
    for text, ok in (("\"'\"'a'\"'\"", True), ("\"'\"a\"'", False), ("\"'\"'\"\"'\"", True), ("''\"\"", False)):
        assert verdict(F.lit(text), "nested_quotes") is ok
    for text, name, ok in (("(" * 100_000 + ")", "nested_parentheses", True), ("'\"" * 50_000, "nested_quotes", False), ("\n" * 100_000 + "x", "sub_bullets", False)):
        rows = spark.createDataFrame([(text,)], "said string")
        began = time.perf_counter()
        assert rows.select(checks.strict(F.col("said"), name).alias("x")).collect() == [(ok,)]
        assert time.perf_counter() - began < 15, name  # a copy of what is open for each mark took up to minutes
