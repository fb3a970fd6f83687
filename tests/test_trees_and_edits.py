"""Tree edit score, errors on marked words and soft repetition against plain versions."""

import random
from functools import cache

import pytest
from pyspark.sql import functions as F

from scorewright.functions import edits, trees


# --- trees


def random_html(rng, depth=0):
    if depth > 3 or rng.random() < 0.3:
        return rng.choice(["a", "ab", "abc", "x y", " "])
    tag = rng.choice(["div", "p", "td", "span"])
    span = rng.choice(["", "", ' rowspan="2"'])
    return f"<{tag}{span}>" + "".join(random_html(rng, depth + 1) for _ in range(rng.randrange(4))) + f"</{tag}>"


def plain_distance(a, b):
    """Forest edit distance by its definition, nodes numbered in postorder."""
    change = trees._changes(a, b)

    @cache
    def forest(i, k, j, m):  # nodes i .. k - 1 of a and j .. m - 1 of b
        if i == k or j == m:
            return k - i + m - j
        x, y = k - 1, m - 1
        fx, fy = a.first[x], b.first[y]
        return min(forest(i, x, j, m) + 1, forest(i, k, j, y) + 1, forest(i, fx, j, fy) + forest(fx, x, fy, y) + change[x, y])

    return forest(0, a.size, 0, b.size)


def test_tree_distance_is_that_of_the_definition():
    rng = random.Random(1)
    for _ in range(500):
        a, b = (trees.Tree("<div>" + "".join(random_html(rng) for _ in range(rng.randrange(4))) + "</div>") for _ in range(2))
        assert trees.distance(a, b) == pytest.approx(plain_distance(a, b))


def test_trees_of_html():
    shape = lambda html, keep=None: (lambda t: list(zip(t.labels, t.first)))(trees.Tree(html, keep))
    assert shape("") == [("", 0)]
    assert shape("<p>hi</p>") == shape("<html><head><title>x</title></head><body><p>hi</p></body></html>") == [("hi", 0), ("", 0)]
    assert shape("<ul><li>a<li>b</ul>") == shape("<ul><li>a</li><li>b</li></ul>")
    assert shape("<table><tr><td>a<td>b</table>") == shape("<table><tbody><tr><td>a</td><td>b</td></tr></tbody></table>")
    assert shape("x<table><tr><td>a</td></tr></table>", "table") == shape("<table><tr><td>a</td></tr></table>")
    assert shape("<b>bold</b> t<br/>") == [("bold", 0), ("t", 1), ("", 0)] or shape("<b>bold</b> t<br/>") == [("boldt", 0), ("", 0)]
    assert trees.Tree("<div>" * 5000 + "deep").size <= trees.MAX_DEPTH
    assert trees.fenced("say ```html\n<p>x</p>\n``` end") == "<p>x</p>"


def test_tree_scores(spark):
    page = "<html><body><p>hi</p></body></html>"
    rows = [([page], page, None), (["<p>hi</p>"], "", None), (["<p>WRONG</p>", "<p>hi</p>"], "<p>hi</p>", None), ([], "x", None), (None, "x", None), (["<p>a</p>"], None, None), (["<p>a</p>"], "<p>b</p>", "table"), (["<p>ab</p>"], "<p>ax</p>", None)]
    df = spark.createDataFrame(rows, "labels array<string>, prediction string, kind string")
    got = [r[0] for r in df.select(trees.tree_edit_score("labels", "prediction", "kind")).collect()]
    assert got == [1.0, None, 1.0, None, None, None, 1.0, 0.5]
    assert df.where("prediction = ''").agg(trees.tree_edit_mean(trees.tree_edit_score("labels", "prediction", "kind"))).first()[0] == 0.0


# --- marked words


def plain_script_length(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_scripts_are_best_and_apply():
    rng = random.Random(2)
    for _ in range(800):
        a, b = ([rng.choice("abc가나") for _ in range(rng.randrange(12))] for _ in range(2))
        script = edits.edit_script(a, b)
        assert len(script) == plain_script_length(a, b)
        out, at = [], 0
        for operation, i, j in script:
            out += a[at:i]
            at = i + (operation != "insert")
            out += [b[j]] if operation != "delete" else []
        assert out + a[at:] == b


def test_marked_words_and_rates(spark):
    assert edits.marked_words("이 <tag bug> 는 <tag very  bad> 문제") == (["이", "bug", "는", "very", "bad", "문제"], {1, 3, 4})
    assert edits.tagged_errors("a <tag b> c", "a x c") == (1, 0, 0, 0)
    assert edits.tagged_errors("a <tag b> c", "a c") == (0, 1, 0, 0)
    assert edits.tagged_errors("a <tag b> c", "a z b c") == (0, 0, 1, 1)
    assert edits.tagged_error_rate("a <tag b>", "a b 뷁") == 0.0
    assert edits.tagged_error_rate("<tag b> <tag c> 가", "b 나") == 50.0
    rows = [(["a <tag b>", "a <tag x>"], "a b"), (["a <tag b>"], "a"), (["a b"], "z"), ([], "a"), (None, "a"), (["a"], " "), (["a"], None), (["", None], "a")]
    got = [tuple(r[0]) for r in spark.createDataFrame(rows, "labels array<string>, p string").select(edits.pier("labels", "p")).collect()]
    assert got == [(0.0, 0.0), (100.0, 1.0), (0.0, 0.0), (None, 1.0), (None, 1.0), (None, 1.0), (None, 1.0), (None, 1.0)]


def test_random_tagged_texts_count_all_words():
    rng = random.Random(4)
    for _ in range(300):
        words = [rng.choice(["a", "b", "가", "<tag c>", "<tag d e>"]) for _ in range(rng.randrange(1, 10))]
        label, text = " ".join(words), " ".join(rng.choice(["a", "b", "가", "c", "d", "e"]) for _ in range(rng.randrange(10)))
        plain, marked = edits.marked_words(label)
        changes, deletions, insertions, hits = edits.tagged_errors(label, text)
        assert changes + deletions + hits == len(marked)
        assert changes + deletions + insertions <= plain_script_length(plain, text.split())
        if len(marked) == len(plain) and plain:  # only insertions at the end are outside
            assert changes + deletions + insertions <= plain_script_length(plain, text.split()) <= changes + deletions + insertions + len(text.split())


# --- soft repetition


def plain_soft_repeat(tokens, least):
    best = (0, 0, 0, 0)
    n, found = len(tokens), {}
    for k in range(least, n // 2 + 1):
        for i in range(n - k + 1):
            found.setdefault(tuple(tokens[i : i + k]), []).append(i)
    for phrase, places in found.items():
        k, text = len(phrase), " ".join(phrase)
        if len(places) > 1 and not edits._URL.search(text) and not edits._SIGNS.fullmatch(text):
            best = max(best, ((len(places) - 1) * k, -(places[0] + k - 1), k, len(places)))
    return float(best[0]), best[3]


def longest(tokens, least):
    """Only phrases that cannot grow to the left without losing an occurrence are states."""
    return plain_soft_repeat(tokens, least)[0]


def test_soft_repeat_is_that_of_the_search():
    rng = random.Random(6)
    for _ in range(400):
        tokens = [rng.choice(["a", "b", "c", "--", "http://x.y"][: rng.choice([2, 3, 5])]) for _ in range(rng.randrange(30))]
        least = rng.choice([1, 2, 4])
        score, count = edits.soft_repeat_of(tokens, least)
        assert score == (longest(tokens, least) if len(tokens) >= 2 * least else 0.0), tokens
        assert (count > 1) == (score > 0)


def test_soft_repeat_column(spark):
    text = "one two three four " * 10
    rows = [(text,), (None,), ("",), ("a b c",), ("- - " * 50,), ("x " * 40_000,)]
    got = [tuple(r[0]) for r in spark.createDataFrame(rows, "t string").select(edits.soft_repeat("t")).collect()]
    assert got[0] == (100.0, 6)
    assert got[1:5] == [(0.0, 0)] * 4
    assert got[5] == (4e8, 20_001)
