"""Edit distances in bands and tree labels side by side: the same figures as before, in far fewer steps."""

import random
import time

import pytest

from scorewright.functions import edits, text as t, trees


def table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("seed", range(40))
def test_distances_of_all_kinds_of_texts(seed):
    draw = random.Random(seed)
    a = [draw.randrange(9) for _ in range(draw.randint(0, 300))]
    b = [x if draw.random() < draw.choice([0.5, 0.99]) else draw.randrange(9) for x in a if draw.random() < 0.95] + [1] * draw.randint(0, 80)
    assert t._edits(a, b) == t._edits(b, a) == table(a, b)
    if a and b:
        assert t._within(a, b, table(a, b)) == table(a, b)
    assert len(edits.edit_script(a, b)) == table(a, b)


def test_long_texts_with_few_changes_take_little_time():
    draw = random.Random(1)
    a = "".join(draw.choice("abcdefgh ") for _ in range(120_000))
    b = "x" + "".join(c for c in a if draw.random() < 0.995) + "y"
    began = time.perf_counter()
    assert len(a) - len(b) <= t._edits(a, b) < 1500
    assert time.perf_counter() - began < 4  # the whole table of distances took over 10 s
    a = "".join(draw.choice("abcdefgh ") for _ in range(400_000))
    assert t._edits(a, a[::2]) == 200_000  # what lies within the other text is told in one pass


def test_labels_side_by_side_equal_single_distances():
    draw = random.Random(2)
    a, b = ([("".join(draw.choice("ab😀é") for _ in range(draw.randint(0, 30)))) for _ in range(12)] for _ in range(2))
    got = trees._label_costs(a, b)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            assert got[i, j] == pytest.approx(table(x, y) / max(len(x), len(y), 1))


def test_distance_from_nothing_is_told_by_size():
    for html in ("", "a", "<p>a</p><p>b</p>", "<table><tr><td colspan=2>a</td></tr></table>"):
        tree = trees.Tree(html)
        assert trees._from_nothing(tree) == trees.distance(tree, trees.Tree(""))
