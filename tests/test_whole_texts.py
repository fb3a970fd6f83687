"""Queries without an SQL equivalent read whole texts."""

from collections import defaultdict

import pytest

from scorewright.plans import registry, views


@pytest.fixture(scope="module")
def whole(spark, sf):
    items = {r.item_id: r.text for r in views.table(spark, sf, "benchmark").collect()}
    return {r.doc_id: (r.lang, r.text, [items[r.doc_id % len(items)], r.text[r.doc_id % 3 :]]) for r in views.table(spark, sf, "documents").collect()}


def test_whole_records(spark, sf, whole):
    assert max(len(p) for _, p, _ in whole.values()) > 10_000
    assert any(not p.isascii() for _, p, _ in whole.values())
    assert {r.doc_id: (r.category, r.prediction, r.labels) for r in views.whole_records(spark, sf).collect()} == whole


def test_word_error_rate_counts_all_words(spark, sf, whole):
    words = defaultdict(int)
    for lang, _, labels in whole.values():
        words[lang] += len(labels[1].split())
    assert {r.category: r.words for r in registry.queries()["word_error_rate"](spark, sf).collect()} == words


def test_repetition_window_share_of_whole_texts(spark, sf, whole):
    shares = defaultdict(list)
    for lang, text, _ in whole.values():
        t = text.split()
        shares[lang].append(sum(x in t[max(0, i - 16) : i] for i, x in enumerate(t)) / len(t) if t else 0.0)
    got = {r.category: r.rep_w for r in registry.queries()["repetition_window_share"](spark, sf).collect()}
    assert got == {k: pytest.approx(sum(v) / len(v), abs=1e-6) for k, v in shares.items()}


def test_character_errors_are_those_of_plain_tables(spark, sf):
    """Distances of whole documents against a table of distances kept in numpy, and the reports made of them."""
    import numpy as np

    from scorewright.plans.registry import queries
    from scorewright.plans.views import records

    def distance(a, b):
        a, b = (np.array([ord(c) for c in x]) for x in ((a, b) if len(a) < len(b) else (b, a)))
        row = np.arange(len(a) + 1)
        for j, c in enumerate(b, 1):
            best = np.minimum(row[1:] + 1, row[:-1] + (a != c))
            row = np.minimum.accumulate(np.concatenate(([j], best)) - np.arange(len(a) + 1)) + np.arange(len(a) + 1)
        return int(row[-1])

    errors, chars, neds = {}, {}, {}
    for r in records(spark, sf).collect():
        if len(r.prediction) > 8000:
            continue
        pairs = [(distance(x, r.prediction), len(x)) for x in r.labels if x]
        d, n = min(pairs, key=lambda p: (p[0] / p[1], p[1]))
        errors[r.category], chars[r.category] = errors.get(r.category, 0) + d, chars.get(r.category, 0) + n
        lower = min(distance(x.lower(), r.prediction.lower()) / max(len(x), len(r.prediction), 1) for x in r.labels)
        neds.setdefault(r.category, []).append(lower)
    from pyspark.sql import functions as F

    from scorewright.functions import text as t

    rows = records(spark, sf).where(F.char_length("prediction") <= 8000)
    e = rows.withColumn("e", t.char_edits("labels", "prediction")).collect()
    assert all(r.e == [distance(x, r.prediction) for x in r.labels] for r in e[:60])
    whole = {r.category: r for r in queries()["cer_corpus"](spark, sf).collect()}
    assert all(whole[c].edits >= errors[c] and whole[c].chars >= chars[c] for c in errors)
    for c in errors:  # categories without a longer document are compared whole
        if rows.where(F.col("category") == c).count() == records(spark, sf).where(F.col("category") == c).count():
            assert (whole[c].edits, whole[c].chars) == (errors[c], chars[c])
            ned = {r.category: r.ned for r in queries()["ned_anls_by_category"](spark, sf).collect()}[c]
            assert abs(ned - sum(neds[c]) / len(neds[c])) < 1e-6
