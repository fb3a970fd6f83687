"""Stages of the pipeline keep whole rows: long cuts, repeated ids and rows without an id."""

from collections import Counter

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], SCHEMA)


def test_mix_cuts_a_very_long_text(spark, sf):
    # One and a half times all words are wanted and source a gives few, so b's only text is taken once and a half.
    long = "".join(f" \t\nword{i}" for i in range(45_000))
    texts = {1: "a b c d", 2: long}
    out = P.mix_sources(spark, frame(spark, [(1, texts[1], "a"), (2, long, "b")]), sf).collect()
    parts = [r for r in out if r.text != texts[r.doc_id]]
    assert [r.doc_id for r in parts] == [2]
    n = len(parts[0].text.split())
    assert n > 20_000 and parts[0].text == "".join(f" \t\nword{i}" for i in range(n)) and parts[0].n_chars == len(parts[0].text)


def clean(n):
    """A text that shares no five words with another number's."""
    return " ".join(f"w{n}x{k}" for k in range(40))


def test_near_copies_keep_different_texts_of_one_id(spark, sf):
    copies = [(1, clean(1), "a"), (7, clean(1) + " more", "a"), (7, clean(2), "a"), (7, clean(3), "a"), (None, clean(4), "a"), (None, clean(5), "a"), (None, clean(6), "a"), (3, clean(6), "a"), (9, clean(7), "a"), (9, clean(7), "a"), (None, clean(8), "a"), (None, clean(8), "a")]
    out = P.drop_near_copies(spark, frame(spark, copies), sf)
    want = [(1, clean(1)), (7, clean(2)), (7, clean(3)), (None, clean(4)), (None, clean(5)), (3, clean(6)), (9, clean(7)), (None, clean(8))]
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(want)


def test_mix_takes_each_row_of_an_id_by_itself(spark, sf):
    rows = [(i, clean(n), "a") for n, i in enumerate([5, 5, 5, 5, None, None, None, 8, 9, 9])]
    out = P.mix_sources(spark, frame(spark, rows), sf).collect()
    assert sum(len(r.text.split()) for r in out) == 600
    assert max(Counter(r.text for r in out).values()) <= 2 and {clean(n) for n in range(10)} <= {r.text for r in out}
