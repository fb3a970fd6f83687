"""Long texts that recursive patterns would overflow, and cases that earlier versions got wrong."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright.llm import jaccard_join, language_id, pii, secret_scan, url_filter

N = 100_000
OLD_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def found(spark, pattern, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.orderBy("i").select(F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("x")).collect()]


def test_addresses_are_the_same_as_by_the_plain_pattern(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab.-@_ ,%") for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += ["x@a.b.", "x@a..b", "x@a.b..c", "x@-.-", "a@b@c.d", "a@b.c@d.e", "a@b.c+x@d.e", "@a.b", "x@a", "x@.a.b"]
    assert found(spark, pii.PATTERNS["email"], texts) == [OLD_EMAIL.findall(t) for t in texts]


def test_long_texts_end(spark):
    texts = ["x@a" + ".a" * N, "x@a" + ".a" * N + ".", "a" * N, "a." * N, "x@" + "a" * N, "(212) " * N, "1 " * N, "4111 " * N, "2024-01-01 " * 2000]
    rows = pii.pseudonymize(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), "k").collect()
    assert [len(r.text) for r in sorted(rows, key=lambda r: r.doc_id)] == [len(t) for t in texts]
    assert {r.doc_id: r.n_pseudonyms for r in rows}[0] == 1 and {r.doc_id: r.n_pseudonyms for r in rows}[8] == 2000


def test_national_ids_stay_valid_and_one_to_one(spark):
    rng = random.Random(2)
    ids = {f"{a:03d}-{g:02d}-{s:04d}" for a, g, s in ((rng.randrange(1, 900), rng.randrange(1, 100), rng.randrange(1, 10000)) for _ in range(1500)) if a != 666}
    df = spark.createDataFrame([(i, x) for i, x in enumerate(sorted(ids))], "doc_id long, text string")
    out = pii.pseudonymize(df, "k").select("text", pii.kind_of(F.col("text")).alias("kind")).collect()
    assert {r.kind for r in out} == {"national"} and len({r.text for r in out}) == len(ids)
    again = pii.pseudonymize(df, "other").collect()
    assert sum(a.text == b.text for a, b in zip(sorted(out), sorted(again), strict=True)) < len(ids)


def test_rules_keep_host_and_path_apart(spark):
    rules = spark.createDataFrame([("co", "m", "block"), ("com", "", "allow"), ("a/b", "", "block"), ("org", "/x", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://com"), (2, "http://x.co"), (3, "http://org/x/y"), (4, "http://a/b"), (5, "http://or"), (6, None)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got == {1: ("com", "allow"), 2: (None, "allow"), 3: ("org/x", "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow")}


def test_shingles_that_look_alike_count_apart():
    """Two shingles of a set that share bucket and upper half both count, and copies from several tasks count once."""
    buckets = 4
    shingles = np.arange(1, 41, dtype=np.uint64) << np.uint64(33)
    shingles[1] = shingles[0] | np.uint64(1)  # the same bucket and upper half
    packed = []
    for key in (1, 2, 1):  # class 1 comes from two tasks
        packer = jaccard_join.Packer(buckets)
        packer.add(key, 40, shingles)
        packed.append(packer.flush())
    seen = {1: 0, 2: 0}
    for bucket in range(buckets):
        data = [d for p in packed for b, d in zip(p["bucket"], p["data"], strict=True) if b == bucket]
        if data:
            columns = jaccard_join.Columns(data, 75)
            assert len(columns.classes) == 2
            for row in columns.row[columns.shared]:
                seen[int(columns.classes["key"][row])] += 1
    assert seen == {1: 40, 2: 40}


def test_spans_of_many_matches(spark):
    text = "login = user_name password = abcdefgh1 \U0001f600 " * 4000
    row = secret_scan.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_assign == 4000
    spans = [tuple(s.split(":")) for s in row.base_spans.split(",")]
    whole = [(m.start(), m.end()) for m in re.finditer(r"password = [a-z0-9]+", text)]
    assert [(int(a), int(b)) for _, a, b in spans] == whole


def test_samples_of_languages_are_bounded(spark):
    long = {"en": "the cat sat on the mat and ran ", "de": "der hund lief über die straße und bellte "}
    df = spark.createDataFrame([(i, lang, (t + str(i)) * 2000) for i in range(40) for lang, t in long.items()], "doc_id long, lang string, text string")
    model = language_id.fit(df)
    assert set(model.samples) == {"en", "de"}
    assert all(len(s) <= language_id.SAMPLE_ROWS * (language_id.PASSAGE + 1) for s in model.samples.values())
    judged = language_id.identify(df, model)
    assert judged.where("lang_pred = lang").count() == 80


@pytest.mark.parametrize("text", ["a" * N, "https://" + "a." * N, "user = " * 20_000])
def test_secret_patterns_end(spark, text):
    assert secret_scan.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).count() == 1
