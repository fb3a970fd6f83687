import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from scorewright.llm import pii, quality, secret_scan, url_filter
from scorewright.llm.queries import URL_RULES, op5_url_filter, op6_quality_rules, op7_pii_pseudonyms, op10_secret_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    repeat = len({i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)})
    failed = len(words) < 10 or 100 * repeat > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, repeat, failed


def of(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_quality_query(spark, sf, docs):
    got = {r.doc_id: r for r in op6_quality_rules(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == texts.keys()
    for key, text in texts.items():
        assert of(got[key]) == base(text), key
        assert not (got[key].base_failed and got[key].kept)
    quality_of = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [got[k] for k, q in quality_of.items() if q == 1 and not got[k].base_failed]
    assert sum(r.kept for r in good) == len(good)


def test_quality_odd_rows(odd, none):
    rows = quality.judge_quality(odd, odd.where("doc_id = 1")).collect()
    assert len(rows) == odd.count() and "score" in rows[0].asDict() and "text" not in rows[0].asDict()
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in rows:
        assert of(r) == base(texts[r.doc_id])
    assert {r.kept for r in rows if r.doc_id in (2, 3, 4, 5)} == {False}
    assert quality.judge_quality(none, none).count() == 0
    assert {r.llr for r in quality.judge_quality(odd, none).collect()} == {0.0}


def test_quality_llr_against_plain_counts(spark):
    docs = spark.createDataFrame([(1, "good words stand here"), (2, "bad ### words ###"), (3, "good words again")], "doc_id long, text string")
    bucket = lambda *w: spark.range(1).select(F.pmod(F.xxhash64(*[F.lit(x) for x in w]), F.lit(64)).cast("int")).first()[0]
    grams = {r.doc_id: [bucket(w) for w in r.text.split()] + [bucket(*p) for p in zip(r.text.split(), r.text.split()[1:])] for r in docs.collect()}
    raw, good = Counter(g for x in grams.values() for g in x), Counter(grams[1])
    import math

    scale = sum(good.values()) / sum(raw.values())
    weight = {g: math.log(good[g] + 2.0) - math.log(raw[g] * scale + 2.0) for g in raw}
    for r in quality.judge_quality(docs, docs.where("doc_id = 1"), buckets=64, smoothing=2.0).collect():
        assert abs(r.llr - sum(weight[g] for g in grams[r.doc_id]) / len(grams[r.doc_id])) < 1e-9


ASSIGN = re.compile(secret_scan.ASSIGN.replace("(?i:", "(?i:"))


def secrets(text):
    text = text or ""
    assign = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    access = [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    hexes = [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    order = ("assign", "access", "hex")
    spans = sorted(assign + access + hexes, key=lambda s: (s[1], order.index(s[0])))
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return len(assign), len(access), len(hexes), hashlib.sha256(joined.encode()).hexdigest(), joined


def test_secret_query(spark, sf, docs):
    got = {r.doc_id: r for r in op10_secret_scan(spark, sf).collect()}
    for d in docs.collect():
        r = got[d.doc_id]
        *want, joined = secrets(d.text)
        assert [r.n_assign, r.n_access, r.n_hex, r.base_sha256] == want
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def linked(spark, text):
    return secret_scan.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans


def test_secret_linking(spark):
    assert linked(spark, "username=bob99 and nothing else") == ""
    assert linked(spark, "pwd=abc1 alone") == ""
    both = linked(spark, "username=bob99 then pwd=abc1")
    assert both == "weak_id:0:14,weak_secret:20:28"
    assert linked(spark, "username=bob99 " + "x " * 400 + "pwd=abc1") == ""
    assert "endpoint" in linked(spark, "host=db.example.org username=bob99 pwd=abc1")
    assert "endpoint" not in linked(spark, "host=db.example.org username=bob99")
    assert linked(spark, "\U0001f600 token=abcdefgh1 ") == "assign:2:17"
    # Parts that lie in neighbouring bins of the scope, near and too far.
    for gap in range(270, 330, 6):
        start = 15 + gap
        text = "username=bob99 " + "-" * gap + " pwd=abc1"
        assert (linked(spark, text) != "") == (start + 1 <= secret_scan.SCOPE), gap


def test_secret_odd_rows(odd, none):
    rows = secret_scan.scan_secrets(odd.withColumn("spans", F.lit(1))).collect()
    assert len(rows) == odd.count() and {r.spans for r in rows} == {""}
    assert secret_scan.scan_secrets(none).count() == 0


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def test_pii_query(spark, sf, docs):
    got = {r.doc_id: r for r in op7_pii_pseudonyms(spark, sf).collect()}
    find = re.compile(r"[\w.]+@[\w.]+\w|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d+\.\d+\.\d+\.\d+\b|\b\d{16}\b")
    n = 0
    for d in docs.collect():
        values = [v for v in find.findall(d.text) if len(v) != 16 or not v.isdigit() or luhn(v)]
        n += len(values)
        if not re.search("[0-9@]", d.text):
            assert got[d.doc_id].text == d.text
        for v in values:
            assert v not in got[d.doc_id].text
        assert len(find.findall(got[d.doc_id].text)) == len(find.findall(d.text)) and len(values) == got[d.doc_id].n_pseudonyms
        assert find.sub("", got[d.doc_id].text) == find.sub("", d.text)
    assert n > 0


def shown(spark, *texts, key="k"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.text for r in pii.pseudonymize(df, key).orderBy("doc_id").collect()]


def test_pii_formats(spark):
    a, b, c, d, e, f, g = shown(spark, "card 4111 1111 1111 1111.", "x 4111-1111-1111-1111", "no card 4111111111111112", "on 2024-02-29 and 2024-02-30", "id 123-45-6789, not 000-12-3456", "a@b.example and A.Z9@b.example", "at 1.2.3.4, not 1.2.3.400")
    card, dashed = a[5:-1], b[2:]
    assert card.replace(" ", "") == dashed.replace("-", "") and luhn(card.replace(" ", "")) and card != "4111 1111 1111 1111"
    assert c == "no card 4111111111111112"
    assert re.fullmatch(r"on \d{4}-\d\d-\d\d and 2024-02-30", d) and "2024-02-29" not in d
    assert re.fullmatch(r"id \d{3}-\d\d-\d{4}, not 000-12-3456", e) and "123-45-6789" not in e
    assert re.fullmatch(r"[a-z]@b\.example and [A-Z]\.[A-Z]\d@b\.example", f)
    assert re.fullmatch(r"at \d+\.\d+\.\d+\.\d+, not 1\.2\.3\.400", g) and "1.2.3.4," not in g
    assert shown(spark, "card 4111 1111 1111 1111.", key="other")[0] != a
    values = [f"+1 (555) 555-{i:04d}" for i in range(300)]
    out = shown(spark, *values)
    assert len(set(out)) == 300 and all(re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", x) for x in out)


def test_pii_number_permutation_is_one_to_one(spark):
    n = 189 * 773
    got = spark.range(n).select(pii.permute_number(F.col("id"), pii.DAY_RADIX, "k", "date").alias("x")).agg(F.countDistinct("x"), F.min("x"), F.max("x")).first()
    assert tuple(got) == (n, 0, n - 1)


def test_pii_odd_rows(odd, none):
    rows = pii.pseudonymize(odd, "k").collect()
    assert [r.text for r in rows] == [r.text for r in odd.collect()] and {r.n_pseudonyms for r in rows} == {0}
    assert pii.pseudonymize(none, "k").count() == 0


def judge(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_url_query(spark, sf):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in op5_url_filter(spark, sf).collect()}
    assert got == {k: judge(u) for k, u in urls.items()}


def test_url_odd_rows(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/en/12", "http://example.org", "x://org/", "x://notexample.org/es/", "http://a.com/de/?q=/fr/", "http://a.com#/de/", "http://b.example.org./es/", "http://é.COM/fr/x\ny", "a://b://c.com/de/", "http://example.org/en/1", "http://example.org/en/1"]
    pages = spark.createDataFrame([(i % 14 or None, u, "old", "old", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string, rule int")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = sorted((repr(r.url), r.host, r.path, r.rule or "", r.verdict) for r in url_filter.filter_urls(pages, rules).collect())
    assert got == sorted((repr(u), h, p, r or "", v) for u in urls for h, p, r, v in [judge(u)])
    assert url_filter.filter_urls(pages, rules.where("false")).where("verdict <> 'allow' or rule is not null").count() == 0
    assert url_filter.filter_urls(pages.where("false"), rules).count() == 0
