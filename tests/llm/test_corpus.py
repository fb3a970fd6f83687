import math
import random
import re
import subprocess
import sys
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorewright.llm import _shingles, jaccard_join, language_id, mixing, topk
from scorewright.llm._graph import connected_components
from scorewright.llm.queries import learnable, op2_source_mix, op3_language_id, op4_exact_topk, op9_jaccard_join, source_weights

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- exact top-k


def brute_topk(rows, k):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, (i, v) in enumerate(ok):
        if i % 20 == 0 and (i, v) not in ok[:q]:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for c, (j, w) in enumerate(ok) if c != q)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def test_topk_query(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op4_exact_topk(spark, sf).collect())) == brute_topk(rows, 20)


def test_topk_blocks_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 17)
    rng = random.Random(1)
    rows = [(i, [float(rng.choice([0.0, 0.0, 0.0, 1.0, -1.0, 0.5])) for _ in range(6)]) for i in range(120)]
    rows += [(200, None), (220, []), (240, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (260, [math.nan] * 6), (280, [math.inf] * 6), (None, [1.0] * 6), (300, [0.0] * 6), (320, [1e6] * 6), (320, [0.5] * 6), (340, [1.0] * 6), (340, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 5, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, score string")
    for k in (1, 7, 500):
        assert sorted(map(tuple, topk.search(df, F.col("vec_id") % 20 == 0, k).collect())) == brute_topk(rows, k)
    assert topk.search(df.where("false"), F.col("vec_id") % 20 == 0, 5).count() == 0


# --- mixing


def check_mix(rows, texts, share=1.5):
    total, size_of = 0, defaultdict(int)
    for r in rows:
        size = len(WORD.findall(texts[r.doc_id][0] or ""))
        assert r.size == size and 0 <= r.taken <= 2 * size
        size_of[texts[r.doc_id][1]] += size
        total += size
    names = sorted(size_of, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    # Plain water filling: raise the level until the words are spent.
    lo, hi = 0.0, 1e12
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(2 * size_of[s], mid * weight[s]) for s in names) < share * total else (lo, mid)
    for s in names:
        mine = [r for r in rows if texts[r.doc_id][1] == s]
        target = min(2 * size_of[s], lo * weight[s])
        assert {r.source_size for r in mine} == {size_of[s]}
        assert all(abs(r.target - target) < 1e-3 for r in mine)
        assert abs(sum(r.taken for r in mine) - target) <= 1


def test_mix_query(spark, sf, docs):
    texts = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    rows = op2_source_mix(spark, sf).collect()
    assert len(rows) == len(texts)
    check_mix(rows, texts)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op2_source_mix(spark, sf).collect()))


def test_mix_slices_and_odd_rows(spark, odd, none, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 2)
    rows = mixing.mix(odd.where("doc_id is not null and doc_id <> 6"), F.array("source"), source_weights).collect()
    check_mix(rows, {r.doc_id: (r.text, r.source) for r in odd.collect()})
    assert mixing.mix(odd, F.array("source"), source_weights).count() == odd.count()
    assert mixing.mix(none, F.array("source"), source_weights).count() == 0
    blank = odd.where("doc_id in (2, 3)")
    assert {r.taken for r in mixing.mix(blank, F.array("source"), source_weights).collect()} == {0}


def brute_least_repeats(patterns, quotas, repeats):
    """Least cost by trying all integer flows of a tiny network."""
    from itertools import product

    best = None
    names = sorted(quotas)
    choices = [[f for f in product(*[range(min(patterns[p] * repeats, quotas[s]) + 1) if s in p else (0,) for s in names]) if sum(f) <= patterns[p] * repeats] for p in patterns]
    for pick in product(*choices):
        if all(sum(f[i] for f in pick) == quotas[s] for i, s in enumerate(names)):
            cost = sum(sum(a * a * max(0, min(n, sum(f) - a * n)) for a in range(repeats)) for f, n in zip(pick, patterns.values()))
            best = cost if best is None else min(best, cost)
    return best


def test_route_repeats_as_little_as_possible():
    for patterns, quotas in (({("a",): 2, ("a", "b"): 3, ("b",): 1}, {"a": 4, "b": 4}), ({("a", "b"): 4, ("b",): 2}, {"a": 3, "b": 5}), ({("a",): 1, ("a", "b"): 2, ("b",): 2}, {"a": 3, "b": 2})):
        flow = mixing.route(patterns, quotas, 2)
        cost = sum(max(0, flow[p] - n) for p, n in patterns.items())
        assert sum(flow.values()) == sum(quotas.values())
        assert cost == brute_least_repeats(patterns, quotas, 2)


def test_mix_overlapping_sources(spark):
    df = spark.createDataFrame([(i, "w " * 10, ["a"] if i < 10 else ["a", "b"] if i < 30 else ["b", None]) for i in range(40)], "doc_id long, text string, sources array<string>")
    rows = mixing.mix(df, F.col("sources"), lambda names: [1] * len(names), share=1.0).collect()
    assert abs(sum(r.taken for r in rows) - 400) <= 3 and all(r.taken <= 20 for r in rows)


# --- language


def naive_phrases(text, sample):
    clean = lambda t: re.sub(r"[^\W\d_]+|(.)", lambda m: m[0] if m[1] is None else " ", t.lower(), flags=re.S)
    text, sample = (re.sub(" +", " ", clean(t)) for t in (text, sample))
    n = i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in sample:
            j += 1
        n, i = n + 1, j
    return n


def test_phrases_equal_a_naive_parse():
    samples = {"x": "the cat sat on the mat, the cat", "y": "el gato está en la casa"}
    built = language_id.Model(samples).table
    texts = ["the cat sat in la casa!! zzz", "", "q", "... the mat 12 el gato", "gato " * 60]
    got, _ = built.phrases(texts)
    for text, row in zip(texts, got):
        assert row.tolist() == [naive_phrases(text, samples[k]) for k in built.langs]


def test_language_query(spark, sf, docs):
    truth = {r.doc_id: r for r in docs.collect()}
    rows = op3_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
    held = [r for r in rows if r.held_out and len(truth[r.doc_id].text) > 40]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) >= 0.97 * len(held)


def test_language_learns_only_from_its_part(spark, docs):
    model = language_id.fit(docs, learnable())
    spoiled = docs.withColumn("lang", F.when(learnable(), F.col("lang")).otherwise(F.lit("wrong")))
    assert language_id.fit(spoiled, learnable()).samples == model.samples


def test_language_odd_rows(odd, none, docs):
    model = language_id.fit(docs)
    rows = language_id.identify(odd, model).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text))
    assert language_id.identify(none, model).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd, language_id.fit(none)).collect()} == {"und"}


# --- n-gram Jaccard join


def brute_sets(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute_components(rows):
    sets = [brute_sets(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    post = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            post[g].append(i)
    for i, s in enumerate(sets):
        seen = defaultdict(int)
        for g in s:
            for j in post[g]:
                seen[j] += 1
        for j, n in seen.items():
            if j < i and 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                up[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return sorted(((key if key is not None else -1, len(sets[i]), least.get(root(i), -1)) for i, (key, _) in enumerate(rows)))


def of(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in df.collect())


def near_copies(n, words, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_jaccard_query(spark, sf, docs):
    assert of(op9_jaccard_join(spark, sf)) == brute_components([(r.doc_id, r.text) for r in docs.collect()])


@pytest.fixture(scope="module")
def family():
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = near_copies(90, 120, 6, 1) + near_copies(40, 12, 1, 2) + [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 90))) for _ in range(60)]
    texts += ["Same Words in all of these copies, word for word."] * 30 + ["same words IN all of these copies, word for word."] * 5 + ["short one", "Short one", "", None, "  "]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_jaccard_groups(spark, family):
    df = spark.createDataFrame(family, "doc_id long, text string")
    assert of(jaccard_join.jaccard_components(df)) == brute_components(family)


def test_jaccard_large_blocks_and_many_buckets(spark, family, monkeypatch):
    want = brute_components(family)
    df = spark.createDataFrame(family, "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "CHUNK_ROWS", 7)
    monkeypatch.setattr(jaccard_join, "FEWEST_BUCKETS", 50)
    assert of(jaccard_join.jaccard_components(df)) == want


def test_jaccard_odd_rows(odd, none):
    assert of(jaccard_join.jaccard_components(odd)) == brute_components([(r.doc_id, r.text) for r in odd.collect()])
    assert jaccard_join.jaccard_components(none).count() == 0


def test_overlaps_dense_and_sparse():
    rng = np.random.default_rng(4)
    for high in (40, 4000):
        sets = [np.unique(rng.integers(0, high, 30).astype(np.uint64)) for _ in range(25)]
        got = jaccard_join.overlaps(sets[:15], sets[10:])
        assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[10:]] for a in sets[:15]]


def test_shingle_sets_cut_texts_anywhere():
    texts = ["A b c d e f g", "a B c d e F g", "x", "", None, "a b c d e f g h", "ÀÉ b c d e"]
    whole, cut = (list(map(bytes, _shingles.shingle_sets(texts, most))) for most in (1 << 20, 1))
    assert whole == cut and whole[0] == whole[1] and [len(x) // 8 for x in whole] == [len(brute_sets(t)) for t in texts]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(80)] + [(5, 5)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}


# --- pipeline


def test_pipeline_stages(spark, sf, docs):
    import corpus_pipeline as P

    at, kept = docs, {}
    for name, stage in P.STAGES:
        at = stage(spark, at, sf).cache()
        kept[name] = at.collect()
        if name != P.STAGES[-1][0]:
            assert at.columns == docs.columns
    start = docs.collect()
    assert len(kept["language_id"]) == len([r for r in start if any(c.isalpha() for c in r.text or "")])
    want = {c for _, n, c in brute_components([(r.doc_id, r.text) for r in kept["language_id"]])}
    assert sorted(r.doc_id for r in kept["jaccard_join"]) == sorted(want)
    assert [r.doc_id for r in sorted(kept["pii_pseudonyms"])] == sorted(want)
    total, size = 0, defaultdict(int)
    for r in kept["pii_pseudonyms"]:
        size[r.doc_id] = len(WORD.findall(r.text))
        total += size[r.doc_id]
    mixed = defaultdict(int)
    for r in kept["source_mix"]:
        mixed[r.doc_id] += len(WORD.findall(r.text))
    assert all(n <= 2 * size[k] for k, n in mixed.items())
    assert abs(sum(mixed.values()) - 1.5 * total) < 20
    assert sum(r.length for r in kept["best_fit_packing"]) > sum(mixed.values())
    assert pd.DataFrame([r.asDict() for r in kept["best_fit_packing"]]).groupby("sequence_id")["length"].sum().max() <= 2048


def test_pipeline_odd_rows(spark, odd, none, sf):
    import corpus_pipeline as P

    base = ["doc_id", "text", "lang", "source", "n_chars"]
    for table in (odd.select(*base), none.select(*base)):
        at = table
        for _, stage in P.STAGES:
            at = stage(spark, at, sf)
        at.count()


def test_entry_works_without_the_subpackage(tmp_path):
    code = "import re, sys; sys.path.insert(0, '.'); sys.modules['scorewright.llm'] = None; import __spark_entry__ as e; assert not [q for q in e.queries() if re.match(r'op\\d+_|pipeline', q)]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=str(__import__("pathlib").Path(__file__).parents[2]))
