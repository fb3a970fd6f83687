"""n-grams by hashes: CIDEr over several blocks and buckets against the plain formula, and no row for each n-gram."""

import math
import random
from collections import Counter

import pytest

from scorewright.operators import cider, scores as op


def plain_cider(rows, orders):
    grams = lambda t, n: Counter(zip(*((t or "").lower().split()[k:] for k in range(n))))
    out = {}
    for n in range(1, orders + 1):
        seen = Counter(g for _, _, r in rows for g in set(grams(r, n)))
        idf = lambda g: math.log(len(rows)) - math.log(max(seen[g], 1))
        for k, p, r in rows:
            a, b = ({g: c * idf(g) for g, c in grams(x, n).items()} for x in (p, r))
            norm = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))
            out[k] = out.get(k, 0.0) + (sum(v * b.get(g, 0.0) for g, v in a.items()) / norm if norm else 0.0)
    return {k: v / orders for k, v in out.items()}


@pytest.mark.parametrize("chars", [200, 10_000])
def test_cider_over_blocks_and_buckets(spark, monkeypatch, chars):
    monkeypatch.setattr(cider, "BLOCK_CHARS", chars)
    monkeypatch.setattr(cider, "BUCKET_CHARS", chars)
    draw = random.Random(5)
    said = lambda: " ".join(draw.choice(["die", "Zeit", "är", "la", "x", "東京"]) for _ in range(draw.randint(1, 12)))
    rows = [(k, said(), said()) for k in range(40)] + [(90, "alone", None), (91, None, "die"), (92, "", " \n")]
    df = spark.createDataFrame(rows, "k int, p string, r string")
    got = {r.k: r.cider for r in op.cider_orders(df, "k", df.p, df.r).collect()}
    want = plain_cider(rows, 4)
    assert set(got) == set(want) - {92}
    assert all(got[k] == pytest.approx(want[k]) for k in got)


def test_cider_makes_no_row_for_each_gram(spark):
    df = spark.createDataFrame([(1, "a b c", "a b d")], "k int, p string, r string")
    assert "Generate" not in op.cider_orders(df, "k", df.p, df.r)._jdf.queryExecution().executedPlan().toString()
