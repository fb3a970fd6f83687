"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by the set of sources that they belong to.  The words of each pattern flow to the quotas of
its sources; the first pass over a document is free, each repetition costs more than the one before (convex), so the
flow repeats as few words as it can.  The flow is solved on the aggregate (as many nodes as patterns and sources), and
seeded documents then realise it: per pattern, documents stand in the order of a keyed hash and give their words until
the pattern's flow is met.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scorewright.llm._shared import WORD, materialize, text_or_empty

#: Rows that one window of the seeded order holds, about.
BLOCK_ROWS = 50_000
#: Patterns that the driver's flow takes; it names the bound on what reaches the driver.
MAX_PATTERNS = 200_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def water_fill(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """Share ``total`` by weight; shares stop at ``most`` times the size and the excess goes to the others by weight."""
    target, open_, left = {}, set(sizes), total
    while open_:
        unit = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if weights[s] * unit > most * sizes[s]]
        if not full:
            return target | {s: weights[s] * unit for s in open_}
        for s in full:
            target[s] = float(most * sizes[s])
            left -= target[s]
            open_.remove(s)
    return target


class _Flow:
    """Min-cost flow with integer capacities by successive shortest paths with potentials."""

    def __init__(self) -> None:
        self.arcs: list[list] = []  # [to, room, cost]; the reverse of arc i is i ^ 1
        self.out: dict = defaultdict(list)

    def add(self, a, b, room: int, cost: int) -> int:
        self.out[a].append(len(self.arcs))
        self.arcs.append([b, room, cost])
        self.out[b].append(len(self.arcs))
        self.arcs.append([a, 0, -cost])
        return len(self.arcs) - 2

    def solve(self, s, t) -> None:
        height: dict = defaultdict(int)
        while True:
            far, via, heap, n = {s: 0}, {}, [(0, 0, s)], 0
            while heap:
                d, _, u = heapq.heappop(heap)
                if d > far[u]:
                    continue
                for i in self.out[u]:
                    v, room, cost = self.arcs[i]
                    if room and (x := d + cost + height[u] - height[v]) < far.get(v, float("inf")):
                        far[v], via[v] = x, i
                        heapq.heappush(heap, (x, n := n + 1, v))
            if t not in far:
                return
            for v, d in far.items():
                height[v] += min(d, far[t])
            for v in set(self.out) - set(far):
                height[v] += far[t]
            path, v = [], t
            while v != s:
                path.append(via[v])
                v = self.arcs[via[v] ^ 1][0]
            room = min(self.arcs[i][1] for i in path)
            for i in path:
                self.arcs[i][1] -= room
                self.arcs[i ^ 1][1] += room


def route(patterns: dict[tuple, int], quotas: dict, repeats: int) -> dict[tuple, int]:
    """Words that the mix takes from each pattern: patterns map their sources to words, quotas sources to words."""
    net, taken = _Flow(), defaultdict(list)
    for p in sorted(patterns, key=repr):
        for again in range(repeats):
            taken[p].append(net.add("from", ("p", p), patterns[p], again * again))
        for s in p:
            net.add(("p", p), ("s", s), patterns[p] * repeats, 0)
    for s in sorted(quotas, key=repr):
        net.add(("s", s), "to", quotas[s], 0)
    net.solve("from", "to")
    return {p: sum(net.arcs[i ^ 1][1] for i in arcs) for p, arcs in taken.items()}


def mix(docs: DataFrame, sources: Column, weights, share: float = 1.5, repeats: int = 2, seed: int = 17, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Adds size, source_size, target and taken to the columns of ``docs`` without ``text``.

    ``sources`` is the array of sources that a document belongs to (null elements are a source of their own, a null or
    empty array is that null source); ``weights`` maps the list of sources in code point order, null last, to a list of
    weights.  Targets are ``share`` of all words by weight, at most ``repeats`` times the words that a source's members
    hold.  ``size`` counts words (null text: 0), ``source_size`` and ``target`` are those of the first source of the
    document, ``taken`` is what the mix takes of it: its words times whole passes, and for one document of each pattern
    just the words that were still missing.  The order is a keyed hash of id and text, so reruns agree; repeated rows
    stand one after another.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    order = F.array_sort(F.transform(F.array_distinct(F.when(F.coalesce(F.size(sources), F.lit(0)) > 0, sources).otherwise(F.array(F.lit(None).cast("string")))), lambda s: F.struct(s.isNull().alias("none"), s.alias("s"))))
    keep = [c for c in docs.columns if c not in {text, "size", "source_size", "target", "taken"}]
    sized = docs.select(*keep, word_count(text_or_empty(text)).alias("size"), F.transform(order, lambda s: s["s"]).alias("_in"), F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("_hash"))
    sized = materialize(sized.withColumn("_row", F.monotonically_increasing_id()), "mix")
    total = sized.groupBy("_in").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    listed = total.limit(MAX_PATTERNS + 1).collect()
    if len(listed) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {tuple(r["_in"]): int(r["words"]) for r in listed}
    names = sorted({s for p in patterns for s in p}, key=lambda s: (s is None, s or ""))
    held = {s: sum(n for p, n in patterns.items() if s in p) for s in names}
    weigh = dict(zip(names, weights(names), strict=True))
    target = water_fill(held, weigh, share * sum(patterns.values()), repeats)
    flow = route(patterns, {s: round(t) for s, t in target.items()}, repeats)
    plan = spark.createDataFrame(
        [(list(p), held[p[0]], target[p[0]], patterns[p], flow[p]) for p in patterns] or [([None], 0, 0.0, 0, 0)],
        "_p array<string>, source_size long, target double, _words long, _flow long",
    )
    # Two-level running sums: within (pattern, slice of the hash) by a window, over the slices by their totals; so the
    # largest source is spread over as many tasks as it has slices.
    slices = max(1, -(-max((r["rows"] for r in listed), default=0) // BLOCK_ROWS))
    cut = sized.withColumn("_slice", F.floor((F.col("_hash").cast("double") / 2.0**64 + 0.5) * slices).cast("int"))
    inside = W.partitionBy("_in", "_slice").orderBy("_hash", key, "_row").rowsBetween(W.unboundedPreceding, -1)
    whole = cut.groupBy("_in", "_slice").agg(F.sum("size").alias("n")).select(F.col("_in").alias("_p2"), F.col("_slice").alias("_s2"), F.coalesce(F.sum("n").over(W.partitionBy("_in").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    placed = cut.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(whole, F.col("_in").eqNullSafe(F.col("_p2")) & (F.col("_slice") == F.col("_s2")))
    placed = placed.join(plan, F.col("_in").eqNullSafe(F.col("_p")))
    start = F.col("_base") + F.col("_before")
    passes = F.when(F.col("_words") > 0, F.floor(F.col("_flow") / F.greatest(F.col("_words"), F.lit(1)))).otherwise(0).cast("long")
    rest = F.col("_flow") - passes * F.col("_words")
    more = F.least(F.greatest(rest - start, F.lit(0)), F.col("size"))
    return placed.select(*keep, "size", "source_size", "target", (passes * F.col("size") + more).cast("long").alias("taken"))
