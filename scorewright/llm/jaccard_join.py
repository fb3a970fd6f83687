"""N-gram Jaccard join: a blocked sparse product of document by n-gram incidence.

Documents with the same shingle set are one class from the start.  Columns of the incidence (shingles) are dealt into
buckets by hash, and size-derived bounds thin the rows before any product is made:

1. Of two sets that reach the threshold t, each shares t of its own shingles with the other, and in any common order
   the first n - ceil(t n) + l of each have l shingles in common.  Prefixes in hash order are counted by column; a class
   of which fewer than l prefix shingles occur in another class of similar size goes.
2. The whole sets of those left are counted by column; a class with fewer than ceil(t n) shared shingles goes.
3. Classes that share a shingle of their rarest ones are chained; chains are joined into blocks by connected components.

In each block the incidence matrix is multiplied by its transpose; overlaps below the bound are discarded and the rest
links.  What moves between tasks are packed columns, and whole sets only of the classes left after the first count.

Blocks beyond a fixed size are cut by set size and hash into chunks.  Chunks are first multiplied with themselves and a
few neighbours, which joins groups of near copies; what is then still apart from its block's largest component is
multiplied with all chunks of similar sizes, so no link is lost and no group is expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from scorewright.llm._graph import connected_components
from scorewright.llm._shared import forget, materialize, short_batches, tidy, tidy_group, tidy_pair
from scorewright.llm._shingles import set_key, shingle_sets

#: Least Jaccard similarity in hundredths.
THRESHOLD = 75
#: Input bytes, about, whose columns fill one bucket, and the range of bucket numbers (sorted as 16-bit integers).
BUCKET_LOAD, FEWEST_BUCKETS, MOST_BUCKETS = 24 << 20, 8, 1 << 16
#: One shingle in this many of a prefix is in excess of the least prefix.
EXCESS = 8
#: Postings that a task holds before it hands them on.
FLUSH = 500_000
#: A run of postings of one class: its key and size, and the number of postings.
RUN = np.dtype([("key", "<i8"), ("n", "<u4"), ("m", "<u4")])
CHUNK_ROWS, CHUNK_SHINGLES, GROUP_SHINGLES = 2048, 1_000_000, 2_500_000
#: Sets of a chunk, about, that also meet a neighbouring chunk in the first round.
VISITORS = 16
#: Products that one step of a sparse multiplication holds.
STEP = 1_000_000
#: Largest filter (in bits) by which texts are passed over, and the parts in which it is packed.
MOST_BITS, SLICES = 1 << 29, 64


def _need(n, threshold: int):
    """Shingles that a set of size n shares with any set that reaches the threshold, at least."""
    return -(-threshold * n // 100)


def _need_column(n: Column, threshold: int) -> Column:
    return F.ceil(n * threshold / 100).cast("long")


class Forest:
    """Disjoint sets of keys; the root is the smallest member."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        while (p := self.up.setdefault(x, x)) != x:
            self.up[x] = self.up[p]
            x = p
        return x

    def link(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


class Packer:
    """Postings of classes, dealt by shingle into buckets as packed runs."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.sets, self.runs, self.held = [], [], 0

    def add(self, key: int, n: int, shingles: np.ndarray) -> None:
        self.sets.append(shingles)
        self.runs.append((key, n, len(shingles)))
        self.held += len(shingles)

    def flush(self) -> pd.DataFrame:
        rows = []
        if self.held:
            whole, runs = np.concatenate(self.sets), np.array(self.runs, RUN)
            bucket = (((whole & np.uint64(0xFFFFFFFF)) * np.uint64(self.buckets)) >> np.uint64(32)).astype(np.uint16)
            order = np.argsort(bucket, kind="stable")
            owner = np.repeat(np.arange(len(runs)), runs["m"])[order]
            bucket, token = bucket[order], (whole >> np.uint64(32)).astype("<u4")[order]
            at = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1]))))
            runs = runs[owner[at]]
            runs["m"] = np.diff(at, append=len(token))
            first = np.flatnonzero(np.concatenate(([True], np.diff(bucket[at].astype(np.int64)) > 0)))
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(at)]):
                end = at[hi] if hi < len(at) else len(token)
                rows.append((int(bucket[at[lo]]), (hi - lo).to_bytes(8, "little") + runs[lo:hi].tobytes() + token[at[lo] : end].tobytes()))
        self.clear()
        return pd.DataFrame(rows, columns=["bucket", "data"])


class Columns:
    """The columns of one bucket: postings sorted by shingle and class, classes in the order of their sizes."""

    def __init__(self, packed: list[bytes], threshold: int) -> None:
        runs, tokens = [], []
        for data in packed:
            end = 8 + RUN.itemsize * int.from_bytes(data[:8], "little")
            runs.append(np.frombuffer(data[8:end], RUN))
            tokens.append(np.frombuffer(data[end:], "<u4"))
        runs = np.concatenate(runs)
        order = np.lexsort((runs["key"], runs["n"]))
        fresh = np.concatenate(([True], (runs["key"][order][1:] != runs["key"][order][:-1]) | (runs["n"][order][1:] != runs["n"][order][:-1])))
        row = np.empty(len(runs), np.uint32)
        row[order] = np.cumsum(fresh) - 1
        self.classes = runs[order[fresh]]
        # Of the runs of one class, which copies in several tasks have made, one counts.  Its shingles all stay, as two
        # different ones can be equal in the 32 bits that are left of them here.
        one = np.zeros(len(runs), bool)
        one[order[fresh]] = True
        held = np.repeat(one, runs["m"])
        cells = np.empty((int(held.sum()), 2), "<u4")  # read as one integer, the token counts before the class
        cells[:, 0], cells[:, 1] = np.repeat(row[one], runs["m"][one]), np.concatenate(tokens)[held]
        del tokens[:], packed[:], held
        cells = cells.view("<u8").reshape(-1)
        cells.sort()
        cells = cells.view("<u4").reshape(-1, 2)
        token, self.row = cells[:, 1].copy(), cells[:, 0].astype(np.int32)
        del cells
        n = self.classes["n"].astype(np.int64)[self.row]
        same = token[1:] == token[:-1]
        near = same & (100 * n[:-1] >= threshold * n[1:])
        #: Whether a posting has another one of similar size in its column.
        self.shared = np.concatenate((near, [False])) | np.concatenate(([False], near))
        start = np.flatnonzero(np.concatenate(([True], ~same)))
        often = np.diff(start, append=len(token))
        #: Class of the column's number of postings, by powers of two.
        self.level = np.repeat(np.log2(often).astype(np.int8), often)
        self.token, self.n = token, n


def bucket_count(docs: DataFrame) -> int:
    """Buckets from the planner's estimate of the input; any number gives the same result."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(size // BUCKET_LOAD, FEWEST_BUCKETS), MOST_BUCKETS)


def low_key(digest: bytes) -> int:
    """The part of a digest by which counts are kept; classes themselves are told apart by all of it."""
    return int.from_bytes(digest[:8], "little", signed=True)


def document_sets(docs: DataFrame, text: str, key: str, threshold: int, buckets: int) -> DataFrame:
    """Two kinds of rows: (id, at, n, set, low) of each document, and (bucket, data) with packed prefixes in hash order."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, packer = set(), Packer(buckets)
        for batch in batches:
            n, digests = [], []
            for s in shingle_sets(batch["text"].tolist()):
                n.append(len(s))
                digests.append(set_key(s))
                if len(s) and digests[-1] not in seen:
                    seen.add(digests[-1])
                    packer.add(low_key(digests[-1]), len(s), s[: len(s) - _need(len(s), threshold) + max(1, len(s) // EXCESS)])
                    if packer.held >= FLUSH:
                        yield packer.flush().reindex(columns=columns)
            yield pd.DataFrame({"id": batch["id"], "at": batch["at"], "n": n, "set": digests, "low": [low_key(d) for d in digests]}).reindex(columns=columns)
        yield packer.flush().reindex(columns=columns)

    columns = ["id", "at", "n", "set", "low", "bucket", "data"]
    source = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("at"), F.col(text).alias("text"))
    return source.mapInPandas(tidy(task), "id long, at long, n long, set binary, low long, bucket int, data binary")


def counted(packed: DataFrame, threshold: int) -> DataFrame:
    """(bucket, low, n, level, c): shared shingles of each class by bucket and level of frequency."""

    def task(group: pd.DataFrame) -> pd.DataFrame:
        bucket, columns = group["bucket"].iloc[0], Columns(group["data"].tolist(), threshold)
        cell, c = np.unique(columns.row[columns.shared].astype(np.int64) * 64 + columns.level[columns.shared], return_counts=True)
        own = columns.classes[cell // 64]
        return pd.DataFrame({"bucket": bucket, "low": own["key"].astype(np.int64), "n": own["n"].astype(np.int64), "level": cell % 64, "c": c})

    return packed.groupBy("bucket").applyInPandas(tidy_group(task), "bucket int, low long, n long, level int, c long")


def chained(packed: DataFrame, marks: DataFrame, threshold: int) -> DataFrame:
    """(a, b): chains through the classes that share one of their rarest shingles and have close sizes.

    ``marks`` has bucket, low and last, the level up to which a class's shingles count; classes without one do not.
    """

    def task(group: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(marks):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        columns = Columns(group["data"].tolist(), threshold)
        marks = marks.sort_values("low")
        low, level = marks["low"].to_numpy(), marks["last"].to_numpy()
        at = np.minimum(np.searchsorted(low, columns.classes["key"]), len(low) - 1)
        last = np.where(low[at] == columns.classes["key"], level[at], -1)
        pick = columns.shared & (columns.level <= last[columns.row])
        token, row, n = columns.token[pick], columns.row[pick], columns.n[pick]
        at = np.flatnonzero((token[1:] == token[:-1]) & (100 * n[:-1] >= threshold * n[1:])) if len(token) else []
        forest = Forest()
        for a, b in np.unique(np.stack([row[at], row[at + 1]], 1), axis=0).tolist() if len(at) else ():
            forest.link(a, b)
        key = columns.classes["key"].astype(np.int64)
        pairs = [(x, r) for x in list(forest.up) if (r := forest.root(x)) != x]
        return pd.DataFrame({"a": key[[a for a, _ in pairs]], "b": key[[b for _, b in pairs]]}, dtype="int64")

    return packed.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInPandas(tidy_pair(task), "a long, b long")


def hash_filter(hashes: DataFrame):
    """A broadcast bitmap of the hashes in column ``at``: a test that is true for all of them and for few others.

    It is packed by Spark tasks in SLICES parts and has 2^29 bits (64 MB) at most; where hashes are more than it can
    tell apart it lets more pass, which the next count sorts out.
    """
    bits = min(MOST_BITS, 1 << max(16, (64 * hashes.count()).bit_length()))
    place = F.pmod("at", F.lit(bits))
    part = hashes.select(F.floor(place / (bits // SLICES)).cast("int").alias("slice"), F.pmod(place, F.lit(bits // SLICES)).alias("bit"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        marks = np.zeros(bits // SLICES, bool)
        marks[group["bit"].to_numpy()] = True
        return pd.DataFrame({"slice": group["slice"].iloc[:1], "bits": [np.packbits(marks, bitorder="little").tobytes()]})

    found = {r["slice"]: r["bits"] for r in part.distinct().groupBy("slice").applyInPandas(pack, "slice int, bits binary").collect()}
    empty = bytes(bits // SLICES // 8)
    shipped = hashes.sparkSession.sparkContext.broadcast(b"".join(found.get(i, empty) for i in range(SLICES)))

    def has(at: np.ndarray) -> np.ndarray:
        at = at & (bits - 1)
        return (np.frombuffer(shipped.value, np.uint8)[at >> 3] >> (at & 7)) & 1 == 1

    return has


def incidence(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """(set, low, n, data): the sets of the wanted classes, made again from texts whose hash passes a filter.

    ``wanted`` has at, the hash of a text of each class.  Each task gives a set once.  The few others that pass the
    filter are classes too, and go with the second count.
    """
    has = hash_filter(wanted)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for batch in batches:
            rows, held = [], 0
            for s in shingle_sets(batch["text"][has(batch["at"].to_numpy(np.int64))].tolist()):
                digest = set_key(s)
                if len(s) and digest not in seen:
                    seen.add(digest)
                    rows.append((digest, low_key(digest), len(s), s.tobytes()))
                    held += len(s)
                if held >= FLUSH:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    columns = ["set", "low", "n", "data"]
    return docs.select(F.xxhash64(text).alias("at"), F.col(text).alias("text")).mapInPandas(tidy(task), "set binary, low long, n long, data binary")


def packed_sets(sets: DataFrame, buckets: int) -> DataFrame:
    """(bucket, data): whole sets as packed columns.  ``sets`` has low, n and data."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(buckets)
        for batch in batches:
            for low, n, data in zip(batch["low"].tolist(), batch["n"].tolist(), batch["data"]):
                packer.add(low, n, np.frombuffer(data, np.uint64))
                if packer.held >= FLUSH:
                    yield packer.flush()
        yield packer.flush()

    return sets.select("low", "n", "data").mapInPandas(tidy(task), "bucket int, data binary")


def rarest(counts: DataFrame, threshold: int) -> DataFrame:
    """(low, last) of the classes with enough shared shingles; ``last`` is the level up to which the rarest of them lie.

    A set's shingles that it shares with none of similar size come first in any count of the rarest.
    """
    levels = counts.groupBy("low", "n", "level").agg(F.sum("c").alias("c")).groupBy("low", "n").agg(F.sum("c").alias("all"), F.array_sort(F.collect_list(F.struct("level", "c"))).alias("levels"))
    enough = levels.withColumn("most", F.col("all") - _need_column(F.col("n"), threshold) + 1).where("most > 0")
    found = F.aggregate("levels", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("last")), lambda a, x: F.when(a["sum"] >= F.col("most"), a).otherwise(F.struct((a["sum"] + x["c"]).alias("sum"), x["level"].alias("last"))))
    return enough.select("low", "n", found["last"].alias("last"))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of two blocks of sets: incidence times transposed incidence, in slices of columns."""
    rows = np.concatenate([np.full(len(s), i) for i, s in enumerate(left)])
    cols = np.concatenate([np.full(len(s), i) for i, s in enumerate(right)])
    grams, out = np.concatenate(left), np.zeros((len(left), len(right)), np.int64)
    others = np.concatenate(right)
    if left is right:
        kinds, often = np.unique(grams, return_counts=True)
        shared = kinds[often > 1]
    else:
        shared = np.intersect1d(np.unique(grams), np.unique(others), assume_unique=True)

    def placed(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(shared, h)
        at[at == len(shared)] = 0
        ok = shared[at] == h if len(shared) else np.zeros(len(h), bool)
        order = np.argsort(at[ok], kind="stable")
        return at[ok][order], doc[ok][order]

    (gl, dl), (gr, dr) = placed(grams, rows), placed(others, cols)
    nl, nr = np.bincount(gl, minlength=len(shared)), np.bincount(gr, minlength=len(shared))
    work = np.cumsum(nl * nr)
    if not len(work):
        return out
    if work[-1] > len(left) * len(right) * len(shared) / 8:  # dense: common groups
        for lo in range(0, len(shared), 4096):
            hi = min(lo + 4096, len(shared))
            a, b = np.zeros((len(left), hi - lo), np.float32), np.zeros((len(right), hi - lo), np.float32)
            pl, pr = slice(*np.searchsorted(gl, [lo, hi])), slice(*np.searchsorted(gr, [lo, hi]))
            a[dl[pl], gl[pl] - lo] = 1
            b[dr[pr], gr[pr] - lo] = 1
            out += np.rint(a @ b.T).astype(np.int64)
        return out
    fl, fr = np.cumsum(nl) - nl, np.cumsum(nr) - nr
    edge = [0, *(np.searchsorted(work, np.arange(STEP, work[-1], STEP)) + 1).tolist(), len(shared)]
    for lo, hi in zip(edge, edge[1:]):  # every posting on the left meets the postings of its column on the right
        if hi <= lo:
            continue
        g, d = gl[fl[lo] : fl[hi - 1] + nl[hi - 1]], dl[fl[lo] : fl[hi - 1] + nl[hi - 1]]
        n = nr[g]
        ends = np.cumsum(n)
        place = np.repeat(fr[g] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        out += np.bincount(np.repeat(d, n) * len(right) + dr[place], minlength=out.size).reshape(out.shape)
    return out


def _links(left: pd.DataFrame, right: pd.DataFrame, threshold: int) -> Iterator[tuple[int, int]]:
    """Pairs of classes that reach the threshold; overlaps below the size-derived bound are discarded at once.

    A set alone on the diagonal overlaps with nothing and its link to itself is of no account.
    """
    a = [np.frombuffer(x, np.uint64) for x in left["data"]]
    b = a if left is right else [np.frombuffer(x, np.uint64) for x in right["data"]]
    na, nb = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    inter = overlaps(a, b)
    # 100 I >= t (na + nb - I)
    i, j = np.nonzero((inter > 0) & ((100 + threshold) * inter >= threshold * (na[:, None] + nb[None, :])))
    ka, kb = left["set"].to_numpy(), right["set"].to_numpy()
    return zip(ka[i].tolist(), kb[j].tolist())


def _rooted(keys, links) -> pd.DataFrame:
    forest = Forest()
    for k in keys:
        forest.root(k)
    for a, b in links:
        forest.link(a, b)
    return pd.DataFrame([(k, forest.root(k)) for k in list(forest.up)], columns=["a", "b"], dtype="object")


def multiply_blocks(sets: DataFrame, threshold: int) -> DataFrame:
    """(a, b): root of every class, from blocks that fit one task.  ``sets`` has task, block, set, data."""

    def task(group: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": [], "b": []}, dtype="object")]
        for _, g in group.groupby("block"):
            g = g.drop_duplicates("set")
            out.append(_rooted(g["set"].tolist(), _links(g, g, threshold)))
        return pd.concat(out)

    return sets.groupBy("task").applyInPandas(tidy_group(task), "a binary, b binary")


def multiply_cells(cells: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(a, b): links found in cells.  ``cells`` has cell (array), side and set; ``sets`` has set and data.

    Side 2 meets itself, side 0 meets side 1.
    """

    def task(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["set", "side"])
        left, right = group[group["side"] != 1], group[group["side"] == 1]
        if (group["side"] == 2).any():
            right = left
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}, dtype="object")
        out = _rooted([], _links(left, right, threshold))
        return out[out["a"] != out["b"]]

    return cells.join(sets.select("set", "data"), "set").select("cell", "side", "set", "data").groupBy("cell").applyInPandas(tidy_group(task), "a binary, b binary")


def _with_chunks(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a chunk number within (block, band), and the number of chunks of each (block, band)."""
    count = rows.groupBy("block", "band").agg(F.greatest(F.ceil(F.count("*") / CHUNK_ROWS), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int").alias(name), F.count("*").alias("m"))
    return rows.join(count.drop("m"), ["block", "band"]).withColumn("chunk", F.pmod(F.xxhash64("set"), F.col(name)).cast("int")), count


def _large_blocks(members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(a, b): links that join the components of blocks too large for one task.

    Cells are dealt on narrow rows; the sets join last.
    """
    spark = members.sparkSession
    band = F.floor(F.log("n") / float(np.log(100 / threshold)) + 1e-9)
    rows, count = _with_chunks(members.select("set", "block", band.alias("band"), "n"), "c")
    rows, count = materialize(rows, "chunks"), materialize(count, "counts")
    beside = lambda by, name: count.select("block", (F.col("band") + by).alias("band"), F.col("c").alias(name))
    around = rows.join(count.select("block", "band", "m"), ["block", "band"]).join(beside(1, "below"), ["block", "band"], "left")
    band, chunk = F.col("band"), F.col("chunk")
    # Cell (band, i) holds chunk i, the next chunk of the band, and one of the band above.
    # A part of each chunk does for the neighbours: near copies link through any of them, and the second round is exact.
    own = F.array(F.struct(band.alias("band"), chunk.alias("i")))
    beside_own = F.array(F.struct(band.alias("band"), F.pmod(chunk - 1, F.col("c")).alias("i")))
    visits = F.pmod(F.xxhash64(F.lit(VISITORS), "set"), F.greatest(F.lit(1), F.floor(F.col("m") / F.col("c") / VISITORS))) == 0
    from_below = F.when(F.col("below") > chunk, F.transform(F.sequence(chunk, F.col("below") - 1, F.col("c")), lambda j: F.struct((band - 1).alias("band"), j.alias("i")))).otherwise(F.array().cast("array<struct<band:bigint,i:int>>"))
    away = F.when(visits, F.concat(beside_own, from_below)).otherwise(F.array().cast("array<struct<band:bigint,i:int>>"))
    cells = around.select("set", "block", F.explode(F.array_distinct(F.concat(own, away))).alias("x")).select("set", F.array("block", "x.band", F.col("x.i").cast("long")).alias("cell"), F.lit(2).alias("side"))
    near = materialize(multiply_cells(cells, sets, threshold), "links")
    labels = materialize(connected_components(near), "labels")
    # Whatever is apart from the largest component of its block meets all chunks of similar sizes.
    named = rows.join(labels.withColumnRenamed("node", "set"), "set", "left").withColumn("label", F.coalesce("label", "set"))
    largest = named.groupBy("block", "label").agg(F.count("*").alias("m")).groupBy("block").agg(F.max_by("label", F.struct("m", "label")).alias("main"))
    # They are dealt by the band that they meet, so that a set of that band stands in few cells.
    apart = named.join(largest, "block").where("label <> main").select("block", F.explode(F.array(band - 1, band, band + 1)).alias("band"), "set", "n")
    few, few_count = _with_chunks(apart.join(count, ["block", "band"], "left_semi"), "k")
    number = lambda *xs: F.array(*[x.cast("long") for x in xs]).alias("cell")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("other")
    left = few.join(count.select("block", "band", "c"), ["block", "band"]).select("*", every("c")).select("set", number(F.col("block"), band, chunk, F.col("other")), F.lit(0).alias("side"))
    right = rows.join(few_count.select("block", "band", "k"), ["block", "band"]).select("*", every("k")).select("set", number(F.col("block"), band, F.col("other"), chunk), F.lit(1).alias("side"))
    far = materialize(multiply_cells(left.unionByName(right), sets, threshold), "links")
    out = materialize(connected_components(near.unionByName(far)), "labels").select(F.col("node").alias("a"), F.col("label").alias("b"))
    forget(spark, near, labels, rows, count, far)
    return out


def jaccard_components(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: int = THRESHOLD) -> DataFrame:
    """(key, n_shingles, component_id): groups of documents linked by a Jaccard similarity of ``threshold`` hundredths.

    Words are runs of non-space after A-Z are lower-cased; a document's set has its distinct five-word shingles, or its
    whole word sequence if shorter.  ``component_id`` is the smallest key reachable by links.  A null or empty text has
    an empty set and is linked with nothing.  Every row of ``docs`` gives one row; null keys count as no key, and a
    group without any key has a null component.  Shingles are compared by 64-bit hashes, sets by 128-bit digests of them.
    """
    short_batches(docs.sparkSession)
    buckets = bucket_count(docs.select(text))
    found = materialize(document_sets(docs, text, key, threshold, buckets), "sets")
    each = found.where("bucket is null").select("id", "at", "n", "set", "low")
    least = _need_column(F.col("n"), threshold)
    some = counted(found.where("bucket is not null").select("bucket", "data"), threshold).groupBy("low", "n").agg(F.sum("c").alias("c")).where(F.col("c") >= F.greatest(F.lit(1), F.floor(least / EXCESS))).select("low", "n")
    # A text stands for each class: the one with the least hash.
    stands = materialize(each.where("n > 0").join(some, ["low", "n"], "left_semi").groupBy("set", "low", "n").agg(F.min("at").alias("at")), "stands")
    sets = materialize(incidence(docs, stands, text), "incidence")
    counts = materialize(counted(packed_sets(sets, buckets), threshold), "counts")
    marks = counts.select("bucket", "low").distinct().join(rarest(counts, threshold).select("low", "last"), "low")
    edges = materialize(chained(packed_sets(sets, buckets), marks, threshold), "chains")
    blocks = materialize(connected_components(edges), "blocks")
    member = sets.select("set", "low", "n").distinct().join(blocks.select(F.col("node").alias("low"), F.col("label").alias("block")), "low")
    size = member.groupBy("block").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles")).where("rows > 1")
    member = materialize(member.join(size, "block"), "members")
    fits = (F.col("rows") <= CHUNK_ROWS) & (F.col("shingles") <= GROUP_SHINGLES)
    total = member.agg(F.coalesce(F.sum(F.when(fits, F.col("n"))), F.lit(0)).alias("n"), F.coalesce(F.bool_or(~fits), F.lit(False)).alias("large")).first()
    tasks = max(8, -(-int(total.n) // (GROUP_SHINGLES // 2)))
    dealt = member.where(fits).select("set", "block", F.pmod(F.xxhash64("block"), F.lit(tasks)).alias("task"))
    roots = multiply_blocks(sets.select("set", "data").join(dealt, "set"), threshold)
    if total.large:
        roots = roots.unionByName(_large_blocks(member.where(~fits), sets, threshold))
    roots = materialize(roots, "roots")
    classes = each.where("n > 0").groupBy("set").agg(F.min("id").alias("id"))
    label = classes.join(roots.select(F.col("a").alias("set"), "b"), "set", "left").select("set", "id", F.coalesce("b", "set").alias("label"))
    named = label.join(label.groupBy("label").agg(F.min("id").alias("component_id")), "label").select("set", "component_id")
    linked = each.where("n > 0").join(named, "set").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")
    out = materialize(linked.unionByName(each.where("n = 0").select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_shingles"), F.col("id").alias("component_id"))), "components")
    forget(docs.sparkSession, found, stands, sets, counts, edges, blocks, member, roots)
    return out
