"""Best-fit-decreasing packing of token pieces into sequences.

Bins with the same room are alike and pieces of the same length are alike, so the exact best-fit-decreasing result is
computed on the histogram of lengths: a segment tree over remaining capacities finds the tightest open run of bins in
logarithmic time, and one step places as many equal pieces as that run takes.  The plan has a bounded size whatever the
number of pieces: at most capacity lengths, and a bounded number of runs.  Spark ranks the pieces of each length (in
salted groups, so that one very common length is spread over many tasks) and looks their places up in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from scorewright.llm._shared import materialize, short_batches, text_or_empty, tidy
from scorewright.llm.tokens import encoder, text_slices

CAPACITY, END_ID, BLOCK_ROWS = 2048, 0, 50_000


class RoomTree:
    """Segment tree over remaining capacities 0..capacity; a leaf is set while a run of bins has that much room."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def push(self, room: int, first: int, n: int) -> None:
        if n <= 0 or room <= 0:
            return
        self.runs.setdefault(room, []).append((first, n))
        i = room + self.size
        while i and not self.any[i]:
            self.any[i] = True
            i >>= 1

    def pop_tightest(self, need: int) -> tuple[int, int, int] | None:
        """(room, first bin, bins) of the run with the least room of at least ``need``."""
        i = need + self.size
        if not self.any[i]:
            while i > 1 and (i & 1 or not self.any[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        room = i - self.size
        first, n = self.runs[room].pop()
        if not self.runs[room]:
            while i and not (self.any[2 * i] or self.any[2 * i + 1] if i < self.size else False):
                self.any[i] = False
                i >>= 1
        return room, first, n


def best_fit_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, pieces, first bin, offset): piece rank r of a length lies in bin first + r - first rank."""
    tree, bins, plan = RoomTree(capacity), 0, []
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            run = tree.pop_tightest(length)
            if run is None:  # best fit fills a new bin with equal pieces before it opens the next
                n = -(-left // (capacity // length))
                run = capacity, bins, n
                bins += n
            room, first, n = run
            each = room // length
            used = min(n, -(-left // each))
            here = min(left, used * each)
            full, part = divmod(here, each)
            for j in range(each):
                count = full + (j < part)
                if count:
                    plan.append((length, rank, count, first, capacity - room + j * length))
                    rank += count
            left -= here
            tree.push(room - each * length, first, full)
            if part:
                tree.push(room - part * length, first + full, 1)
            tree.push(room, first + used, n - used)
    return plan


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids_crc32): the token pieces of every whole text, null read as empty.

    A text has its tokenizer ids and ``end_id``; one of more than ``capacity`` ids is cut into pieces of that length,
    of which the first may be shorter.
    """
    kind = dict(docs.dtypes)[key]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with encoder(path) as encode:
            for batch in batches:
                texts, keys = batch["text"].tolist(), batch["key"]
                for lo, hi in text_slices(texts):
                    ids, lengths = encode.encode(texts[lo:hi])
                    rows, at = [], 0
                    for i, n in enumerate(lengths.tolist()):
                        whole = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                        at, n = at + n, n + 1
                        edges = [0, n] if n <= capacity else [0, *range(n % capacity or capacity, n + 1, capacity)]
                        rows += [(lo + i, k, a, b - a, zlib.crc32(whole[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
                    at_, piece, start, length, crc = zip(*rows)
                    yield pd.DataFrame({key: keys.iloc[list(at_)].array, "piece": piece, "start": start, "length": length, "ids_crc32": crc})

    short_batches(docs.sparkSession)
    source = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    return source.mapInPandas(tidy(cut), f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """Adds sequence_id and offset (long) to every row of ``pieces``: best fit decreasing over all rows.

    Offsets of a sequence are gapless from 0.  Equal lengths take their places in the order of a hash of the row, equal
    rows in any order.  Rows whose length is null, below 1 or above ``capacity`` fit nowhere and get nulls.  Columns of
    ``pieces`` named sequence_id or offset are replaced.
    """
    rows = pieces.drop("sequence_id", "offset")
    columns = rows.columns
    rows = materialize(rows.withColumn("_hash", F.xxhash64(*columns)), "pieces")  # read three times below
    fits = rows.where(F.col(length).between(1, capacity))
    counts = fits.groupBy(length).agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    plan = best_fit_plan({int(r[length]): int(r["n"]) for r in counts}, capacity)
    lengths, ranks, _, bins, offsets = (np.array(x, np.int64) for x in (zip(*plan) if plan else [()] * 5))
    order = np.lexsort((ranks, lengths))
    lengths, ranks, bins, offsets = lengths[order], ranks[order], bins[order], offsets[order]
    places = (lengths << 44) + ranks

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(n: pd.Series, rank: pd.Series) -> pd.DataFrame:
        i = np.searchsorted(places, (n.to_numpy(np.int64) << 44) + rank.to_numpy(np.int64), side="right") - 1
        return pd.DataFrame({"sequence_id": bins[i] + rank.to_numpy(np.int64) - ranks[i], "offset": offsets[i]})

    salts = max(1, -(-sum(int(r["n"]) for r in counts) // BLOCK_ROWS))
    salted = fits.withColumn("_salt", F.pmod("_hash", F.lit(salts)))
    before = salted.groupBy(length, "_salt").agg(F.count("*").alias("_n"))
    before = before.select(F.col(length).alias("_l"), F.col("_salt").alias("_s"), F.coalesce(F.sum("_n").over(W.partitionBy(length).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    ranked = salted.withColumn("_rank", F.row_number().over(W.partitionBy(length, "_salt").orderBy("_hash", *columns)) - 1)
    placed = ranked.join(before, (F.col(length) == F.col("_l")) & (F.col("_salt") == F.col("_s"))).withColumn("_at", place(F.col(length), F.col("_base") + F.col("_rank")))
    nowhere = rows.where(~F.coalesce(F.col(length).between(1, capacity), F.lit(False))).select(*columns, F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    return placed.select(*columns, "_at.sequence_id", "_at.offset").unionByName(nowhere)
