"""Cosines of TF-IDF n-gram vectors of two texts a row, for several orders, without a row for each n-gram.

Rows are dealt into blocks of a bounded size by a hash of their key.  A block sends each of its n-grams once, as a sorted
64-bit hash with the number of its references that hold it, to the bucket of the hash's first bits; buckets add these up
and send the sums back to the blocks, which hold the texts' rows and need no more than that.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from scorewright.functions.grams import Grams, counted, runs, shared

#: Characters of both texts of a block's rows, and of all rows for one bucket: each is worked on in one task.
BLOCK_CHARS, BUCKET_CHARS = 8_000_000, 4_000_000


def _packed(rising: np.ndarray) -> bytes:
    """Rising 64-bit numbers as the bytes of their steps, place by place: the first places are nearly all zero."""
    return np.diff(rising, prepend=np.uint64(0)).astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(np.uint64), dtype=np.uint64)


def _counts(values: np.ndarray) -> bytes:
    return zlib.compress(values.astype("<u4").tobytes(), 1)


def _of_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), "<u4")


class _Block:
    """Counted n-grams of the rows of a block; rows with the same key are one."""

    def __init__(self, rows: pd.DataFrame, orders: list[int]) -> None:
        self.owner, self.keys = pd.factorize(rows["key"], use_na_sentinel=False)
        self.sides = []  # for each side a list of (counted, hash and owner of each) by order
        for side in ("p", "r"):
            grams = Grams(rows[side].tolist())
            found = []
            for n, (hashes, row) in enumerate(grams.orders(max(orders)), 1):
                if n in orders:
                    owner = self.owner[row]
                    c = counted(hashes, owner)
                    found.append((c, hashes[c[1]], owner[c[1]]))
            self.sides.append(found)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams by rising hash, and how many references hold each; keeps where each side's ones stand among them."""
        found = [h for side in self.sides for _, h, _ in side]
        every = np.concatenate(found)
        order, begins, n = runs(every)
        self.at = np.empty(len(every), np.int64)
        self.at[order] = np.repeat(np.arange(len(begins)), n)
        ours = sum(len(h) for _, h, _ in self.sides[0])
        return every[order[begins]], np.bincount(self.at[ours:], minlength=len(begins))

    def cosines(self, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cosine of each key and order, whether the key has any n-gram), from a weight for each of ``grams``."""
        size, orders = len(self.keys), len(self.sides[0])
        weights = np.split(idf[self.at], np.cumsum([len(h) for side in self.sides for _, h, _ in side])[:-1])
        out, some = np.zeros((size, orders)), np.zeros(size, bool)
        for k, ((p, _, op), (r, _, or_)) in enumerate(zip(*self.sides, strict=True)):
            a, b = p[2] * weights[k], r[2] * weights[orders + k]
            i, j = shared(p, r)
            dot, aa, bb = np.bincount(op[i], a[i] * b[j], size), np.bincount(op, a * a, size), np.bincount(or_, b * b, size)
            norm = np.sqrt(aa) * np.sqrt(bb)
            np.divide(dot, norm, out=out[:, k], where=norm > 0)
            some[op] = some[or_] = True
        return out, some


def gram_cosines(df: DataFrame, key: str, prediction: Column, reference: Column, orders: list[int]) -> DataFrame:
    """(key, cosines): one for each of ``orders``, 0 where it has no n-grams; keys without n-grams of any are left out.

    A reference's n-grams weigh log(rows / rows whose reference holds it).  Texts are lower-cased, null ones are empty.
    """
    text = lambda c: F.coalesce(F.lower(c), F.lit(""))
    rows = df.select(F.col(key).alias("key"), text(prediction).alias("p"), text(reference).alias("r"))
    total, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.char_length("p").cast("long") + F.char_length("r")), F.lit(0))).first()
    blocks, bits = -(-chars // BLOCK_CHARS) or 1, max(chars // BUCKET_CHARS, 1).bit_length()
    rows = rows.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), "key", "p", "r")

    def send(block: pd.DataFrame) -> pd.DataFrame:
        hashes, n = _Block(block, orders).grams()
        edges = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() + [len(hashes)]
        out = [(int(block["block"].iloc[0]), k, _packed(hashes[a:b]), _counts(n[a:b])) for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
        return pd.DataFrame(out, columns=["block", "bucket", "hashes", "n"])

    def add(bucket: pd.DataFrame) -> pd.DataFrame:
        parts = [_of_counts(x) for x in bucket["n"]]
        order, begins, n = runs(np.concatenate([_unpacked(x) for x in bucket["hashes"]]))
        sums = np.empty(len(order), np.int64)
        sums[order] = np.repeat(np.add.reduceat(np.concatenate(parts)[order], begins, dtype=np.int64), n)
        ends = np.cumsum([len(x) for x in parts])
        return pd.DataFrame({"block": bucket["block"], "bucket": bucket["bucket"], "n": [_counts(x) for x in np.split(sums, ends[:-1])]})

    def score(block: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(sums):
            return pd.DataFrame({"key": block["key"].iloc[:0], "cosines": []})
        made = _Block(block, orders)
        n = np.concatenate([_of_counts(x) for x in sums.sort_values("bucket")["n"]])
        made.grams()
        found, some = made.cosines(np.log(total) - np.log(np.maximum(n, 1)))
        return pd.DataFrame({"key": made.keys[some], "cosines": list(found[some])})

    sent = rows.groupBy("block").applyInPandas(send, "block long, bucket int, hashes binary, n binary")
    sums = sent.groupBy("bucket").applyInPandas(add, "block long, bucket int, n binary")
    kind = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("cosines", T.ArrayType(T.DoubleType()))])
    return rows.groupBy("block").cogroup(sums.groupBy("block")).applyInPandas(score, kind).withColumnRenamed("key", key)
