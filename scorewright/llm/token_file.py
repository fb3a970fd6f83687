"""Token files: fixed-width bit packing with block offsets, written and read by Spark tasks.

A shard holds, in little-endian order: a header, blocks of packed ids, the document table (ids and lengths), the block
offsets, and a footer with their places.  Every id takes the minimum bits of the vocabulary.  A reader of some place
unpacks only the blocks that hold it.  Shards lie in ascending document order, as their numbers do; each is written by
one task attempt under a name of its own, so a lost executor leaves at most a file that no manifest names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from scorewright.llm._shared import materialize, scratch_path, short_batches, text_or_empty, tidy
from scorewright.llm.tokens import encoder, text_slices

MAGIC = b"BITPACK1"
HEADER, FOOTER = "<8sII", "<QQQQ8s"  # magic, bits, ids a block; documents, ids, table, offsets
BLOCK_IDS = 1 << 16


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """Eight ids fill ``bits`` bytes; the last group is filled with zeros and cut to whole bytes."""
    n = len(ids)
    wide = np.zeros(-(-n // 8) * 8, np.uint64)
    wide[:n] = ids
    wide = wide.reshape(-1, 8)
    out = np.zeros((len(wide), bits), np.uint8)
    for i in range(8):
        for j in range(i * bits // 8, ((i + 1) * bits - 1) // 8 + 1):
            shift = 8 * j - i * bits
            out[:, j] |= ((wide[:, i] >> np.uint64(shift)) if shift >= 0 else (wide[:, i] << np.uint64(-shift))).astype(np.uint8)
    return out.tobytes()[: -(-n * bits // 8)]


def unpack_ids(data: bytes, n: int, bits: int) -> np.ndarray:
    groups = -(-n // 8)
    raw = np.zeros(groups * bits, np.uint8)
    got = np.frombuffer(data, np.uint8)
    raw[: len(got)] = got
    raw = raw.reshape(groups, bits)
    out = np.zeros((groups, 8), np.uint64)
    for i in range(8):
        for j in range(i * bits // 8, ((i + 1) * bits - 1) // 8 + 1):
            shift = 8 * j - i * bits
            byte = raw[:, j].astype(np.uint64)
            out[:, i] |= (byte << np.uint64(shift)) if shift >= 0 else (byte >> np.uint64(-shift))
    return (out & np.uint64((1 << bits) - 1)).astype("<u4").reshape(-1)[:n]


def _open(uri: str, write: bool):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_output_stream(path) if write else system.open_input_file(path)


class Shard:
    """Random access to a shard by any file object with seek and read."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.seek(0, 2) if not hasattr(file, "size") else file.size()
        self.documents, self.ids, table, offsets, magic = struct.unpack(FOOTER, self._at(size - struct.calcsize(FOOTER), struct.calcsize(FOOTER)))
        head, self.bits, self.block = struct.unpack(HEADER, self._at(0, struct.calcsize(HEADER)))
        if magic != MAGIC or head != MAGIC:
            raise ValueError("not a token shard")
        raw = self._at(table, 16 * self.documents)
        self.keys = np.frombuffer(raw[: 8 * self.documents], "<i8")
        self.lengths = np.frombuffer(raw[8 * self.documents :], "<i8")
        self.offsets = np.frombuffer(self._at(offsets, 8 * (-(-self.ids // self.block) + 1)), "<u8")

    def _at(self, place: int, n: int) -> bytes:
        self.file.seek(int(place))
        return self.file.read(int(n))

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of blocks first .. last - 1."""
        n = min(last * self.block, self.ids) - first * self.block
        return unpack_ids(self._at(self.offsets[first], self.offsets[last] - self.offsets[first]), n, self.bits)

    def slice(self, start: int, n: int) -> np.ndarray:
        first, last = start // self.block, -(-(start + n) // self.block)
        return self.blocks(first, last)[start - first * self.block :][:n] if n > 0 else np.empty(0, "<u4")


def write_tokens(docs: DataFrame, path: str, end_id: int = 2, folder: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode every whole text, write shards in ascending ``key`` order and return their manifest.

    The manifest has shard, file, n_docs and n_ids, a row for each shard.  Null texts are empty; each document ends with
    ``end_id``.  Null keys come first (kept as the smallest integer), repeated keys follow the order of a hash of their
    texts, and so are spread over shards.  An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    short_batches(spark)
    folder = folder or scratch_path(spark, "tokens")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        name = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.bin"
        out, place, keys, lengths, offsets, kept, total = None, 0, [], [], [], [], 0

        def flush(last: bool) -> None:
            nonlocal kept, place
            ids = np.concatenate(kept) if kept else np.empty(0, np.uint32)
            edge = len(ids) if last else len(ids) // BLOCK_IDS * BLOCK_IDS
            for lo in range(0, edge, BLOCK_IDS):
                data = pack_ids(ids[lo : min(lo + BLOCK_IDS, edge)], bits)
                offsets.append(place)
                out.write(data)
                place += len(data)
            kept = [ids[edge:]]

        with encoder(path) as encode:
            bits = bits_for(encode.size)
            for batch in batches:
                texts = batch["text"].tolist()
                if not texts:
                    continue
                if out is None:
                    import pyarrow.fs as pafs

                    system, local = pafs.FileSystem.from_uri(folder)
                    system.create_dir(local, recursive=True)
                    out = _open(name, True)
                    out.write(struct.pack(HEADER, MAGIC, bits, BLOCK_IDS))
                    place = struct.calcsize(HEADER)
                keys.append(batch["key"].to_numpy(np.int64))
                for lo, hi in text_slices(texts):
                    ids, n = encode.encode(texts[lo:hi])
                    kept.append(np.insert(ids, np.cumsum(n), end_id))
                    lengths.append(n + 1)
                    total += len(kept[-1])
                    flush(False)
        if out is None:
            return
        flush(True)
        offsets.append(place)
        keys, lengths = np.concatenate(keys), np.concatenate(lengths)
        out.write(keys.astype("<i8").tobytes() + lengths.astype("<i8").tobytes() + np.array(offsets, "<u8").tobytes())
        out.write(struct.pack(FOOTER, len(keys), total, place, place + 16 * len(keys), MAGIC))
        out.close()
        yield pd.DataFrame({"shard": [shard], "file": [name], "n_docs": [len(keys)], "n_ids": [total]})

    source = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("key"), text_or_empty(text).alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = source.repartitionByRange("key", "h").sortWithinPartitions("key", "h").select("key", "text")
    return materialize(ordered.mapInPandas(tidy(write), "shard int, file string, n_docs long, n_ids long"), "manifest")


def read_documents(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, read back from the shards of a manifest.

    ``start`` counts the ids of all documents before it.  Each shard is one task's work and is read in runs of blocks.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, base in zip(batch["file"], batch["base"], strict=True):
                shard = Shard(_open(name, False))
                starts = np.cumsum(shard.lengths) - shard.lengths
                crcs, doc, rest = np.zeros(shard.documents, np.int64), 0, np.empty(0, "<u4")
                n_blocks, crc = len(shard.offsets) - 1, 0
                need = int(shard.lengths[0]) if shard.documents else 0
                for first in range(0, n_blocks, 16):
                    rest = shard.blocks(first, min(first + 16, n_blocks))
                    at = 0
                    while doc < shard.documents and at < len(rest):
                        take = min(need, len(rest) - at)
                        crc = zlib.crc32(rest[at : at + take].tobytes(), crc)
                        at, need = at + take, need - take
                        if need == 0:
                            crcs[doc], crc, doc = crc, 0, doc + 1
                            need = int(shard.lengths[doc]) if doc < shard.documents else 0
                null = shard.keys == -(2**63)
                yield pd.DataFrame({key: pd.array(np.where(null, 0, shard.keys), "Int64").copy() if not null.any() else pd.Series(shard.keys, dtype="Int64").mask(null), "start": starts + base, "n_tokens": shard.lengths, "ids_crc32": crcs})

    shards = manifest.count()
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row for each shard
    return based.repartition(max(1, shards)).mapInPandas(tidy(read), f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, file: str, start: int, n: int) -> np.ndarray:
    """Ids start .. start + n - 1 of one shard; unpacks only their blocks."""
    return Shard(_open(file, False)).slice(start, n)
