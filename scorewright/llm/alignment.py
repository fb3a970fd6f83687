"""Cross-tokenizer alignment: where two tokenizers cut a text at the same byte, and how often their ids meet there.

Tokens of A (byte-level BPE of space+text) and of B (sentencepiece, which adds that space) are cut into groups at the byte
offsets where tokens of both end.  Distinct groups of ids are interned: first within a block of documents, by 64-bit
hashes, then over the corpus by the ids themselves.  Links of ids are expanded once for each distinct group and multiplied by its frequency; the counts come back to
the blocks by group key, and a block's own dictionary turns them into figures of its documents.  So what is shuffled is
one row for each distinct group of a block and two or three bytes for each group of a document, never texts or pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scorewright.llm._shared import materialize, short_batches, text_or_empty, tidy
from scorewright.llm.tokens import Encoder, _ragged, text_slices

#: Characters of the documents of one block (a longer document is a block of its own), and groups a task keeps.
BLOCK_CHARS, KEPT = 8_000_000, 200_000
BLOCKS_A_TASK = 1 << 24
#: Bytes are written by a byte-level vocabulary as characters: printable ones stand for themselves, others from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_OF = {(chr(b) if b in _PRINTABLE else chr(256 + sum(x not in _PRINTABLE for x in range(b)))): b for b in range(256)}
#: White space in the widest sense; texts are only cut after other characters.
WHITE = np.array([p for p in range(0x3001) if chr(p).isspace()], np.uint32)
_VALUE = np.random.default_rng(20240307).integers(1, 2**63, (2, 1 << 16), dtype=np.uint64) | np.uint64(1)
ENCODED = "block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, steps array<int>, code int, grp string, freq long"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class PieceEncoder(Encoder):
    """Ids of texts that begin with the space which sentencepiece adds.

    A text is cut at each space after a character that is no white space, and each distinct stretch is encoded once: no
    piece has a space after other characters, so none spans two stretches.  With such a piece texts are encoded whole.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model, self.specials = sentencepiece.SentencePieceProcessor(model_file=path), {}
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.lone_space = self.model.piece_to_id("▁")
        self._reset()

    def _starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        begins = np.zeros(len(points), bool)
        if self.cuts:
            begins[1:] = (points[1:] == 32) & ~np.isin(points[:-1], WHITE)
        begins[first] = True
        return np.flatnonzero(begins)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        ids = [x or [self.lone_space] for x in self.model.encode([w[1:] for w in words], num_threads=1)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        place = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, place, hashes)
        self.start = np.insert(self.start, place, len(self.flat) + np.cumsum(lengths) - lengths)
        self.length = np.insert(self.length, place, lengths)
        self.flat = np.concatenate([self.flat, flat])


class Aligner:
    """Groups of whole texts, many at a time; groups get numbers in the order in which a task meets them."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = Encoder(path_a, specials_as_text=True), PieceEncoder(path_b)
        bytes_a = [b""] * self.a.size
        for token, i in self.a.tokenizer.get_vocab(with_added_tokens=True).items():
            bytes_a[i] = bytes(_BYTE_OF[c] for c in token) if all(c in _BYTE_OF for c in token) else token.encode()
        self.bytes = [(np.frombuffer(b"".join(t), np.uint8), np.array([len(x) for x in t], np.int64)) for t in (bytes_a, self.b.bytes)]
        self.length_a, self.length_b = self.bytes[0][1], self.bytes[1][1]
        self.forget(0)

    def forget(self, most: int = KEPT) -> None:
        """To be called between blocks: numbers start anew if there are more than ``most``."""
        if most == 0 or len(self.names) > most:
            self.hashes, self.codes = np.empty(0, np.uint64), np.empty(0, np.int64)  # sorted hashes, and their numbers
            self.names: list[str] = []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, tokens a text, ids of B, tokens a text); texts whose bytes either side does not give back have none."""
        spaced = [" " + t if t else "" for t in texts]
        raw = [t.encode() for t in spaced]
        want, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw])
        out, good = [], np.ones(len(texts), bool)
        for encoder, (flat, lengths) in zip((self.a, self.b), self.bytes, strict=True):
            ids, n = encoder.encode(spaced)
            ids = ids.astype(np.int64)
            upto = np.concatenate(([0], np.cumsum(n)))
            got = flat[_ragged((np.cumsum(lengths) - lengths)[ids], lengths[ids])]
            if len(got) != len(want) or not np.array_equal(got, want) or not np.array_equal(np.concatenate(([0], np.cumsum(lengths[ids])))[upto[1:]], ends):
                place = np.concatenate(([0], np.cumsum(lengths[ids])))[upto]
                good &= np.array([got[p:q].tobytes() == r for p, q, r in zip(place[:-1], place[1:], raw, strict=True)], bool)
            out.append((ids, n))
        if not good.all():
            out = [(ids[np.repeat(good, n)], np.where(good, n, 0)) for ids, n in out]
        return *out[0], *out[1]

    def align(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
        """(tokens of A, of B, groups, text of groups) of each text, and the group numbers of all one after another."""
        ids_a, n_a, ids_b, n_b = self.encode(texts)
        # Bytes of all texts one after another: both sides have the same edges between texts.
        end_a, end_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        cut = np.zeros(int(end_a[-1]) + 1 if len(end_a) else 1, bool)
        cut[end_a] = True
        last_b = np.flatnonzero(cut[end_b])
        last_a = np.searchsorted(end_a, end_b[last_b])
        sides = []
        for ids, last, salt in ((ids_a, last_a, 0), (ids_b, last_b, 1)):
            first = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
            # A group's hash sums up its ids, each turned by its place in the group.
            place = np.arange(len(ids)) - np.repeat(first, last - first + 1)
            value = _mixed(_VALUE[salt][ids & 0xFFFF] + (ids >> 16).astype(np.uint64) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value)))
            sides.append((first, last + 1, run[last + 1] - run[first]))
        h = _mixed(sides[0][2] * np.uint64(0xD1342543DE82EF95) + sides[1][2])
        kinds, at, which = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, kinds)
        new = np.flatnonzero(self.hashes[np.minimum(place, len(self.hashes) - 1)] != kinds) if len(self.hashes) else np.arange(len(kinds))
        for g in at[new].tolist():
            self.names.append("|".join(",".join(map(str, ids[first[g] : end[g]].tolist())) for ids, (first, end, _) in zip((ids_a, ids_b), sides, strict=True)))
        codes = np.arange(len(self.names) - len(new), len(self.names))
        self.hashes, self.codes = np.insert(self.hashes, place[new], kinds[new]), np.insert(self.codes, place[new], codes)
        flat = self.codes[np.searchsorted(self.hashes, kinds)][which] if len(kinds) else np.empty(0, np.int64)
        upto = np.searchsorted(last_a, np.concatenate(([0], np.cumsum(n_a))) - 1, "right")
        named, listed = self.names.__getitem__, flat.tolist()
        written = [";".join(map(named, listed[p:q])) for p, q in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
        return n_a, n_b, np.diff(upto), written, flat


def _block_rows(block: int, keys: list, figures: list, codes: np.ndarray, names: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A row for each document of a block, and one for each distinct group: numbers go by falling frequency, and a document's
    numbers are sorted and written as steps, which are small."""
    n_a, n_b, n_groups, shas = (np.concatenate([f[k] for f in figures]) for k in range(4))
    kinds, which, freq = np.unique(codes, return_inverse=True, return_counts=True)
    order = np.argsort(-freq, kind="stable")
    rank = np.empty(len(kinds), np.int64)
    rank[order] = np.arange(len(kinds))
    owner = np.repeat(np.arange(len(keys)), n_groups)
    mine = np.sort(owner * (len(kinds) + 1) + rank[which]) - owner * (len(kinds) + 1)
    ends = np.cumsum(n_groups)
    steps = np.diff(mine, prepend=0)
    first = (ends - n_groups)[n_groups > 0]
    steps[first] = mine[first]
    docs = {"block": np.full(len(keys), block), "doc_id": pa.array(keys, pa.int64()), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "groups_sha256": pa.array(shas, pa.string()), "steps": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(steps, pa.int32()))}
    terms = {"block": np.full(len(kinds), block), "code": pa.array(np.arange(len(kinds)), pa.int32()), "grp": pa.array([names[k] for k in kinds[order].tolist()], pa.string()), "freq": freq[order]}
    for part in (docs, terms):
        n = len(part["block"])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(part[f.name], f.type) if f.name in part else pa.nulls(n, f.type) for f in schema], schema=schema)


def encode_groups(docs: DataFrame, path_a: str, path_b: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows of documents and of their blocks' distinct groups (see ENCODED), written to the shared folder."""
    short_batches(docs.sparkSession)
    fields = [("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("steps", pa.list_(pa.int32())), ("code", pa.int32()), ("grp", pa.string()), ("freq", pa.int64())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = Aligner(path_a, path_b)
        block, chars, keys, figures, codes = TaskContext.get().partitionId() * BLOCKS_A_TASK, 0, [], [], []
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in text_slices(texts):
                *figure, written, flat = aligner.align(texts[lo:hi])
                figures.append((*figure, np.array([hashlib.sha256(w.encode()).hexdigest() if w else "" for w in written], object)))
                codes.append(flat.astype(np.int32))
                keys += ids[lo:hi]
                chars += sum(map(len, texts[lo:hi]))
                if chars >= BLOCK_CHARS:
                    yield from _block_rows(block, keys, figures, np.concatenate(codes), aligner.names, schema)
                    block, chars, keys, figures, codes = block + 1, 0, [], [], []
                    aligner.forget()
        if keys:
            yield from _block_rows(block, keys, figures, np.concatenate(codes), aligner.names, schema)

    source = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return materialize(source.mapInArrow(tidy(run), ENCODED), "groups")


def group_links(name: str, length_a: np.ndarray, length_b: np.ndarray, relation: str = "ends") -> list[tuple[int, int]]:
    """Pairs of ids of one group: those whose byte ranges end together, or (``overlap``) share a byte."""
    a, b = ([int(x) for x in side.split(",")] for side in name.split("|"))
    out, i, j, end_a, end_b = [], 0, 0, int(length_a[a[0]]), int(length_b[b[0]])
    while True:
        if relation == "overlap" or end_a == end_b:
            out.append((a[i], b[j]))
        step_a, step_b = end_a <= end_b, end_b <= end_a
        i, j = i + step_a, j + step_b
        if i == len(a) or j == len(b):
            return out
        end_a, end_b = end_a + (int(length_a[a[i]]) if step_a else 0), end_b + (int(length_b[b[j]]) if step_b else 0)


def corpus_links(groups: DataFrame, path_a: str, path_b: str, relation: str = "ends") -> DataFrame:
    """(grp, a, b, n, freq): links of each distinct group of ``groups`` (grp, freq), expanded once, written."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner(path_a, path_b)
        for batch in batches:
            pairs = [group_links(g, aligner.length_a, aligner.length_b, relation) for g in batch["grp"]]
            n = [len(p) for p in pairs]
            flat = [p for x in pairs for p in x]
            yield pd.DataFrame({"grp": batch["grp"].repeat(n).to_numpy(), "a": [p[0] for p in flat], "b": [p[1] for p in flat], "freq": batch["freq"].repeat(n).to_numpy()})

    distinct = groups.groupBy("grp").agg(F.sum("freq").alias("freq"))
    found = distinct.mapInPandas(tidy(expand), "grp string, a int, b int, freq long")
    return materialize(found, "links")


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", key: str = "doc_id", relation: str = "ends") -> DataFrame:
    """Figures of each document (see RESULT), a row for each row of ``docs``.

    A null or empty text, or one whose tokens' bytes differ from space+text, has zeros and an empty ``groups_sha256``; it
    adds nothing to any count.  Null and repeated keys keep their rows, each with its own figures.  An empty table gives
    an empty result.  Other columns of ``docs`` are not read.
    """
    encoded = encode_groups(docs, path_a, path_b, text, key)
    terms = encoded.where("grp is not null").select("block", "code", "grp", "freq")
    links = corpus_links(terms, path_a, path_b, relation)
    pairs = links.groupBy("a", "b").agg(F.sum("freq").alias("count"))
    best = pairs.groupBy("b").agg(F.max("count").alias("most"))
    pairs = pairs.join(best, "b").select("a", "b", "count", (F.col("count") == F.col("most")).cast("long").alias("is_best"))
    scored = links.join(pairs, ["a", "b"]).groupBy("grp").agg(F.count("*").alias("links"), F.sum("is_best").alias("best"), F.sum("count").alias("sum"))
    back = terms.join(scored, "grp").select(F.col("block").alias("at"), "code", "links", "best", "sum")
    rows = encoded.where("grp is null").select("block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "steps")

    def finish(mine: pa.Table, terms: pa.Table) -> pa.Table:
        code = terms.column("code").to_numpy()
        values = []
        for name in ("links", "best", "sum"):
            value = np.zeros(len(code), np.int64)
            value[code] = terms.column(name).to_numpy()
            values.append(value)
        n = mine.column("n_groups").to_numpy()
        upto = np.concatenate(([0], np.cumsum(n)))
        steps = mine.column("steps").combine_chunks().flatten().to_numpy().astype(np.int64)
        run = np.concatenate(([0], np.cumsum(steps)))
        codes = run[1:] - np.repeat(run[upto[:-1]], n)
        sums = [np.diff(np.concatenate(([0], np.cumsum(v[codes])))[upto]) for v in values]
        column = dict(zip(("n_links", "n_best", "count_sum"), sums, strict=True))
        names = [f.split()[0] for f in RESULT.split(", ")]
        return pa.table({c: pa.array(column[c]) if c in column else mine.column(c) for c in names})

    return rows.groupBy("block").cogroup(back.groupBy("at")).applyInArrow(finish, RESULT)
