import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from scorewright.llm import packing, token_file
from scorewright.llm.queries import op1_best_fit_packing, op8_token_file, tokenizer_path
from scorewright.llm.tokens import Encoder

ODD = ["", " ", "a  b", "a\n b", "a \nb", "  x", " y", "it's the 's end ", "tab\there", "\n\n\n", "a   b\n\n  c", "<|endoftext|> hi", " <|endoftext|>", "é ü x", "a\x1cb \x1c c", "x \u2003 y", "don't 'll", "x'y z'", "東京 都", "word,''s the.'"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(plain, docs):
    encoder = Encoder(tokenizer_path())
    texts = [r.text for r in docs.collect()] + ODD
    random.Random(3).shuffle(texts)
    for part in (texts[:90], texts[90:], ODD):
        ids, n = encoder.encode(part)
        ends = np.cumsum(n)
        for text, lo, hi in zip(part, ends - n, ends, strict=True):
            assert ids[lo:hi].tolist() == plain(text), text[:80]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_packing(rows, texts, plain, capacity=2048):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for key, text in texts.items():
        ids = [*plain(text), 0]
        pieces = sorted(by_doc[key], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert len(pieces) == -(-len(ids) // capacity)
        assert all(p.length == capacity for p in pieces[1:])
        for p in pieces:
            assert p.ids_crc32 == crc(ids[p.start : p.start + p.length])
        assert sum(p.length for p in pieces) == len(ids)
    return len(sequences)


def brute_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_packing_query(spark, sf, docs, plain):
    rows = op1_best_fit_packing(spark, sf).collect()
    used = check_packing(rows, {r.doc_id: r.text for r in docs.collect()}, plain)
    assert used == brute_best_fit([r.length for r in rows], 2048)


def test_plan_equals_sequential_best_fit():
    rng = random.Random(5)
    for capacity in (10, 64, 200):
        for _ in range(60):
            lengths = [min(capacity, 1 + int(rng.expovariate(4 / capacity))) for _ in range(rng.randrange(1, 120))]
            histogram = defaultdict(int)
            for n in lengths:
                histogram[n] += 1
            plan = packing.best_fit_plan(histogram, capacity)
            bins = defaultdict(list)
            for length, _, n, first, offset in plan:
                for b in range(first, first + n):
                    bins[b].append((offset, length))
            assert sum(len(x) for x in bins.values()) == len(lengths)
            for spans in bins.values():
                at = 0
                for offset, length in sorted(spans):
                    assert offset == at
                    at += length
                assert at <= capacity
            assert len(bins) == brute_best_fit(lengths, capacity)


def test_packing_odd_rows(odd, none, plain):
    pieces = packing.token_pieces(odd, tokenizer_path())
    rows = packing.pack(pieces.withColumn("sequence_id", pieces["length"])).collect()
    counts = defaultdict(int)
    for r in rows:
        counts[r.doc_id] += 1
    assert counts[2] == counts[3] == 1 and counts[6] == 2 and counts[None] == 1 and counts[5] > 2
    assert {r.length for r in rows if r.doc_id in (2, 3)} == {1}
    assert packing.pack(packing.token_pieces(none, tokenizer_path())).count() == 0


def test_packing_lengths_that_fit_nowhere(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, 5000), (4, 7), (4, 7)], "doc_id long, length long")
    got = {(r.doc_id, r.sequence_id is None) for r in packing.pack(df).collect()}
    assert got == {(1, True), (2, True), (3, True), (4, False)}


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 11, 16, 17, 31, 32])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1003, dtype=np.uint64)
    data = token_file.pack_ids(ids, bits)
    assert len(data) == -(-1003 * bits // 8)
    assert (token_file.unpack_ids(data, 1003, bits) == ids).all()


def check_file(rows, expected, plain):
    start = 0
    for r, (key, text) in zip(sorted(rows, key=lambda r: r.start), expected, strict=True):
        ids = [*plain(text), 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (key, start, len(ids), crc(ids))
        start += len(ids)


def test_token_file_query(spark, sf, docs, plain):
    expected = sorted((r.doc_id, r.text) for r in docs.collect())
    check_file(op8_token_file(spark, sf).collect(), expected, plain)


def test_token_file_odd_rows_and_random_access(spark, odd, none, plain):
    manifest = token_file.write_tokens(odd, tokenizer_path())
    rows = token_file.read_documents(manifest).collect()
    assert len(rows) == odd.count() and {r.doc_id for r in rows} >= {None, 6}
    first = manifest.orderBy("shard").first()
    whole = token_file.read_ids(spark, first.file, 0, first.n_ids)
    assert (token_file.read_ids(spark, first.file, 3, 5) == whole[3:8]).all()
    assert token_file.read_documents(token_file.write_tokens(none, tokenizer_path())).count() == 0
