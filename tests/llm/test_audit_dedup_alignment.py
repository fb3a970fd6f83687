"""Line deduplication, cross-tokenizer alignment and filter audit against plain Python, with odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import accumulate, permutations

import pytest
from pyspark.sql import functions as F

from scorewright.llm import alignment, filter_audit, line_dedup
from scorewright.llm.queries import op11_line_dedup, op12_cross_tokenizer, op13_filter_audit, oracle_sql, tokenizer_path

BLANK = " \t\n\x0b\f\r"


def sql_rows(sf, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got = con.execute(oracle_sql()[name])
    return [dict(zip([c[0] for c in got.description], r, strict=True)) for r in got.fetchall()]


def as_sorted(rows):
    return sorted((sorted(r.items()) for r in rows), key=repr)


@pytest.mark.parametrize("query", [op11_line_dedup, op13_filter_audit])
def test_query_equals_sql(spark, sf, query):
    assert as_sorted(r.asDict() for r in query(spark, sf).collect()) == as_sorted(sql_rows(sf, query.__name__))


# --- lines


def brute_lines(rows, least_chars, least_docs):
    key = lambda line: line.strip(BLANK).translate({65 + i: 97 + i for i in range(26)})
    held, rank = defaultdict(set), lambda k: (k is not None, k or 0)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                held[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if len(key(x)) < least_chars or len(held[key(x)]) < least_docs or doc == max(held[key(x)], key=rank)]
        out.append((doc, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (5, 3)])
def test_lines_random(spark, batches, fanout):
    rng = random.Random(batches)
    pool = [f"{c} line of the pool É\U0001f600" for c in "aAbBcCdDeE"] + ["", " ", "short", "\tA line of the POOL \r", "x" * 5000]
    rows = [(rng.choice([*range(60), None]), "\n".join(rng.choice(pool) for _ in range(rng.randrange(12)))) for _ in range(150)]
    rows += [(7, None), (None, None), (3, rows[0][1])] * 2 + [(90, "\n".join(pool * 400))]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, n_lines int, h string, t int")
    got = line_dedup.dedup_lines(df, least_chars=10, batches=batches, fanout=fanout)
    assert got.columns == ["doc_id", "text", "h", "t", "n_lines", "n_dropped"]
    assert sorted((tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr) == brute_lines(rows, 10, 3)


def test_lines_odd_and_empty(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = line_dedup.dedup_lines(odd)
    assert sorted((tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr) == brute_lines(rows, 20, 3)
    assert line_dedup.dedup_lines(none).count() == 0


def test_runs_compact_and_find(spark):
    runs = line_dedup.LineRuns(spark, fanout=2, buckets=3)
    batch = lambda lo, hi, owner: spark.range(lo, hi).select(F.col("id").alias("h"), (-F.col("id")).alias("g"), F.lit(2).cast("long").alias("n"), F.lit(owner).cast("long").alias("owner"))
    for i, (lo, hi) in enumerate([(0, 10), (5, 15), (30, 40), (0, 3), (14, 16)]):
        expected = {k for k in range(lo, hi) if not any(a <= k < b for a, b in [(0, 10), (5, 15), (30, 40), (0, 3)][:i])}
        assert {r.h for r in runs.fresh(batch(lo, hi, i)).collect()} == expected
        runs.add(batch(lo, hi, 9 - i))
    assert [len(level) for level in runs.levels] == [1, 0, 1]  # five batches of fanout two
    got = {r.h: (r.n, r.owner) for r in runs.merged().collect()}
    assert got[0] == (4, 9) and got[7] == (4, 9) and got[14] == (4, 8) and got[15] == (2, 5) and len(got) == 26
    runs.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


# --- alignment


def byte_of():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute_alignment(texts, relation="ends"):
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib, b_lib = Tokenizer.from_file(tokenizer_path()), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    a_lib.encode_special_tokens = True
    table, docs = byte_of(), []
    for text in texts:
        a = b = []
        if text:
            a_ids, b_ids = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
            a_raw = [bytes(table[c] for c in a_lib.id_to_token(i)) for i in a_ids]
            b_raw = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
            if b"".join(a_raw) == (" " + text).encode() == b"".join(b_raw):
                a, b = list(zip(a_ids, accumulate(map(len, a_raw)))), list(zip(b_ids, accumulate(map(len, b_raw))))
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        groups, i, j, links = [], 0, 0, []
        for c in cuts:
            p, q = i, j
            while i < len(a) and a[i][1] <= c:
                i += 1
            while j < len(b) and b[j][1] <= c:
                j += 1
            groups.append(",".join(str(x) for x, _ in a[p:i]) + "|" + ",".join(str(x) for x, _ in b[q:j]))
            starts = lambda side, k: side[k - 1][1] if k else 0
            links += [(a[x][0], b[y][0]) for x in range(p, i) for y in range(q, j) if (a[x][1] == b[y][1] if relation == "ends" else starts(a, x) < b[y][1] and starts(b, y) < a[x][1])]
        docs.append((len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    count = Counter(x for d in docs for x in d[3])
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(a, b, g, len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), sha) for a, b, g, x, sha in docs]


ODD_TEXTS = [
    None, "", " ", "  ", "a ", "a  ", " a", "\n", "\n a\n  b \t c", "a▁b", "<|endoftext|> and <s> </s>", "x  y 　z", "\x00 \x1c a\x1f b", "don't we'll it's", "東京都 特許",
    "\U0001f600\U0001f601 é́", "1234567890 3.14 1,000", "    code  =  1;   ", "\r\n\r\n x", "﻿‍    \u0085 ", "word " * 3000, "é" * 20_000, "a" * 50_000, "가나 다 \U00010348", "tab\t tab \x0b x",
]


@pytest.mark.parametrize("relation", ["ends", "overlap"])
def test_alignment_odd_texts(spark, monkeypatch, relation):
    rng = random.Random(3)
    texts = ODD_TEXTS + ["".join(rng.choice(" \n\t ab'sIV9.é東▁<　") for _ in range(rng.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame([(i if i % 7 else None, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, block int, grp string").withColumn("place", F.monotonically_increasing_id())
    got = [tuple(r)[1:] for r in alignment.align(df, tokenizer_path(), tokenizer_path("piece_bpe_32k.model"), relation=relation).collect()]
    assert sorted(got) == sorted(brute_alignment(texts, relation))


def test_alignment_query_and_empty(spark, sf, docs, none):
    rows = docs.orderBy("doc_id").collect()
    got = sorted(tuple(r) for r in op12_cross_tokenizer(spark, sf).collect())
    assert got == [(r.doc_id, *x) for r, x in zip(rows, brute_alignment([r.text for r in rows]), strict=True)]
    assert alignment.align(none, tokenizer_path(), tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_aligner_starts_anew_between_blocks(docs):
    texts = [r.text for r in docs.limit(40).collect()]
    one = alignment.Aligner(tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    whole = one.align(texts)[3]
    parts = []
    for text in texts:
        *_, n, written, codes = one.align([text])
        assert [len(codes)] == list(n) and ";".join(one.names[c] for c in codes) == written[0]
        parts += written
        one.forget(100)
        assert len(one.names) <= 100 and len(one.names) == len(one.hashes) == len(one.codes)
    assert parts == whole
    assert one.align([])[3] == [] and one.align([""])[3] == [""]


# --- filters


def brute_audit(rows, labels):
    first, good, toxic = {}, {k for k, q, _ in labels if q == 1}, {k for k, _, t in labels if t == 1}
    for key, text, _ in rows:
        if key is not None:
            first[text or ""] = min(first.get(text or "", key), key)
    flags = []
    for key, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), key is not None and first[text] < key)
        flags.append((source or "", dict(zip("ABCDE", fails, strict=True)), key in good, key in toxic))
    out, shapley = [], Counter()
    for part in {f[0] for f in flags}:
        mine = [f for f in flags if f[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone, stay = [f for f in left if f[1][x]], [f for f in left if not f[1][x]]
                fails = sum(f[1][x] for f in mine)
                shapley[part, x] += len(gone)
                out.append([part, "".join(order), step, len(stay), len(gone), fails - len(gone), sum(f[1][x] and sum(f[1].values()) == 1 for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)])
                left = stay
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    rng = random.Random(5)
    words = [f"w{i}" for i in range(80)] + ["ABC", "#x", "D|e"]
    rows += [(rng.choice([*range(100, 180), None]), " ".join(rng.choices(words[: rng.choice([20, 83])], k=rng.choice([10, 49, 50, 70]))), rng.choice(["a", "b", None, ""])) for _ in range(120)]
    rows += [(i, rows[20][1], "hot") for i in range(200, 230)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(90, 190)] + [(101, 1, 1), (101, 0, None), (None, 1, 1)]
    df = spark.createDataFrame([(*r, 1, "x", True) for r in rows], "doc_id long, text string, source string, good int, part string, A boolean")
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string")
    got = filter_audit.filter_audit(df, marks)
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, [x for x in labels if x[0] is not None])
    assert filter_audit.filter_audit(none, marks).count() == 0
    assert filter_audit.filter_audit(df, marks.where("false")).agg(F.sum("good_lost")).first()[0] == 0
