"""Queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from scorewright.llm import alignment, filter_audit, jaccard_join, language_id, line_dedup, mixing, packing, pii, quality, secret_scan, token_file, topk, url_filter


def tokenizer_path(name: str = "byte_bpe_50k.json", variable: str = "TOKENIZER_FILE") -> str:
    """Where a public vocabulary lies; TOKENIZER_FILE (PIECE_FILE for the second one of op12) names another place."""
    if path := os.environ.get(variable):
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def pii_key() -> str:
    """Secret of the pseudonyms: PII_KEY of the environment; test runs have one of their own."""
    return os.environ.get("PII_KEY", "key of test runs")


#: Rules of op5: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_weights(names: list) -> list[int]:
    return [(3, 1, 2)[i % 3] for i in range(len(names))]


def learnable(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % 3 != 1


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents"), tokenizer_path()))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, F.array("source"), source_weights).select("doc_id", "size", "source_size", "target", "taken")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, learnable())
    judged = language_id.identify(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", (~learnable()).alias("held_out"), "lang_pred", "score")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.search(rows, F.col("vec_id") % 20 == 0, 20).select("query_id", "rank", "vec_id", "score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = quality.trusted_sample(docs, table(spark, sf_dir, "labels"))
    judged = quality.judge_quality(docs, trusted)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"), pii_key()).select("doc_id", "text", "n_pseudonyms")


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_file.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path())
    return token_file.read_documents(manifest)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model", "PIECE_FILE"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_best_fit_packing, op2_source_mix, op3_language_id, op4_exact_topk, op5_url_filter, op6_quality_rules, op7_pii_pseudonyms, op8_token_file, op9_jaccard_join, op10_secret_scan, op11_line_dedup, op12_cross_tokenizer, op13_filter_audit)
    return {f.__name__: f for f in named}


ORACLES = {
    "op4_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.w AS DOUBLE[]), CAST(c.w AS DOUBLE[])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op5_url_filter": r"""
        WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        r(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS verdict
              FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
        SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id""",
    "op11_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        c AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        m AS (SELECT k.*, c.key IS NOT NULL AND doc_id <> owner AS gone FROM k LEFT JOIN c ON k.key = c.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op13_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        b AS (SELECT part, CAST(len(w) < 50 AS INT) AS A, CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT) AS B,
                     CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS INT) AS C, CAST(regexp_matches(t, '[#$%&*|]') AS INT) AS D,
                     CAST(doc_id > min(doc_id) OVER (PARTITION BY t) AS INT) AS E, CAST(coalesce(quality = 1, false) AS INT) AS good, CAST(coalesce(toxic = 1, false) AS INT) AS toxic
              FROM d LEFT JOIN labels USING (doc_id)),
        f AS (SELECT part, A + 2 * B + 4 * C + 8 * D + 16 * E AS bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM b GROUP BY ALL),
        x AS (SELECT unnest([1, 2, 4, 8, 16]) AS bit, unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
        o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits5
              FROM x a, x b, x c, x d, x e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
        s AS (SELECT filter_order, CAST(i AS INT) AS step, bits5[i] AS bit, CAST(coalesce(list_sum(bits5[:i - 1]), 0) AS INT) AS before FROM o, unnest(range(1, 6)) r(i)),
        p AS (SELECT f.part, filter_order, step, bit,
                     sum(CASE WHEN bits & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
                     sum(CASE WHEN bits & before = 0 AND bits & bit <> 0 THEN n ELSE 0 END) AS removed,
                     sum(CASE WHEN bits & before <> 0 AND bits & bit <> 0 THEN n ELSE 0 END) AS redundant,
                     sum(CASE WHEN bits = bit THEN n ELSE 0 END) AS unique_fails,
                     sum(CASE WHEN bits & before = 0 AND bits & bit <> 0 THEN good ELSE 0 END) AS good_lost,
                     sum(CASE WHEN bits & before = 0 AND bits & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
              FROM f, s GROUP BY ALL)
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM p""",
}


def oracle_sql() -> dict[str, str]:
    """Only where SQL can express the whole result; the other queries are tested against brute force."""
    return dict(ORACLES)
