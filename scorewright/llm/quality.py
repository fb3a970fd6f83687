"""Quality rules: a hashed n-gram log-likelihood ratio of trusted text against the raw corpus, plus plain rules.

Word unigrams and bigrams are hashed into a fixed number of buckets.  Two multinomials are counted over the buckets:
one from a bounded sample of trusted documents, one from all documents.  A document's score is the mean log ratio of
its n-grams, and a fixed threshold decides.  Only DataFrame functions are used; the corpus moves through no shuffle,
just bucket counts (at most ``buckets`` rows a task) and one partial sum a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scorewright.llm._shared import materialize, text_or_empty

BUCKETS = 1 << 16
SMOOTHING = 20.0
THRESHOLD = -0.1
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
WINDOW = 5
_SPACES = " \t\n\x0b\x0c\r"


def words_array(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def with_repeated_words(df: DataFrame, keys: str, name: str) -> DataFrame:
    """Adds the number of words in windows whose key occurs twice or more; ``keys`` holds one key per window start.

    Each step is a column of its own, so that no array is computed anew inside a lambda.
    """
    none = F.array().cast("array<struct<k:bigint,i:int>>")
    placed = F.when(F.size(keys) > F.size(F.array_distinct(keys)), F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))).otherwise(none)
    out = df.withColumn("_placed", placed)
    near = lambda p, i: F.coalesce(F.get("_placed", i - 1)["k"] == p["k"], F.lit(False)) | F.coalesce(F.get("_placed", i + 1)["k"] == p["k"], F.lit(False))
    out = out.withColumn("_starts", F.sort_array(F.transform(F.filter("_placed", near), lambda p: p["i"])))
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")),
        lambda a, s: F.struct((s + WINDOW).alias("upto"), (a["n"] + s + WINDOW - F.greatest(a["upto"], s)).alias("n")),
    )["n"]
    return out.withColumn(name, covered.cast("long")).drop("_placed", "_starts")


def base_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus _words and the plain measures n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    body = text_or_empty(text)
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(_SPACES)) != "")
    out = docs.withColumn("_words", words_array(body))
    words = F.col("_words")
    window = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, WINDOW)]))
    out = out.withColumn("_keys", F.slice(window, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))))
    out = with_repeated_words(out, "_keys", "n_repeat_words").drop("_keys")
    return out.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    })


def hashed_ngrams(words: Column, buckets: int) -> Column:
    """Buckets of all word unigrams and bigrams, repeats kept."""
    single = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    pair = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.pmod(F.xxhash64(w, F.get(words, i + 1)), F.lit(buckets)).cast("int"))
    return F.concat(single, pair)


def bucket_weights(docs: DataFrame, trusted: DataFrame, text: str = "text", buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """(bucket, weight): log ratio of smoothed shares in trusted text and in all text.  One row a bucket seen, ``buckets`` at most."""

    def counts(df: DataFrame, name: str) -> DataFrame:
        words = df.select(words_array(text_or_empty(text)).alias("_words"))  # a column of its own: lambdas below read it
        return words.select(F.explode(hashed_ngrams(F.col("_words"), buckets)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))

    # Read twice below; a row a bucket at most.
    both = materialize(counts(docs, "raw").join(counts(trusted, "good"), "bucket", "left").na.fill(0, ["good"]), "buckets")
    totals = both.agg(F.sum("raw").alias("raw_all"), F.sum("good").alias("good_all")).first()
    raw_all, good_all = totals.raw_all or 0, totals.good_all or 0
    # The raw counts are scaled to the trusted total before smoothing, so that rare buckets tend to 0 on either side.
    raw = F.col("raw") * (good_all / raw_all if raw_all else 0.0)
    return both.select("bucket", (F.log(F.col("good") + smoothing) - F.log(raw + smoothing)).alias("weight"))


def judge_quality(docs: DataFrame, trusted: DataFrame, text: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """Score and judge every row of ``docs`` over its whole text.

    Returns the columns of ``docs`` without ``text`` (columns with the names of results are replaced) and n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr (mean log ratio; 0 without n-grams) and kept.
    A null text counts as empty, which fails the base rules.  Without trusted rows every llr is 0 and only the base
    rules decide.  Repeated rows are judged one by one; the verdict depends on nothing but text and model.
    """
    # As many rows as there are buckets: a fixed bound, so the broadcast below does not grow with the corpus.
    weights = bucket_weights(docs, trusted, text, buckets, smoothing)
    results = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    measured = base_measures(docs.drop(*[c for c in results if c in docs.columns]), text)
    keep = [c for c in docs.columns if c not in {text, "base_failed", "llr", "kept", *results}]
    rows = measured.select(F.monotonically_increasing_id().alias("_row"), *keep, *results, hashed_ngrams(F.col("_words"), buckets).alias("_grams"))
    flat = rows.select("_row", *keep, *results, F.explode_outer("_grams").alias("bucket"))
    scored = flat.join(F.broadcast(weights), "bucket", "left").groupBy("_row", *keep, *results).agg(F.avg(F.coalesce("weight", F.lit(0.0))).alias("llr"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)).drop("_row")


def trusted_sample(docs: DataFrame, labels: DataFrame, rows: int = 4000) -> DataFrame:
    """At most ``rows`` documents labelled good and not toxic, chosen by the hash of their id: the bounded trusted sample."""
    chosen = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.join(F.broadcast(chosen), "doc_id", "left_semi")  # at most ``rows`` ids
