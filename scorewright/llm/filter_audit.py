"""Interaction of filters: what each filter removes in every order of them, by CUBE over the failure flags.

Documents are first counted by (flags, part); the CUBE over the five flags and the part then runs on these few rows.  Its
grouping sets whose selected flags are all false give the survivors of each subset of filters, and a step of an order is
the pair of subsets before and after it.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from scorewright.llm._shared import materialize, text_or_empty, words_of

FILTERS = "ABCDE"
COUNTS = ("docs", "good", "toxic")


def content_flags(text: Column, words: Column) -> dict[str, Column]:
    """Filters A-D of one text: few words, few distinct words, many capitals, symbols."""
    n = F.size(words)
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * n,
        "C": 100 * F.char_length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """(part, A, .., E, good, toxic) of each row of ``docs``.

    E: the text is that of a smaller key anywhere in the table.  Null texts are empty, null parts the empty string.  A
    null key is neither smaller nor larger than any; rows that share a key are not copies of one another.  A document is
    good or toxic if any of its labels says so.  Texts are told apart by 128 bits of hash.
    """
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_or_empty(text).alias("_text"))
    rows = rows.withColumn("_words", words_of(F.col("_text")))
    flags = content_flags(F.col("_text"), F.col("_words"))
    rows = rows.select("_key", "part", F.xxhash64("_text").alias("h"), F.xxhash64(F.lit(1), "_text").alias("g"), *[c.alias(n) for n, c in flags.items()])
    # Narrow tables are written: texts are read once, and Spark can split a large group of copies, as both sides of the
    # join are dealt out for it alone.
    rows = materialize(rows, "flags")
    first = rows.groupBy("h", "g").agg(F.min("_key").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = materialize(first, "copies")
    marks = labels.groupBy(F.col(key).alias("_key")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = materialize(marks, "marks")
    rows = rows.join(first, ["h", "g"], "left").join(marks, "_key", "left")
    return rows.select("part", *"ABCD", F.coalesce(F.col("_key") > F.col("first"), F.lit(False)).alias("E"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def survivors(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, mask, docs, good, toxic): what no filter of a subset removes; a subset without survivors has no row.

    Bit i of ``mask`` stands for the i-th filter.
    """
    names = list(filters)
    counted = rows.groupBy("part", *names).agg(F.count("*").alias("docs"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    sets = counted.cube("part", *names).agg(*[F.sum(c).alias(c) for c in COUNTS], F.grouping("part").alias("_all"), *[F.grouping(n).alias(f"_{n}") for n in names])
    clean = sets.where("_all = 0")
    for n in names:  # a flag is either rolled up or false
        clean = clean.where((F.col(f"_{n}") == 1) | ~F.col(n))
    mask = sum((1 - F.col(f"_{n}").cast("int")) * (1 << i) for i, n in enumerate(names))
    return clean.select("part", mask.alias("mask"), *COUNTS)


def audit(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step; see the names of the columns in :func:`filter_audit`."""
    spark, names = rows.sparkSession, list(filters)
    full = (1 << len(names)) - 1
    steps, before = [], None
    for order in permutations(names):
        mask = 0
        for i, letter in enumerate(order):
            bit = 1 << names.index(letter)
            steps.append(("".join(order), i + 1, letter, bit, mask, mask | bit))
            mask |= bit
    steps = spark.createDataFrame(steps, "filter_order string, step int, letter string, bit int, before int, after int")
    held = materialize(survivors(rows, filters), "survivors")
    parts = held.where("mask = 0").select("part")
    every = parts.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(full))))
    held = every.join(held, ["part", "mask"], "left").fillna(0, list(COUNTS))
    held = materialize(held, "survivors")  # a row for each part and subset, read by each pair below
    side = lambda tag, *cs: held.select("part", F.col("mask").alias(tag), *[F.col(c).alias(f"{tag}_{c}") for c in cs])
    pairs = steps.join(side("before", *COUNTS), "before").join(side("after", *COUNTS), ["part", "after"])
    removed = F.col("before_docs") - F.col("after_docs")
    pairs = pairs.withColumn("removed", removed)
    # What fails a filter at all, and what fails it alone, are pairs of subsets too: of none and it, of all others and all.
    alone = steps.select("letter", "bit").distinct().join(side("bit", "docs"), "bit")
    alone = alone.join(held.where("mask = 0").select("part", F.col("docs").alias("all_docs")), "part")
    alone = alone.withColumn("others", F.lit(full) - F.col("bit")).join(side("others", "docs"), ["part", "others"])
    alone = alone.join(held.where(F.col("mask") == full).select("part", F.col("docs").alias("last_docs")), "part")
    alone = alone.select("part", "letter", (F.col("all_docs") - F.col("bit_docs")).alias("fails"), (F.col("others_docs") - F.col("last_docs")).alias("unique_fails"))
    shares = pairs.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    out = pairs.join(alone, ["part", "letter"]).join(shares, ["part", "letter"])
    return out.select(
        "part", "filter_order", "step", F.col("after_docs").alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails",
        (F.col("before_good") - F.col("after_good")).alias("good_lost"), (F.col("before_toxic") - F.col("after_toxic")).alias("toxic_lost"), "shapley",
    )


def filter_audit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """Filters A-E applied in all 120 orders: a row for each part, order and step (of its filter), zeros included.

    kept and removed by this step, redundant (fail this filter but went earlier), unique_fails (fail it alone), good_lost
    and toxic_lost (labelled ones removed here), shapley (removed by this filter, summed over all orders).  An empty
    table has no parts and gives no rows; see :func:`flagged` for nulls, ties and repeated rows.
    """
    return audit(flagged(docs, labels, text, key, part))
