"""Canonical views over the test tables: records with predictions and labels, runs, judges, boxes, spans, choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt evenly over tasks by a hash of the key, for queries that take long for a row: files can have few row groups."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def short_batches(spark: SparkSession, most: int = 1000) -> None:
    """At most so many rows go to a Python worker at once, as whole texts can be long; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= most:
        spark.conf.set(name, most)


def _beside_items(spark: SparkSession, sf_dir: str, even: bool = False) -> DataFrame:
    """Whole documents, each with a benchmark item; ``even`` spreads them over tasks."""
    items = table(spark, sf_dir, "benchmark")
    n = items.count()
    docs = table(spark, sf_dir, "documents")
    docs = spread(docs.select("doc_id", "lang", "source", "text"), "doc_id") if even else docs
    return docs.join(items.withColumnRenamed("text", "item"), F.pmod(docs["doc_id"], F.lit(n)) == items["item_id"])


def records(spark: SparkSession, sf_dir: str, even: bool = False) -> DataFrame:
    """(doc_id, category, sub, prediction, labels): every whole document as an answer.

    Its labels are a benchmark item and the answer without some short words.
    """
    labels = F.array("item", F.regexp_replace("text", " (de|die|the|el) ", " "))
    return _beside_items(spark, sf_dir, even).select("doc_id", F.col("lang").alias("category"), F.col("source").alias("sub"), F.col("text").alias("prediction"), labels.alias("labels"))


def whole_records(spark: SparkSession, sf_dir: str, even: bool = False) -> DataFrame:
    """The same columns with the answer without its first characters as second label, for queries without an SQL equivalent."""
    labels = F.array("item", F.substr("text", (1 + F.col("doc_id") % 3).cast("int")))
    return _beside_items(spark, sf_dir, even).select("doc_id", F.col("lang").alias("category"), F.col("source").alias("sub"), F.col("text").alias("prediction"), labels.alias("labels"))


REC = r"""rec AS (SELECT d.doc_id, d.lang AS category, d.source AS sub, d.text AS prediction, [b.text, regexp_replace(d.text, ' (de|die|the|el) ', ' ', 'g')] AS labels
    FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", F.concat(F.lit("m"), F.col("user_id") % 10).alias("model"), F.concat(F.lit("e"), F.col("event_id") % 4).alias("inference"), F.concat(F.lit("step"), F.col("user_id") % 3).alias("checkpoint"), F.lit("local").alias("source"), F.col("event_type").alias("benchmark"), F.when(F.col("event_id") % 5 == 0, "latency").otherwise("score").alias("metric"), (F.col("event_id") % 3).cast("int").alias("run_index"), F.floor(F.col("event_id") / 3).alias("sample"), "value")


RUNS = """runs AS (SELECT event_id, ts, 'm' || CAST(user_id % 10 AS VARCHAR) AS model, 'e' || CAST(event_id % 4 AS VARCHAR) AS inference, 'step' || CAST(user_id % 3 AS VARCHAR) AS checkpoint, 'local' AS source,
    event_type AS benchmark, CASE WHEN event_id % 5 = 0 THEN 'latency' ELSE 'score' END AS metric, CAST(event_id % 3 AS INTEGER) AS run_index, event_id // 3 AS sample, value FROM events)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return labels.join(docs.select("doc_id", "lang", "source", "n_chars"), "doc_id")


JUDGED = "judged AS (SELECT l.doc_id, l.quality, l.toxic, d.lang, d.source, d.n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, gold, answer): answers that name a letter in several ways."""
    letter = F.substr(F.lit("ABCD"), (F.col("p_size") % 4 + 1).cast("int"), F.lit(1))
    text = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("The answer is "), letter)).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("I pick ("), letter, F.lit(")"))).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("yes, truly\n"), letter, F.lit(".\n"))).otherwise(F.lit("no idea"))
    return table(spark, sf_dir, "part").select("p_partkey", letter.alias("gold"), text.alias("answer"))


CHOICES = r"""choices AS (SELECT p_partkey, substr('ABCD', p_size % 4 + 1, 1) AS gold, CASE p_partkey % 4 WHEN 0 THEN 'The answer is ' || substr('ABCD', p_size % 4 + 1, 1)
    WHEN 1 THEN 'I pick (' || substr('ABCD', p_size % 4 + 1, 1) || ')' WHEN 2 THEN 'yes, truly' || chr(10) || substr('ABCD', p_size % 4 + 1, 1) || '.' || chr(10) ELSE 'no idea' END AS answer FROM part)"""
