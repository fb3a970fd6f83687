"""Line deduplication over levelled sorted runs of line hashes.

Documents come in batches, those with the largest ids first.  The index is a set of runs: tables of line hashes, bucketed
and sorted by hash, with the number of documents that hold a line and the document that keeps it.  Each new batch is
merge-anti-joined against the runs (its new lines get an owner, for lines already there only documents are counted) and
adds a run of its own; when a level has ``fanout`` runs they are merged into one of the next level, so that a hash is
rewritten a logarithmic number of times.  Texts are read twice and moved once; everything else is hashes and positions.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scorewright.llm._shared import forget, materialize, scratch_path, text_or_empty

#: Stripped at both ends of a line.
BLANK = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["h", "g"]
#: Accuracy of the ranges by which ids are dealt into batches; it shapes their sizes only.
ACCURACY = 1000


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


class LineRuns:
    """Levelled sorted runs of (h, g, n, owner): 128 bits of hash, documents, and the document that keeps the line."""

    def __init__(self, spark: SparkSession, fanout: int = 4, buckets: int | None = None) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _run(self, entries: DataFrame) -> str:
        """A written run: one sorted file a bucket, so that joins by hash read it where it lies."""
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = entries.select(*HASH, "n", "owner").repartition(self.buckets, "h")
        dealt.write.bucketBy(self.buckets, "h").sortBy(*HASH).option("path", scratch_path(self.spark, "run")).saveAsTable(name)
        return name

    def _gone(self, names: list[str]) -> None:
        for name in names:
            forget(self.spark, self.spark.table(name))
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def fresh(self, entries: DataFrame) -> DataFrame:
        """Rows of ``entries`` (h, g, ..) whose line no run holds."""
        return reduce(lambda left, run: left.join(run.select(*HASH), HASH, "left_anti"), self.runs(), entries)

    def add(self, entries: DataFrame) -> None:
        """Add a batch: ``entries`` (h, g, n, owner) has a row for each distinct line of it."""
        new = self.fresh(entries)
        if self.runs():
            seen = entries.join(new.select(*HASH), HASH, "left_anti")
            new = new.unionByName(seen.withColumn("owner", F.lit(None).cast(entries.schema["owner"].dataType)))
        name, level = self._run(new), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(name)
            if len(self.levels[level]) < self.fanout:
                return
            old, self.levels[level] = self.levels[level], []
            name, level = self._run(self._merged(old)), level + 1
            self._gone(old)

    def _merged(self, names: list[str]) -> DataFrame:
        """Merge joins of runs; two of them need no shuffle."""

        def merge(left: DataFrame, right: DataFrame) -> DataFrame:
            both = left.join(right.select(*HASH, F.col("n").alias("n2"), F.col("owner").alias("owner2")), HASH, "full")
            return both.select(*HASH, (F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"), F.greatest("owner", "owner2").alias("owner"))

        return reduce(merge, [self.spark.table(n).select(*HASH, "n", "owner") for n in names])

    def merged(self) -> DataFrame:
        """All lines, one row each."""
        return self._merged([n for level in self.levels for n in level])

    def drop(self) -> None:
        self._gone([n for level in self.levels for n in level])
        self.levels = []


def _lines(docs: DataFrame, text: str, key: str, least: int, bounds: list) -> DataFrame:
    """(batch, h, g, key, t, pos) of each line of at least ``least`` characters; ``t`` tells texts of one key apart."""
    batch = reduce(lambda a, b: a + b, [F.coalesce((F.col("_key") <= F.lit(b)).cast("int"), F.lit(1)) for b in bounds], F.lit(0))
    rows = docs.select(F.col(key).alias("_key"), text_or_empty(text).alias("_text"))
    rows = rows.select("_key", F.xxhash64("_text").alias("t"), F.posexplode(F.split("_text", "\n")).alias("pos", "line"))
    rows = rows.select("_key", "t", "pos", line_key(F.col("line")).alias("line")).where(F.char_length("line") >= least)
    return rows.select(batch.alias("batch"), F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), "_key", "t", "pos")


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", least_chars: int = 20, least_docs: int = 3, batches: int = 4, fanout: int = 2) -> DataFrame:
    """Lines of at least ``least_chars`` characters that at least ``least_docs`` documents hold go, but for those of the
    document with the largest ``key``; the rest stays, joined again.

    Returns the columns of ``docs`` with ``text`` replaced, and n_lines (before) and n_dropped (long); columns of these
    names are replaced.  A null or empty text is one empty line, and comes back empty.  Rows that share a key are one
    document: a line counts once, and all of them keep what the document keeps.  Null keys are one document, below all
    others.  Lines are told apart by 128 bits of hash.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    steps = [1 - (i + 1) / batches for i in range(batches - 1)]
    bounds = docs.agg(F.percentile_approx(key, steps, ACCURACY).alias("b")).first().b or [] if steps else []
    path = scratch_path(spark, "lines")
    found = _lines(docs, text, key, least_chars, bounds)
    found.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(found.select("h", "g", "_key", "t", "pos", "batch").schema).parquet(path)
    runs = LineRuns(spark, fanout)
    for i in range(len(bounds) + 1):
        held = lines.where(F.col("batch") == i).select(*HASH, "_key").distinct()
        runs.add(held.groupBy(*HASH).agg(F.count("*").alias("n"), F.max("_key").alias("owner")))
    # Written, so that both sides of each join are dealt out for it alone and Spark can split a line or document with many rows.
    common = materialize(runs.merged().where(F.col("n") >= least_docs).select(*HASH, "owner"), "common")
    runs.drop()
    gone = lines.join(common, HASH).where(~F.col("_key").eqNullSafe(F.col("owner")))
    gone = materialize(gone.groupBy(F.col("_key").alias("_doc"), F.col("t").alias("_mark")).agg(F.array_sort(F.collect_set("pos")).alias("_gone")), "dropped")
    forget(spark, common)
    names = [c for c in docs.columns if c not in {"n_lines", "n_dropped"}]
    rows = docs.select(*names, F.col(key).alias("_key"), text_or_empty(text).alias("_text")).withColumn("_t", F.xxhash64("_text"))
    met = rows.join(gone, F.col("_key").eqNullSafe(F.col("_doc")) & (F.col("_t") == F.col("_mark")), "left")
    met = met.withColumns({"_lines": F.split("_text", "\n"), "_gone": F.coalesce("_gone", F.array().cast("array<int>"))})
    count = F.size("_lines")

    def stretch(i: Column) -> Column:
        """Lines between two dropped ones."""
        start = F.coalesce(F.get("_gone", i - 1) + 1, F.lit(0))
        return F.slice("_lines", start + 1, F.coalesce(F.get("_gone", i), count) - start)

    left = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("_gone")), stretch)), "\n")
    kept = F.when(F.size("_gone") == 0, F.col("_text")).otherwise(left)
    return met.select(*[kept.alias(c) if c == text else F.col(c) for c in names], count.cast("long").alias("n_lines"), F.size("_gone").cast("long").alias("n_dropped"))
