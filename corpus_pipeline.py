"""The training-text pipeline over ``documents``: language, near duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and reread as the next stage's docs.
Every stage works on all rows that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scorewright.llm import jaccard_join, language_id, mixing, packing, pii
from scorewright.llm._shared import materialize
from scorewright.llm.queries import learnable, pii_key, source_weights, tokenizer_path


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is found; those without text or any letter go.  ``lang`` becomes the prediction."""
    judged = language_id.identify(docs, language_id.fit(docs, learnable()))
    return judged.where(F.col("lang_pred") != language_id.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def _numbered(docs: DataFrame, tag: str) -> DataFrame:
    """``docs`` with a number of each row, ``_at``; it is written, so that every later read has the same numbers."""
    return materialize(docs.withColumn("_at", F.monotonically_increasing_id()), tag)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id stays (one without id only where none has an id).

    Rows are told apart by their number: different texts that share an id, or have none, all stay.
    """
    rows = _numbered(docs, "rows")
    group = jaccard_join.jaccard_components(rows, key="_at").join(rows.select("_at", "doc_id"), "_at")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_at"))
    kept = group.groupBy("component_id").agg(first.alias("first")).select("first._at")
    return rows.join(kept, "_at", "left_semi").select(*docs.columns)


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = pii.pseudonymize(docs, pii_key())
    return done.withColumn("n_chars", F.when(F.col("n_pseudonyms") > 0, F.char_length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the mix takes them whole; one of which it takes a part is cut after those words."""
    at = _numbered(docs, "rows")
    taken = mixing.mix(at.select("doc_id", "_at", "source", "text"), F.array("source"), source_weights).where("taken > 0").select("_at", "size", "taken")
    rows = at.join(taken, "_at")
    whole, part = F.floor(F.col("taken") / F.col("size")).cast("int"), (F.col("taken") % F.col("size")).cast("int")
    shares = F.concat(F.array_repeat(F.lit(None).cast("int"), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    rows = rows.select(*docs.columns, F.explode(shares).alias("_part"))
    # Only the few documents that are taken in part are cut, at the end of their last word taken.  Words are matched one by
    # one: Java repeats a group by recursion, which long texts overflow.
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("_part")), "")
    return rows.withColumn("text", F.when(F.col("_part").isNull(), F.col("text")).otherwise(cut)).withColumn("n_chars", F.when(F.col("_part").isNull(), F.col("n_chars")).otherwise(F.char_length("text"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(docs, tokenizer_path()))


STAGES = [
    ("language_id", detect_language),
    ("jaccard_join", drop_near_copies),
    ("pii_pseudonyms", pseudonymize),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Suffix automata, graph components, a keyed hash order and best-fit packing have no SQL form; the stages are tested
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
