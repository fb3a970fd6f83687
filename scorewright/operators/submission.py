"""Submission formats: projections of records to the columns that evaluation servers take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def answer(prediction: str = "prediction", processed: str | None = None) -> Column:
    parts = ([F.nullif(F.col(processed), F.lit(""))] if processed else []) + [F.col(prediction), F.lit("")]
    return F.coalesce(*parts)


def rrc(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("int").alias("questionId"), answer().alias("answer"))


def eval_server(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("question_id"), answer().alias("answer"))


def vizwiz(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.concat(F.lit("VizWiz_test_"), F.lpad(F.col(key).cast("string"), 8, "0"), F.lit(".jpg")).alias("image"), F.lower(answer()).alias("answer"))


def chart(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("questionId"), answer().alias("prediction"), F.get("labels", F.lit(0)).alias("gt"))


#: What the audio server takes of a record's meta.
AUDIO_META = ["question", "answer", "choices", "task", "difficulty"]


def audio_server(df: DataFrame, key: str, meta: str = "meta") -> DataFrame:
    """The answer beside parts of the map ``meta``, empty where it holds none."""
    about = {k: F.coalesce(F.try_element_at(F.col(meta), F.lit(k)), F.lit("")).alias(k) for k in AUDIO_META}
    return df.select(F.col(key).cast("string").alias("id"), about["question"], answer().alias("model_prediction"), *[about[k] for k in AUDIO_META[1:]])


def fill_template(template: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Every row of the template with its prediction, empty where there is none."""
    return template.join(predictions.select(key, "prediction"), key, "left").withColumn("prediction", F.coalesce("prediction", F.lit("")))


#: Parts of names that have no server, as there is none or the split is no test, and those of each format.
NOT_SENT = ["chartqa", "validation", "_dev", "dev_", "_train", "train_"]
FORMATS = [(["docvqa", "infovqa"], "rrc"), (["stvqa", "textvqa", "vqav2"], "eval_server"), (["mmau_test"], "audio_server"), (["vizwiz"], "vizwiz"), (["mmbench"], "template")]


def format_of(benchmark: str) -> str | None:
    """The format that a benchmark's server takes; None where nothing is sent."""
    name = benchmark.lower()
    if any(part in name for part in NOT_SENT):
        return None
    return next((form for parts, form in FORMATS if any(part in name for part in parts)), None)


def submission(benchmark: str, df: DataFrame, key: str, template: DataFrame | None = None) -> DataFrame | None:
    """The records of a benchmark in its server's format, or None where nothing is sent.  One format fills ``template``."""
    form = format_of(benchmark)
    if form == "template":
        if template is None:
            raise ValueError(f"{benchmark}: its submission fills a template")
        return fill_template(template, df, key)
    forms = {"rrc": rrc, "eval_server": eval_server, "audio_server": audio_server, "vizwiz": vizwiz}
    return forms[form](df, key) if form else None
