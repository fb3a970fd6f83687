"""Sources and sinks: one entry for the file formats of result files and datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scorewright.functions.records import run_figures

#: Reader by suffix; a trailing .gz or .gzip is left to Spark's codecs.
FORMATS = {"jsonl": ("json", {}), "json": ("json", {"multiLine": "true"}), "csv": ("csv", {"header": "true", "multiLine": "true"}), "tsv": ("csv", {"header": "true", "sep": "\t", "multiLine": "true"}), "parquet": ("parquet", {}), "orc": ("orc", {}), "txt": ("text", {}), "wav": ("binaryFile", {}), "png": ("binaryFile", {}), "jpg": ("binaryFile", {})}


def read_records(spark: SparkSession, path: str, schema: str | None = None, **options: str) -> DataFrame:
    """Read by suffix; formats that run code on reading (pickles) are refused."""
    parts = path.rstrip("/").split("/")[-1].lower().split(".")
    suffix = parts[-2] if parts[-1] in ("gz", "gzip") and len(parts) > 1 else parts[-1]
    if suffix not in FORMATS:
        raise ValueError(f"no reader for {suffix!r}")
    kind, fixed = FORMATS[suffix]
    reader = spark.read.format(kind).options(**{**fixed, **options})
    return (reader.schema(schema) if schema else reader).load(path)


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities as null, as JSON has neither."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.withColumns({c: F.when(~bad(F.col(c)), F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")})


def write_records(df: DataFrame, path: str, kind: str = "json", partition: list[str] | None = None) -> None:
    writer = (json_safe(df) if kind == "json" else df).write.mode("overwrite").format(kind)
    (writer.partitionBy(*partition) if partition else writer).save(path)


def benchmark_of(path: Column) -> Column:
    """File stem up to the first double underscore."""
    return F.regexp_extract(path, r"([^/]+?)(?:__[^/]*)?\.[A-Za-z]+$", 1)


def output_name(benchmark: Column, method: Column) -> Column:
    return F.concat(benchmark, F.lit("__"), method, F.lit(".json"))


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines of text files, a header included."""
    return spark.read.text(path).count()


def nth_record(records: DataFrame, index: str, n: int) -> DataFrame:
    """The record of one ordinal; the filter reaches the scan."""
    return records.where(F.col(index) == n)


def first_path(body: Column, *paths: str) -> Column:
    """The first of several places in a JSON text that holds a value."""
    return F.coalesce(*[F.nullif(F.get_json_object(body, p), F.lit("")) for p in paths])


def derived_figures(body: Column) -> dict[str, Column]:
    """Figures of a run's JSON text: its own, else those of its first run; see :func:`run_figures` for missing ones."""
    number = lambda name: first_path(body, f"$.evaluation.{name}", f"$.evaluation.run_outputs[0].{name}").cast("double")
    return run_figures(number("latency"), number("num_samples"), number("runtime_inference"), number("coverage"))


def scan_results(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Result files with the columns of their paths; of a benchmark's files the last modified counts."""
    meta = F.col("_metadata")
    rows = spark.read.schema(schema).json(glob, multiLine=True).select("*", meta["file_path"].alias("path"), meta["file_modification_time"].alias("modified"))
    named = rows.withColumns({"benchmark": benchmark_of(F.col("path")), "model": F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)})
    last = named.groupBy("model", "benchmark").agg(F.max_by(F.struct(*[c for c in named.columns if c not in ("model", "benchmark")]), F.struct("modified", "path")).alias("row"))
    return last.select("model", "benchmark", "row.*")


def metric_rows(df: DataFrame, metrics: str = "metrics") -> DataFrame:
    """Long rows (position, metric, value) of a map of metrics."""
    return df.select("*", F.posexplode_outer(F.map_entries(metrics)).alias("position", "entry")).select(*df.columns, "position", F.col("entry.key").alias("metric"), F.col("entry.value").alias("value"))
