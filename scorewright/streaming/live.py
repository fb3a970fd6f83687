"""Streaming extension: an incremental leaderboard and windowed throughput over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scorewright.storage import shared_folder


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Files of a folder as a stream; the schema is given, as streams infer none."""
    return spark.readStream.schema(schema).parquet(path)


def incremental_best(stream: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return stream.groupBy(*keys).agg(F.max(value).alias("best"), F.count("*").alias("n"))


def throughput(stream: DataFrame, time: str, window: str, slide: str | None = None, late: str = "1 hour", keys: list[str] = ()) -> DataFrame:
    """Count and sum per event-time window; rows later than the watermark are dropped."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a bounded stream to its end into a table of the shared folder.

    Each batch is written under its number, so that a batch that is tried again replaces itself; in complete mode the
    last one is the whole result.
    """
    spark, schema = stream.sparkSession, stream.schema
    path, done = shared_folder(spark, name), []

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        done.append(number)

    query = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{path}/_progress").trigger(availableNow=True).start()
    query.awaitTermination()
    parts = [f"{path}/{n}" for n in ([max(done)] if mode == "complete" and done else sorted(set(done)))]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
