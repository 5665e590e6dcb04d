"""Scores of streams: scoring is a projection without state, and verdicts are counted by window under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telltale.operators.prose import with_features
from telltale.sources.stores import batch_writer, batches, new_folder


def scored(stream: DataFrame, text: str = "text", lang: str | None = None) -> DataFrame:
    """A stream of texts with their scores and verdicts, in append mode."""
    keep = [c for c in stream.columns if c not in ("score_per_1k", "verdict")]
    return with_features(stream, text, lang).select(*keep, "score_per_1k", "verdict")


def verdict_counts(stream: DataFrame, time: str, window: str, delay: str) -> DataFrame:
    """Texts by window and verdict; a window is given out once no event of it can come within ``delay``."""
    kept = stream.withWatermark(time, delay).groupBy(F.window(time, window), "verdict").agg(F.count(F.lit(1)).alias("n"))
    return kept.select(F.col("window.start").alias("window_start"), "verdict", "n")


def window_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams the events, scores the text of each and counts verdicts by day, all windows included at the end."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name[0]}*{name[1:]}")
    told = source.select(F.col("ts").cast("timestamp").alias("ts"), F.concat_ws(" ", F.lit("We delve into"), "event_type", F.col("props")).alias("text"))
    sink = new_folder(spark, "verdicts")
    counts = verdict_counts(scored(told, lang="en"), "ts", "1 day", "1 hour")
    query = counts.writeStream.outputMode("complete").foreachBatch(batch_writer(sink)).option("checkpointLocation", new_folder(spark, "verdicts-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    told = batches(spark, sink, "window_start timestamp, verdict string, n long, batch long")
    return told.where(F.col("batch") == told.agg(F.max("batch")).first()[0]).drop("batch")  # each batch has all windows
