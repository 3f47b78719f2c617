"""Noise shares and sessions of event streams over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, delay: str = "1 hour") -> DataFrame:
    """Parquet files as a stream; time is cast, as a watermark needs a timestamp with a zone."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events*").parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def window_share(events: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """Per window and type: count, mean, and the variance's share that the values' distance from the window's mean has."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    g = events.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("noise"), F.avg(F.col("value") * F.col("value")).alias("power"))
    share = F.when(F.col("power") > 0, F.col("noise") / F.col("power")).otherwise(0.0)
    return g.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"), F.round(share, 6).alias("share"))


def sessions(events: DataFrame, gap: str) -> DataFrame:
    g = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "user_id", "n", F.round("total", 6).alias("total"))


def run_to_end(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream over all that is there now and returns the whole result, which each batch writes anew in a shared folder."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/result")

    q = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/result")
