"""Phase samples as a stream: the same gates on windows of arriving measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_samples(spark: SparkSession, path: str, schema: str = "event_id long, ts timestamp, user_id long, event_type string, value double, props string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed(samples: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts, sums and extremes per phase and window; rows later than the watermark are left out."""
    window = F.window("ts", width)
    return (
        samples.withWatermark("ts", late).groupBy(window.alias("w"), F.col("event_type").alias("phase"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("value")).cast("long").alias("wall_ms"), F.max("value").alias("worst"))
        .select(F.col("w.start").alias("start"), "phase", "n", "wall_ms", "worst")
    )


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> None:
    """Handles what has arrived and stops; the next call goes on from the checkpoint."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
