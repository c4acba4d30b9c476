"""Strict hourly sums over a stream of steps (I1): an addition, batch D1 is the definition.

Windows are tumbling and end-labelled. With a watermark, an hour comes out once it is closed, and only if it
is complete: late or missing steps lose the hour, as an incomplete hour is rejected in batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_hourly_sum(steps: DataFrame, keys: list[str], time: str, value: str, per_hour: int, late: str = "10 minutes") -> DataFrame:
    """``steps`` is a stream (or table) with a timestamp column ``time``."""
    return (
        steps.withWatermark(time, late)
        .groupBy(F.window(time, "1 hour"), *keys)
        .agg(F.sum(value).alias("amount"), F.count(value).alias("steps"))
        .filter(F.col("steps") == per_hour)
        .select(F.col("window.end").alias("hour_end"), *keys, "amount", "steps")
    )


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Run a bounded stream to its end into a Parquet table under ``folder`` (with its checkpoint) and read it."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
