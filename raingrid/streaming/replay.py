"""A table replayed as a stream, for tests and the registered query."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder


def steps_as_stream(steps: DataFrame) -> tuple[DataFrame, str]:
    """``steps(t, v)`` written to a folder and read as a stream, and that folder. One late marker closes the last hour.

    The folder is in the one that driver and executors share.
    """
    spark = steps.sparkSession
    folder = os.path.join(shared_folder(spark), f"stream-{uuid.uuid4().hex}")
    rows = steps.select(F.timestamp_seconds("t").alias("ts"), "v")
    rows.write.parquet(f"{folder}/steps/part=0")
    rows.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("interval 2 days")).alias("ts"), F.lit(0.0).alias("v")).write.parquet(f"{folder}/steps/part=1")
    source = spark.readStream.schema("ts timestamp, v double, part int").option("maxFilesPerTrigger", 64).parquet(f"{folder}/steps").drop("part")
    return source, folder
