"""The folder that driver and executors share, for tables that are written and read again."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast up to so many bytes (a row counts 16 for itself and 8 for each column); larger ones are joined by a shuffle.
BROADCAST_BYTES = 24 << 20


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the checkpoint folder set on the context. Where neither is set, a local master gets a temporary one; on a cluster that is an error."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-raingrid-"))
    return context._jsc.sc().getCheckpointDir().get()


def bounded(table: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``table``, of numbers alone, with a broadcast hint if a count shows that it has at most ``most`` bytes. It should be cheap to count."""
    rows = most // (16 + 8 * len(table.columns))
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return os.path.join(shared_folder(spark), f"raingrid-{uuid.uuid4().hex}", name)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: small results that several jobs use are computed once, and are cheap to count."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
