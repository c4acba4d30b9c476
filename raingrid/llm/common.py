"""What the operators of this subpackage share: scratch tables, bounded broadcasts, components."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: A table is broadcast up to so many bytes (a row counts 16 for itself and 8 for each column); larger ones are joined by a shuffle.
BROADCAST_BYTES = 24 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return os.path.join(shared_folder(spark), f"raingrid-{uuid.uuid4().hex}", name)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later jobs neither repeat its work nor depend on executors that may be lost."""
    return Tables(df.sparkSession).write(df, name)


class Tables:
    """Tables of one run in a folder of its own in the shared folder. What later tables have used up can be dropped."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, os.path.join(shared_folder(spark), f"raingrid-{uuid.uuid4().hex}")

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = os.path.join(self.folder, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.folder, name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded(table: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``table``, of numbers alone, with a broadcast hint if a count shows that it has at most ``most`` bytes. It should be cheap to count (a written table)."""
    rows = most // (16 + 8 * len(table.columns))
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def remainder(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4: the fold of a row (2 is held out)."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 4


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(id, component)`` for each end of ``edges(src, dst)``; component is the smallest id reachable.

    Rounds of large-star and small-star: each round is aggregations and equi-joins, so a hub's edges are
    summed before they are shuffled and a skewed join can be split. Each round's edges are a table in the
    shared folder, dropped after the next; the loop ends when a round changes nothing (two numbers on the driver).
    """
    tables = Tables(edges.sparkSession)
    now = tables.write(
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct(),
        f"{name}-0",
    )
    mark = _mark(now)
    step = 0
    while mark[0]:
        step += 1
        now = tables.write(_small_star(_large_star(now)), f"{name}-{step}")
        then, mark = mark, _mark(now)
        tables.drop(f"{name}-{step - 1}")
        if mark == then:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return (row["n"], row["x"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex points its larger neighbours to the smallest vertex of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # only larger neighbours move: the rows (u, v) with v > u are the edges themselves, turned round
    return (
        edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        .join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex points its smaller neighbours, and itself, to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
