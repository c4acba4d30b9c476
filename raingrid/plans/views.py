"""Deterministic views of the test tables in the shape of series, grids and fields, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import epoch_seconds

#: Side of the grid view.
SIDE = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str, step: int) -> DataFrame:
    """Amounts ``(t, v)`` by steps that have events; every 97th step's amount is missing."""
    t = F.floor(epoch_seconds("ts") / step) * step
    out = table(spark, sf_dir, "events").select(t.alias("t"), "value").groupBy("t").agg(F.sum("value").alias("v"))
    return out.withColumn("v", F.when(F.col("t") / step % 97 != 0, F.col("v")))


def series_sql(step: int) -> str:
    return f"""s AS (
  SELECT t, CASE WHEN (t // {step}) % 97 <> 0 THEN v END AS v FROM (
    SELECT CAST(floor(epoch(ts) / {step}) AS BIGINT) * {step} AS t, sum(value) AS v FROM events GROUP BY 1))"""


def grid(spark: SparkSession, sf_dir: str, side: int = SIDE) -> DataFrame:
    """Cells ``(t, y, x, truth, est, syn, available, overlap)`` by week; some of ``est`` and ``available`` are missing."""
    cells = (
        table(spark, sf_dir, "lineitem")
        .select(
            F.floor(epoch_seconds("l_shipdate") / 604800).alias("t"),
            (F.col("l_suppkey") % side).alias("y"),
            (F.col("l_partkey") % side).alias("x"),
            (F.pow(F.col("l_quantity") - 1, F.lit(2.0)) / 100).alias("truth"),
            (F.pow(F.round(F.col("l_discount") * 100), F.lit(2.0)) / 4).alias("est"),
            F.round(F.col("l_tax") * 100).alias("syn"),
        )
        .groupBy("t", "y", "x")
        .agg(F.min("truth").alias("truth"), F.min("est").alias("est"), F.min("syn").alias("syn"))
    )
    return cells.withColumns({
        "est": F.when((3 * F.col("y") + 5 * F.col("x") + F.col("t")) % 11 != 0, F.col("est")),
        "available": (2 * F.col("y") + 3 * F.col("x") + F.col("t")) % 13 != 0,
        "overlap": ~((F.col("y") == 0) & (F.col("x") < 3)),
    })


def grid_sql(side: int = SIDE) -> str:
    return f"""g AS (
  SELECT t, y, x, truth, CASE WHEN (3 * y + 5 * x + t) % 11 <> 0 THEN est END AS est, syn,
         (2 * y + 3 * x + t) % 13 <> 0 AS available, NOT (y = 0 AND x < 3) AS overlap
  FROM (SELECT CAST(floor(epoch(l_shipdate) / 604800) AS BIGINT) AS t, l_suppkey % {side} AS y, l_partkey % {side} AS x,
               min(pow(l_quantity - 1, 2) / 100) AS truth, min(pow(round(l_discount * 100), 2) / 4) AS est, min(round(l_tax * 100)) AS syn
        FROM lineitem GROUP BY 1, 2, 3)),
c AS (SELECT * FROM g WHERE overlap AND available AND truth IS NOT NULL AND est IS NOT NULL)"""


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 fields ``(t, i, j, v)`` of vectors; every 29th cell is missing."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("t"), F.posexplode("embedding").alias("k", "v"))
    i, j = F.floor(F.col("k") / 8).cast("int"), (F.col("k") % 8).cast("int")
    return e.select("t", i.alias("i"), j.alias("j"), F.when((F.col("t") * 7 + F.col("k")) % 29 != 0, F.col("v").cast("double")).alias("v"))


FIELD_SQL = """f AS (
  SELECT t, k // 8 AS i, k % 8 AS j, CASE WHEN (t * 7 + k) % 29 <> 0 THEN v END AS v
  FROM (SELECT vec_id AS t, generate_subscripts(embedding, 1) - 1 AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings))"""
