"""Small result tables as CSV and JSON (A18, A19), split manifests (A10, A20), download profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """One file with a header, rows in order. For result tables, which are small."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a row; missing scores are null, never NaN."""
    fields = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of ``write_json`` by a schema; a line that isn't an object fails."""
    return spark.read.text(path).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of ``write_csv`` by a schema."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_manifest(splits: DataFrame, path: str) -> None:
    """Split manifests: a folder for each split with its times."""
    splits.repartition("split").sortWithinPartitions("time_epoch").write.mode("overwrite").partitionBy("split").option("header", True).csv(path)


def read_manifest(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Times with date and split; one split reads only its folder."""
    df = spark.read.schema("time_epoch long, date_utc date, split string").option("header", True).csv(path)
    return df.filter(F.col("split") == split) if split else df


def read_profile(text: str) -> dict[str, str]:
    """``key: value`` lines; comments are skipped; ``url`` and ``key`` must be there."""
    pairs = (line.partition(":") for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#"))
    out = {k.strip(): v.strip() for k, _, v in pairs}
    if lacking := {"url", "key"} - out.keys():
        raise ValueError(f"profile lacks {sorted(lacking)}")
    return out
