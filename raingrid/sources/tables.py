"""Cubes as Parquet tables by month: scan with declared schema, incremental sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.missing import finite
from ..functions.scalar import month_stem

# Declared schemas of the tables that stages exchange.
SCHEMAS = {
    "coarse": "time_epoch long, lat_idx int, lon_idx int, precipitation float",
    "radar": "time_epoch long, y_idx int, x_idx int, precipitation float",
    "aligned": "time_epoch long, y_idx int, x_idx int, coarse float, radar float",
    "synthetic_lr": "time_epoch long, lat_idx int, lon_idx int, precipitation float, source_valid_fraction float",
    "regrid_map": "y int, x int, overlap boolean, corner int, i int, j int, w double",
    "splits": "time_epoch long, date_utc date, split string",
}


def scan(spark: SparkSession, path: str, values: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """A Parquet table, its float values (or those named) NULL where they are NaN or infinite."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    names = values if values is not None else [c for c, t in df.dtypes if t in ("float", "double")]
    return df.withColumns({c: finite(c) for c in names}) if names else df


def write_months(df: DataFrame, path: str, time: str = "time_epoch", overwrite: bool = False) -> None:
    """Write a cube by month (A14): months that are there are left as they are, or replaced if ``overwrite``.

    The months of ``df`` are listed by name on the driver; rows are not. A job's files appear at its commit.
    """
    spark = df.sparkSession
    own = df.withColumn("month", month_stem(F.col(time)))
    if not overwrite:
        own = own.join(F.broadcast(months_of(spark, path)), "month", "left_anti")
    # partitions are cut and joined to the advisory size, so a month has as many files as its bytes ask for
    own.hint("rebalance", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def write_by_time(df: DataFrame, name: str, path: str, time: str = "time_epoch", buckets: int = 200) -> DataFrame:
    """A cube as a table of the catalog whose files are dealt by a hash of time and sorted by it (A21, C1, C2); returns it, read.

    Cubes written with as many buckets meet time by time without a shuffle, and what is grouped by time isn't shuffled either. A
    bucket is written by one task, so ``buckets`` should be as many as keep each at some hundred megabytes. Joins by time and place only
    count as met by buckets of time where ``spark.sql.requireAllClusterKeysForCoPartition`` is false, which ``join_by_time`` sets.
    """
    df.repartition(buckets, time).write.bucketBy(buckets, time).sortBy(time).option("path", path).mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def join_by_time(a: DataFrame, b: DataFrame, keys: list[str], time: str = "time_epoch") -> DataFrame:
    """Cells of two cubes of ``write_by_time`` side by side (C1, A21): buckets of one time meet, no cell is moved.

    Sets ``spark.sql.requireAllClusterKeysForCoPartition`` to false for the session.
    """
    a.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return a.hint("merge").join(b, [time, *keys])


def months_of(spark: SparkSession, path: str) -> DataFrame:
    """Months that a table has: one string each, from its folders."""
    try:
        table = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001  the table isn't there yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], "month string")
    return table.select(F.col("month").cast("string")).distinct()


def inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files with their sizes, without their contents."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")


def month_audit(files: DataFrame, months: DataFrame, stem: str = r"(\d{4}_\d{2})") -> DataFrame:
    """Each expected month with its number of files and bytes, and whether it is ok."""
    found = files.withColumn("month", F.regexp_extract("path", stem, 1)).groupBy("month").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    return months.join(found, "month", "left").select("month", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"), (F.coalesce("files", F.lit(0)) == 1).alias("ok"))


def file_stats(rows: DataFrame, file: str, time: str = "t", value: str = "v") -> DataFrame:
    """For each file its first and last time, number of times, least and largest step between them, shape, units and missing cells (A1, A3)."""
    per = rows.groupBy(file, time).agg(
        F.max("y").alias("y"), F.max("x").alias("x"), F.count_if(F.col(value).isNull()).alias("missing"), F.min("units").alias("low"), F.max("units").alias("high")
    )
    step = F.col(time) - F.lag(time).over(Window.partitionBy(file).orderBy(time))
    return per.withColumn("step", step).groupBy(file).agg(
        F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("times"), F.min("step").alias("least_step"), F.max("step").alias("largest_step"),
        (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.when(F.min("low") == F.max("high"), F.min("low")).alias("units"), F.sum("missing").alias("missing"),
    )


def write_map(mapping: DataFrame, path: str, overwrite: bool = False) -> None:
    """A regrid map in its declared schema."""
    kinds = (c.split() for c in SCHEMAS["regrid_map"].split(", "))
    mapping.select(*(F.col(c).cast(t) for c, t in kinds)).write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def load_bilinear_map(spark: SparkSession, path: str) -> DataFrame:
    """A regrid map of ``write_map`` (A9); ``regrid_bilinear`` broadcasts it where a count shows that it is small."""
    return scan(spark, path, [], SCHEMAS["regrid_map"])


def write_grids(folder: str, overwrite: bool = False, **grids: DataFrame) -> None:
    """Dimension tables of grids (axes, geolocation, reference system), a folder for each (A16). They are small: one file each."""
    for name, grid in grids.items():
        grid.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{folder}/{name}")


def read_grids(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}
