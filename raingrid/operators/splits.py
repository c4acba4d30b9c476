"""Chronological splits by whole days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import day_of, month_stem
from ..sources.shared import bounded

#: Shares of days for training and validation; the rest is the test.
TRAIN, VALIDATION = 0.70, 0.15


def chronological_splits(times: DataFrame, time: str = "t", train: float = TRAIN, validation: float = VALIDATION) -> DataFrame:
    """Each time with its date and split; a date is in one split, splits follow one another.

    Days are numbered through one window: there are a few thousand, whatever the cube's size.
    """
    dated = times.select(time).distinct().withColumn("date_utc", day_of(F.col(time)))
    days = dated.select("date_utc").distinct()
    placed = days.withColumn("k", F.row_number().over(Window.orderBy("date_utc"))).crossJoin(F.broadcast(days.agg(F.count("*").alias("n"))))
    split = F.when(F.col("k") <= F.floor(F.col("n") * train), "train").when(F.col("k") <= F.floor(F.col("n") * train) + F.floor(F.col("n") * validation), "validation").otherwise("test")
    return dated.join(placed.select("date_utc", split.alias("split")), "date_utc").select(time, "date_utc", "split")


def split_summary(splits: DataFrame, time: str = "t") -> DataFrame:
    """Hours, days and ends of each split."""
    return splits.groupBy("split").agg(F.count("*").alias("hours"), F.count_distinct("date_utc").alias("days"), F.min(time).alias("first"), F.max(time).alias("last"))


def in_split(df: DataFrame, splits: DataFrame, name: str, time: str = "t") -> DataFrame:
    """Rows whose time is in a split."""
    return df.join(splits.filter(F.col("split") == name).select(time), time, "left_semi")


def in_split_of_cube(cube: DataFrame, splits: DataFrame, name: str, time: str = "time_epoch", month: str = "month") -> DataFrame:
    """Rows of a cube by months (``tables.write_months``) whose time is in a split (B13, C5): only the split's months are read.

    ``splits`` is a manifest that was written (``reports.write_manifest``). Its times carry their month, the cube's partition; they are some
    thousand numbers and are broadcast where a count shows that, so that Spark prunes partitions by them when the query runs.
    """
    own = splits.filter(F.col("split") == name).select(F.col(time), month_stem(F.col(time)).alias("_month"))
    met = (cube[month].cast("string") == own["_month"]) & (cube[time] == own[time])
    return cube.join(bounded(own), met, "left_semi")


def classify(df: DataFrame, splits: DataFrame, time: str = "t") -> DataFrame:
    """Rows with their split, or ``unclassified``; fails if a time is in more than one split."""
    fault = F.raise_error(F.concat(F.lit("in several splits: "), F.col(time).cast("string"))).cast("string")
    own = splits.groupBy(time).agg(F.min("split").alias("split"), F.max("split").alias("_last")).select(time, F.when(F.col("split") == F.col("_last"), F.col("split")).otherwise(fault).alias("split"))
    return df.join(own, time, "left").withColumn("split", F.coalesce("split", F.lit("unclassified")))


def overlap_of_splits(splits: DataFrame) -> DataFrame:
    """Dates that are in more than one split (G2): none, if all is well."""
    return splits.groupBy("date_utc").agg(F.count_distinct("split").alias("splits")).filter("splits > 1")


def split_coverage(df: DataFrame, splits: DataFrame, time: str = "t") -> DataFrame:
    """For each split the times it has, those of ``df`` that are in it, those it lacks, and, in a row ``unclassified``, those in no split."""
    found = df.select(time).distinct().withColumn("found", F.lit(1))
    own = splits.select(time, "split").join(found, time, "full").withColumn("split", F.coalesce("split", F.lit("unclassified")))
    return own.groupBy("split").agg(
        F.count_if(F.col("split") != "unclassified").alias("expected"), F.count("found").alias("found"), F.count_if(F.col("found").isNull()).alias("missing"), F.count_if(F.col("split") == "unclassified").alias("unexpected")
    )


def require_coverage(coverage: DataFrame, name: str) -> DataFrame:
    """The row of one split; its evaluation fails if the split isn't covered whole."""
    fault = F.raise_error(F.concat(F.lit(f"partial split {name}: missing "), F.col("missing").cast("string"))).cast("long")
    return coverage.filter(F.col("split") == name).withColumn("found", F.when(F.col("missing") > 0, fault).otherwise(F.col("found")))
