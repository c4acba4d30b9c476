"""Time: strict hourly sums, means of hours, spines, gaps, orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import strict_sum
from ..functions.scalar import day_of


def hour_end(start: Column, span: int = 3600) -> Column:
    """The end of the half-open interval [t - span, t) that a step's start is in (C3): a key, so the interval join is an equi-join."""
    return start - F.pmod(start, F.lit(span)) + F.lit(span)


def strict_hourly_sum(steps: DataFrame, keys: list[str], time: str, value: str, per_hour: int) -> DataFrame:
    """Hours labelled by their end, with the sum of exactly ``per_hour`` amounts or NULL."""
    return steps.groupBy(hour_end(F.col(time)).alias("hour_end"), *keys).agg(strict_sum(value, per_hour).alias("amount"), F.count(value).alias("steps"))


def day_spine(df: DataFrame, day: str) -> DataFrame:
    """Every day from the first to the last."""
    ends = df.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    return ends.filter("a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias(day))


def daily_mean_of_hourly_means(hours: DataFrame, time: str, value: str) -> DataFrame:
    """Each day of the spine with the unweighted mean of its hours and their number (D16, C10). The label's own date counts (Z-7)."""
    days = hours.withColumn("day", day_of(F.col(time))).groupBy("day").agg(F.avg(value).alias("daily_mean"), F.count(value).alias("valid_hours"))
    return day_spine(days, "day").join(days, "day", "left").select("day", "daily_mean", F.coalesce("valid_hours", F.lit(0)).alias("valid_hours"))


def centred_mean(days: DataFrame, order: str, value: str, width: int, out: str = "centred_mean") -> DataFrame:
    """Mean over ``width`` rows, from width // 2 before to the rest after; NULL unless all are there.

    One row for each day goes through one window: for daily series, not for cubes.
    """
    w = Window.orderBy(order).rowsBetween(-(width // 2), width - width // 2 - 1)
    return days.withColumn(out, F.when(F.count(value).over(w) == width, F.avg(value).over(w)))


def cadence_gaps(times: DataFrame, time: str, step: int, part: list[str], place: str | None = None) -> DataFrame:
    """Times whose distance from the one before in their part is not ``step``, with it.

    The one before is that in the order of ``place``, the order in which a file has them, so that a step back shows as a
    distance of 0 or less; without a place, that in time.
    """
    w = Window.partitionBy(*part).orderBy(place or time)
    return times.select(*part, time, (F.col(time) - F.lag(time).over(w)).alias("gap")).filter(F.col("gap") != step)


def missing_steps(times: DataFrame, time: str, step: int) -> DataFrame:
    """Steps between the first and the last that are not there (C6, G1): spine less seen."""
    ends = times.agg(F.min(time).alias("a"), F.max(time).alias("b"))
    spine = ends.filter("a is not null").select(F.explode(F.sequence("a", "b", F.lit(step).cast("long"))).alias(time))
    return spine.join(times.select(time).distinct(), time, "left_anti")


def same_axis(a: DataFrame, b: DataFrame, time: str) -> DataFrame:
    """One row: how many times each side has that the other lacks."""
    x, y = a.select(time).distinct(), b.select(time).distinct()
    only_a, only_b = x.join(y, time, "left_anti"), y.join(x, time, "left_anti")
    return only_a.agg(F.count("*").alias("only_a")).crossJoin(only_b.agg(F.count("*").alias("only_b")))


def hourly_area_means(df: DataFrame, time: str, a: str, b: str) -> DataFrame:
    """Means of both fields over the cells that both have, by hour; hours without such a cell are left out."""
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(time).agg(F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.count("*").alias("cells"))


def read_fields(aligned: DataFrame, other: DataFrame, keys: list[str], time: str = "t") -> DataFrame:
    """Cells of two tables by time and place (A21, C1, C2); fails if one has a time that the other lacks."""
    lost = same_axis(aligned, other, time)
    fault = F.raise_error(F.concat(F.lit("time axes differ: "), F.col("only_a").cast("string"), F.lit(" and "), F.col("only_b").cast("string"), F.lit(" times are on one side alone"))).cast("long")
    check = lost.select(F.when(F.col("only_a") + F.col("only_b") > 0, fault).otherwise(F.lit(0)).alias("_lost"))
    return aligned.join(other, [time, *keys]).crossJoin(F.broadcast(check)).filter("_lost = 0").drop("_lost")
