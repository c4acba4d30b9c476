"""Scores from sums that merge (I3, J2): a table of states by month, to which new months add rows, and scores told from states alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bins import EVENT_THRESHOLDS
from ..functions.missing import ratio
from ..sources.tables import months_of

#: What a state sums: the first five for a method (threshold null), the last three for a method and threshold.
SUMS = ("n", "hours", "sum_abs", "sum_sq", "sum_error", "hits", "false_alarms", "misses")


def merge(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """States summed over all but ``by``, method and threshold: sums of sums, in any order and any grouping."""
    return states.groupBy(*by, "method", "threshold").agg(*(F.sum(c).alias(c) for c in SUMS))


def month_states(df: DataFrame, support: Column, target: str, estimates: Sequence[str], time: str, thresholds: Sequence[float] = EVENT_THRESHOLDS) -> DataFrame:
    """``(month, method, threshold, *SUMS)``: what each month (column ``month`` of ``df``) adds to the scores of each method.

    Rows are summed by time first, so that hours are counted without a set of them; all methods and thresholds share that pass. A time
    belongs to one month. Amounts are compared with thresholds in their own type (Z-3). A month without support has no state.
    """
    kinds = dict(df.dtypes)
    at = lambda c, t: F.col(c) >= F.lit(float(t)).cast(kinds[c])
    none = {c: F.lit(None).cast("double" if c.startswith("sum_") else "long") for c in SUMS}

    def row(method: str, threshold: float | None, **sums: Column) -> Column:
        return F.struct(F.lit(method).alias("method"), F.lit(threshold).cast("double").alias("threshold"), *(v.alias(c) for c, v in (none | sums).items()))

    rows = []
    for m in estimates:
        e = F.col(m).cast("double") - F.col(target).cast("double")
        rows.append(row(m, None, n=F.count(e), hours=(F.count(e) > 0).cast("long"), sum_abs=F.sum(F.abs(e)), sum_sq=F.sum(e * e), sum_error=F.sum(e)))
        rows += [row(m, float(t), hits=F.count_if(at(target, t) & at(m, t)), false_alarms=F.count_if(~at(target, t) & at(m, t)), misses=F.count_if(at(target, t) & ~at(m, t))) for t in thresholds]
    return merge(df.filter(support).groupBy("month", time).agg(F.array(*rows).alias("_s")).select("month", F.inline("_s")), ["month"]).select("month", "method", "threshold", *SUMS)


def update_states(cube: DataFrame, path: str, support: Column, target: str, estimates: Sequence[str], time: str, thresholds: Sequence[float] = EVENT_THRESHOLDS) -> DataFrame:
    """The states under ``path``, to which the months of ``cube`` that they lack are added.

    ``cube`` is partitioned by month, and months that are there are left out by their names, so their files aren't read. A month is
    complete when its states are made; one that changes has its folder of states removed first. States have one set of methods and thresholds.
    """
    have = [r["month"] for r in months_of(cube.sparkSession, path).collect()]  # one row a month
    new = cube.withColumn("month", F.col("month").cast("string"))
    new = new.filter(~F.col("month").isin(have)) if have else new
    states = month_states(new, support, target, estimates, time, thresholds)
    # a month has a few rows, written by one task to one file
    states.repartition("month").write.mode("append").partitionBy("month").parquet(path)
    return cube.sparkSession.read.schema(states.schema).parquet(path)


def point_scores(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n, MAE, RMSE, bias and valid hours of each method (D2) by ``by``, from states alone."""
    own = merge(states.filter("threshold is null"), by)
    n = F.col("n")
    return own.select(*by, "method", "n", F.try_divide("sum_abs", n).alias("mae"), F.sqrt(F.try_divide("sum_sq", n)).alias("rmse"), F.try_divide("sum_error", n).alias("bias"), F.col("hours").alias("valid_hours"))


def event_scores(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Hits, false alarms, misses, CSI and one-cell FSS of each method and threshold (D3, D4) by ``by``, from states alone."""
    own = merge(states.filter("threshold is not null"), by)
    hits, wrong = F.col("hits"), F.col("false_alarms") + F.col("misses")
    return own.select(*by, "method", "threshold", "hits", "false_alarms", "misses", ratio(hits, hits + wrong).alias("csi"), (1 - ratio(wrong, 2 * hits + wrong)).alias("fss"))
