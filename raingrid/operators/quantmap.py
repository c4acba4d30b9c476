"""Quantile mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import interpolate, non_negative


def fit_quantile_map(train: DataFrame, source: str, target: str, levels: int = 2049, accuracy: int | None = None) -> DataFrame:
    """Knots ``(src, dst)``: quantiles of both sides paired by level, ties of the source averaged, made monotone.

    Quantiles are exact over the rows given, which should be the per-hour sample of the training split;
    ``accuracy`` asks for a sketch of fixed size instead.
    """
    ps = [k / (levels - 1) for k in range(levels)]
    q = (lambda c: F.percentile(c, F.array(*(F.lit(p) for p in ps)))) if accuracy is None else (lambda c: F.percentile_approx(c, ps, accuracy))
    both = train.filter(F.col(source).isNotNull() & F.col(target).isNotNull()).agg(q(source).alias("s"), q(target).alias("d"))
    pairs = both.select(F.explode(F.arrays_zip("s", "d")).alias("p")).select(F.col("p.s").alias("src"), F.col("p.d").alias("dst"))
    # targets below 0 count as 0 before they are averaged and made monotone
    knots = pairs.groupBy("src").agg(F.avg(F.greatest("dst", F.lit(0.0))).alias("dst"))
    return knots.select("src", F.max("dst").over(Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0)).alias("dst"))


def apply_quantile_map(df: DataFrame, value: str, knots: DataFrame, out: str = "mapped", most: int = 4_095) -> DataFrame:
    """Each value mapped by its bracket of knots, constant beyond the ends, not below 0; missing stays missing.

    The knots are at most as many as levels were asked for: one row of an array, which is broadcast, and a
    binary search in it for each value. A range join would be a nested loop. More than ``most`` knots are an error.
    """
    table = knots.agg(F.sort_array(F.collect_list(F.struct("src", "dst"))).alias("_k"))
    table = table.select(F.when(F.size("_k") <= most, F.col("_k")).otherwise(F.raise_error(F.concat(F.size("_k").cast("string"), F.lit(f" knots, at most {most} are looked up"))).cast(dict(table.dtypes)["_k"])).alias("_k"))
    joined = df.crossJoin(F.broadcast(table))
    # binary search: the number of knots at or below the value, by halving steps
    size = F.size("_k")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(most.bit_length()))))
    n = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= size) & (F.try_element_at(F.col("_k.src"), at + s) <= F.col(value)), at + s).otherwise(at))
    at = F.greatest(F.lit(1), F.least(F.col("_n"), F.greatest(size - 1, F.lit(1))))
    low, high = F.try_element_at("_k", at), F.try_element_at("_k", F.least(at + 1, size))
    mapped = interpolate(F.col(value), low["src"], high["src"], low["dst"], high["dst"])
    return joined.withColumn("_n", n).withColumn(out, non_negative(F.when(F.col(value).isNotNull(), mapped))).drop("_k", "_n")
