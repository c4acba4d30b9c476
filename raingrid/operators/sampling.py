"""Deterministic samples and choices by keyed hashes (F2-F8, E9). The same rows in every run and engine."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import REGISTRIES
from ..sources.shared import bounded, written


def hash_key(seed: int, *names: str) -> Column:
    """The md5 of the seed and the key's parts with colons between: its order is the random order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(n).cast("string") for n in names)))


def pixel_sample(df: DataFrame, seed: int, time: str = "t", most: int = 2048, least: int = 128, share: int = 1024, fixed: int | None = None) -> DataFrame:
    """Of each time min(n, most, max(least, n // share)) cells, or ``fixed`` of them, by hash order."""
    if fixed is not None:
        most = fixed
    # of each time only the cells whose hash is small enough to be among the first are sorted: twice as many as are wanted and
    # 64 more on average, all of them where a time has few (so that one that falls short has no more)
    # of a time; counts by time come first, a row each, so that the others are left behind before anything is shuffled
    counts = written(df.groupBy(F.col(time).alias("_t")).agg(F.count("*").alias("_n")), "counts")
    all_of_it = Window.partitionBy(time)
    k = F.lit(fixed) if fixed is not None else F.least(F.col("_n"), F.lit(most), F.greatest(F.lit(least), F.floor(F.col("_n") / share)))
    counted = df.join(bounded(counts), F.col(time).eqNullSafe(F.col("_t"))).drop("_t").withColumns({"_k": k, "_h": hash_key(seed, time, "y", "x")})
    near = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * F.col("_n") < (2 * F.col("_k") + 64) * F.lit(1 << 32)
    order = Window.partitionBy(time).orderBy("_h", "y", "x")
    ranked = counted.filter(near).withColumn("_r", F.row_number().over(order)).withColumn("_m", F.count("*").over(all_of_it))
    enough = F.when(F.col("_m") >= F.least("_k", "_n"), F.col("_r") <= F.col("_k")).otherwise(F.raise_error("a sample's hash share was too small").cast("boolean"))
    return ranked.filter(enough).select(*df.columns)


def qc_sample(times: DataFrame, seed: int, size: int, time: str, month: str) -> DataFrame:
    """One time of each month and others up to ``size`` in all, without repeats (F5). Months are few; the rest is a top-k."""
    own = times.select(month, time).distinct().withColumn("_h", hash_key(seed, time))
    first = own.withColumn("_r", F.row_number().over(Window.partitionBy(month).orderBy("_h", time))).withColumn("picked", F.col("_r") == 1)
    ranked = first.select(time, month, "picked", F.when(F.col("picked"), F.lit(0)).otherwise(F.lit(1)).alias("_o"), "_h")
    return ranked.orderBy("_o", "_h", time).limit(size).select(month, time, F.when(F.col("picked"), F.lit("month")).otherwise(F.lit("fill")).alias("reason"))


def choose_patch(eligible: DataFrame, seed: int, epoch: int, time: str = "t") -> DataFrame:
    """One eligible patch of each time: the one with the smallest hash (F7), a uniform choice that needs no numbering."""
    key = F.struct(hash_key(seed + epoch * 100_000, time, "patch_y", "patch_x").alias("h"), "patch_y", "patch_x")
    return eligible.groupBy(time).agg(F.min(key).alias("k"), F.count("*").alias("eligible")).select(F.lit(epoch).alias("epoch"), time, F.col("k.patch_y").alias("patch_y"), F.col("k.patch_x").alias("patch_x"), "eligible")


def epoch_order(times: DataFrame, seed: int, epoch: int, time: str = "t") -> DataFrame:
    """Times in the shuffled order of an epoch (F8)."""
    return times.select(time).distinct().orderBy(hash_key(seed + 1000 + epoch, time), time)


def epoch_places(times: DataFrame, seed: int, epoch: int, time: str = "t") -> DataFrame:
    """Every time with its ``place``, from 0, in the shuffled order of an epoch (F8): sorted within 4,096 ranges of the hash, after the rows of the ranges before."""
    h = hash_key(seed + 1000 + epoch, time)
    own = times.select(time).distinct().withColumns({"h": h, "range": F.substring(h, 1, 3)})
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most 4,096 rows
    offsets = own.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = own.withColumn("within", F.row_number().over(Window.partitionBy("range").orderBy("h", time)))
    return ranked.join(F.broadcast(offsets), "range").select((F.col("offset") + F.col("within") - 1).alias("place"), time)


def typical_hours(stats: DataFrame, time: str = "t") -> DataFrame:
    """A dry hour, hours nearest to the 25th, 50th and 90th percentile of wet maxima, and the peak.

    ``stats(t, cells, max, wet_fraction)``. Dry: of hours with maximum at most 0 the one with most cells; if
    there is none, the smallest wet share, as ``driest_available``. Ties go to the earliest hour; labels of one hour are joined.
    """
    wet = stats.filter("max > 0")
    levels = wet.agg(F.percentile("max", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.9))).alias("q"))
    dry = stats.agg(
        F.min(F.when(F.col("max") <= 0, F.struct((-F.col("cells")).alias("a"), F.col(time).alias("b")))).alias("dry"),
        F.min(F.struct(F.col("wet_fraction").alias("a"), F.col(time).alias("b"))).alias("least"),
    ).select(F.when(F.col("dry").isNotNull(), "dry").otherwise("driest_available").alias("label"), F.coalesce("dry.b", "least.b").alias(time), F.lit(0).alias("place"))
    near = wet.crossJoin(F.broadcast(levels)).agg(
        *(F.min(F.struct(F.abs(F.col("max") - F.col("q")[k]).alias("a"), F.col(time).alias("b"))).alias(f"k{k}") for k in range(3)), F.min(F.struct((-F.col("max")).alias("a"), F.col(time).alias("b"))).alias("k3")
    )
    picks = near.select(F.explode(F.array(*(F.struct(F.lit(n).alias("label"), F.col(f"k{k}.b").alias(time), F.lit(k + 1).alias("place")) for k, n in enumerate(("wet_p25", "wet_p50", "wet_p90", "peak"))))).alias("p")).select("p.*")
    every = dry.unionByName(picks).filter(F.col(time).isNotNull())
    return every.groupBy(time).agg(F.min("place").alias("place"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "label"))), lambda s: s["label"]), "+").alias("labels"))


def typical_per_bin(df: DataFrame, registry: str, target: str, time: str = "t") -> list[tuple[str, int]]:
    """For each bin the hour with the largest share of cells in it, hours distinct across bins in order (F2).

    Spark ranks the hours of each bin; the greedy choice sees at most as many rows as bins squared.
    """
    bins = REGISTRIES[registry]
    shares = df.filter(F.col(target).isNotNull()).groupBy(time).agg(*(F.avg(holds(F.col(target)).cast("double")).alias(f"b{k}") for k, (_, holds) in enumerate(bins)))
    long = shares.select(time, F.explode(F.array(*(F.struct(F.lit(k).alias("bin"), F.col(f"b{k}").alias("share")) for k in range(len(bins))))).alias("s")).select(time, "s.*").filter("share > 0")
    top = long.withColumn("r", F.row_number().over(Window.partitionBy("bin").orderBy(F.desc("share"), time))).filter(F.col("r") <= len(bins))
    used, out = set(), []
    for row in top.orderBy("bin", "r").collect():
        if not any(label == bins[row["bin"]][0] for label, _ in out) and row[time] not in used:
            used.add(row[time])
            out.append((bins[row["bin"]][0], row[time]))
    return out


def first_per_month(times: DataFrame, time: str, month: str) -> DataFrame:
    """The first time of each month."""
    return times.groupBy(month).agg(F.min(time).alias(time))


