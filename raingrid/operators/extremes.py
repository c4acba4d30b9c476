"""Extremes and histograms."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bins import HEAVY_THRESHOLDS, PATCH_THRESHOLDS, REGISTRIES, bin_of
from ..functions.missing import ratio
from ..sources.shared import BROADCAST_BYTES, written

#: Histogram: lowest and highest finite edge and the number of bins (the last is open).
LOW, HIGH, BINS = 1e-3, 300.0, 121


def histogram_bin(v: Column, low: float = LOW, high: float = HIGH, bins: int = BINS) -> Column:
    """-2 for an exact 0, -1 below the first edge, else the bin; NULL for negatives and missing values.

    The bin is a logarithm, moved by one where the value lies on the other side of the bin's own edge.
    """
    step = math.log(high / low) / (bins - 1)
    near = F.floor(F.ln(v / F.lit(low)) / F.lit(step)).cast("int")
    edge = lambda k: F.lit(low) * F.exp(k * F.lit(step))
    exact = F.when(v < edge(near), near - 1).when(v >= edge(near + 1), near + 1).otherwise(near)
    return F.when(v == 0, F.lit(-2)).when((v > 0) & (v < low), F.lit(-1)).when(v >= low, F.least(F.greatest(exact, F.lit(0)), F.lit(bins - 1)))


def log_histogram(long: DataFrame, value: str, by: str) -> DataFrame:
    """Counts of every bin for each value of ``by``, zeros too, with the bin's edges."""
    spark = long.sparkSession
    edges = [LOW * (HIGH / LOW) ** (k / (BINS - 1)) for k in range(BINS)]
    rows = [(-2, 0.0, 0.0), (-1, 0.0, LOW), *((k, edges[k], edges[k + 1] if k + 1 < BINS else None) for k in range(BINS))]
    spine = spark.createDataFrame(rows, "bin int, bin_lower double, bin_upper double")
    counts = long.withColumn("bin", histogram_bin(F.col(value))).filter("bin is not null").groupBy(by, "bin").agg(F.count("*").alias("n"))
    names = long.select(by).distinct()
    return names.crossJoin(F.broadcast(spine)).join(counts, [by, "bin"], "left").select(by, "bin", "bin_lower", "bin_upper", F.coalesce("n", F.lit(0)).alias("n"))


def bin_cells(long: DataFrame, registry: str, value: str, by: str) -> DataFrame:
    """Cells, negatives, maximum and cells by bin with their share for each product, empty bins too."""
    spark = long.sparkSession
    spine = spark.createDataFrame([(k, label) for k, (label, _) in enumerate(REGISTRIES[registry])], "bin int, bin_label string")
    present = long.filter(F.col(value).isNotNull())
    totals = present.groupBy(by).agg(F.count("*").alias("cells"), F.count_if(F.col(value) < 0).alias("negatives"), F.max(value).alias("max"))
    counts = present.groupBy(by, bin_of(registry, value).alias("bin_label")).agg(F.count("*").alias("n"))
    return (
        totals.crossJoin(F.broadcast(spine)).join(counts, [by, "bin_label"], "left")
        .select(by, "bin", "bin_label", F.coalesce("n", F.lit(0)).alias("n"), "cells", "negatives", "max")
        .withColumn("fraction", ratio(F.col("n"), F.col("cells")))
    )


def hourly_maxima(df: DataFrame, support: Column, values: Sequence[str], time: str = "t") -> DataFrame:
    """Maximum of each product over the supported cells of each time; a time without one has 0 cells and NULL."""
    return df.groupBy(time).agg(F.count_if(support).alias("cells"), *(F.max(F.when(support, F.col(v))).alias(f"max_{v}") for v in values))


def exceedance_hours(maxima: DataFrame, values: Sequence[str], thresholds: Sequence[float] = HEAVY_THRESHOLDS) -> DataFrame:
    """Hours whose maximum is over each threshold."""
    kinds = dict(maxima.dtypes)
    counts = [F.struct(F.lit(v).alias("product"), F.lit(float(t)).alias("threshold"), F.count_if(F.col(f"max_{v}") > F.lit(float(t)).cast(kinds[f"max_{v}"])).alias("hours")) for v in values for t in thresholds]
    return maxima.agg(F.array(*counts).alias("k")).select(F.inline("k"))


def patch_exceedance(patches: DataFrame, values: DataFrame, patch: int, thresholds: Sequence[float] = PATCH_THRESHOLDS, time: str = "t") -> DataFrame:
    """For each epoch and for all together: patches chosen and those whose maximum is over each threshold.

    ``patches(epoch, t, patch_y, patch_x)`` has one patch for each time and epoch; ``values(t, y, x, v)`` are supported cells. A patch is
    one number in the list of each block of the grid that it touches (blocks have twice its side: four at most), so that a cell meets only patches that are near.
    The lists of all times and epochs of a training run take some ten megabytes; they are broadcast where their written size shows that, else joined by time and block.
    """
    side = 2 * patch
    near = lambda c: F.explode(F.array_distinct(F.array(F.floor(F.col(c) / side), F.floor((F.col(c) + (patch - 1)) / side))))
    code = (F.col("epoch").cast("long") * (1 << 20) + F.col("patch_y")) * (1 << 20) + F.col("patch_x")
    lists = patches.select(time, code.alias("_code"), near("patch_y").alias("_by"), "patch_x").select(time, "_code", "_by", near("patch_x").alias("_bx"))
    lists = written(lists.groupBy(time, "_by", "_bx").agg(F.collect_list("_code").alias("_codes")), "lists")
    size = lists.agg(F.sum(F.size("_codes") * 8 + 64)).first()[0] or 0
    cells = values.withColumns({"_by": F.floor(F.col("y") / side), "_bx": F.floor(F.col("x") / side)})
    met = cells.join(F.broadcast(lists) if size <= BROADCAST_BYTES else lists, [time, "_by", "_bx"])
    low = lambda c, k: F.shiftright(c, k).bitwiseAND(F.lit((1 << 20) - 1))
    inside = lambda c: (F.col("y") - low(c, 20)).between(0, patch - 1) & (F.col("x") - low(c, 0)).between(0, patch - 1)
    hits = met.select(time, "v", F.explode(F.filter("_codes", inside)).alias("_code"))
    maxima = hits.groupBy(F.shiftright("_code", 40).alias("epoch"), time).agg(F.max("v").alias("m"))
    every = patches.select("epoch", time).join(maxima, ["epoch", time], "left")
    return every.rollup("epoch").agg(F.count("*").alias("eligible_patches"), *(F.count_if(F.col("m") > t).alias(f"max_gt_{t:g}") for t in thresholds)).withColumn("epoch", F.coalesce(F.col("epoch").cast("string"), F.lit("all")))
