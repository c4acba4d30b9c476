"""Common support: one mask for all methods."""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import ratio


def common_support(*values: str) -> Column:
    """All of them are there."""
    out = F.lit(True)
    for v in values:
        out = out & F.col(v).isNotNull()
    return out


def input_support(target: str, coarse: str, available: str, overlap: str) -> Column:
    """The three-way mask: overlap, target, coarse field and synthetic input are all there."""
    return F.coalesce(F.col(overlap), F.lit(False)) & common_support(target, coarse) & F.coalesce(F.col(available), F.lit(False))


def pair_support(a: str, b: str) -> Column:
    """The two-way mask of the series and extremes."""
    return common_support(a, b)


def require_finite(df: DataFrame, value: str, support: Column) -> DataFrame:
    """``df``, whose evaluation fails if a supported cell lacks the value.

    The count is one aggregated row that is joined to every row, so a failure can't be missed and the
    denominator can't shrink.
    """
    lost = df.agg(F.count_if(support & F.col(value).isNull()).alias("lost"))
    check = lost.select(F.when(F.col("lost") > 0, F.raise_error(F.concat(F.col("lost").cast("string"), F.lit(" non-finite values on common support"))).cast("long")).otherwise(F.col("lost")).alias("lost"))
    return df.crossJoin(F.broadcast(check)).filter("lost = 0").drop("lost")


def support_totals(df: DataFrame, target: str, coarse: str, available: str, overlap: str) -> DataFrame:
    """Cells in the overlap, with target, with all three, and the share."""
    inside = F.coalesce(F.col(overlap), F.lit(False))
    return df.agg(
        F.count_if(inside).alias("overlap_cells"),
        F.count_if(inside & F.col(target).isNotNull()).alias("target_cells"),
        F.count_if(input_support(target, coarse, available, overlap)).alias("support_cells"),
        F.count_if(pair_support(target, coarse)).alias("pair_cells"),
    ).withColumn("support_fraction", ratio(F.col("support_cells"), F.col("target_cells")))


def shared_denominator(metrics: DataFrame, n: str = "n") -> DataFrame:
    """One row: whether all methods were scored on equally many cells."""
    return metrics.agg((F.min(n) == F.max(n)).alias("shared"), F.max(n).alias("n"))


def timestamp_digest(times: DataFrame, time: str) -> str:
    """SHA-256 of the ordered times as little-endian 64-bit numbers (D28): a few thousand times, on the driver."""
    rows = times.select(time).distinct().orderBy(time).toLocalIterator()
    h = hashlib.sha256()
    for r in rows:
        h.update(struct.pack("<q", r[0]))
    return h.hexdigest()


def packed_masks(df: DataFrame, time: str, support: Column, height: int, width: int) -> DataFrame:
    """``(time, bits)``: for each time of ``df`` its supported cells as bits of the whole grid, row by row, eight cells a byte, the first in the highest bit.

    Cells are first summed by byte, so that what is shuffled by time is an eighth of the cells at most; a grid of a million cells has 125 kB a time.
    """
    place = F.col("y").cast("long") * width + F.col("x")
    bit = F.when(support, F.expr("shiftleft(1, cast(7 - _p % 8 as int))")).otherwise(0)
    own = df.withColumn("_p", place).groupBy(time, F.expr("_p div 8").alias("_at")).agg(F.bit_or(bit).alias("_byte"))
    full = F.sequence(F.lit(0).cast("long"), F.lit((height * width + 7) // 8 - 1).cast("long"))
    grouped = own.groupBy(time).agg(F.collect_list(F.struct("_at", "_byte")).alias("_s"))
    every = F.concat("_s", F.transform(F.array_except(full, F.col("_s._at")), lambda k: F.struct(k.alias("_at"), F.lit(0).alias("_byte"))))
    return grouped.select(time, F.unhex(F.array_join(F.transform(F.sort_array(every), lambda s: F.lpad(F.hex(s["_byte"]), 2, "0")), "")).alias("bits"))


def _little_endian(value: Column) -> Column:
    """A number as 8 bytes, the lowest first, in hexadecimal."""
    digits = F.lpad(F.hex(value.cast("long")), 16, "0")
    return F.concat(*(F.substring(digits, 15 - 2 * k, 2) for k in range(8)))


def mask_records(df: DataFrame, time: str, support: Column, height: int, width: int) -> DataFrame:
    """``(time, record)``: a time, its grid's shape (each as 8 bytes, the lowest first) and its packed mask, one after the other."""
    head = F.unhex(F.concat(_little_endian(F.col(time)), _little_endian(F.lit(height)), _little_endian(F.lit(width))))
    return packed_masks(df, time, support, height, width).select(time, F.concat(head, "bits").alias("record"))


def mask_digests(df: DataFrame, time: str, support: Column) -> DataFrame:
    """For each time a digest of its supported cells: equal masks have equal digests, whatever the grid. Packing by row keeps strings short."""
    rows = df.filter(support).groupBy(time, "y").agg(F.array_join(F.sort_array(F.collect_set("x")), ",").alias("row"))
    return rows.groupBy(time).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "row"))), lambda r: F.concat(r["y"].cast("string"), F.lit(":"), r["row"])), ";"), 256).alias("mask_digest"))


def packed_mask_digests(df: DataFrame, time: str, support: Column, height: int, width: int) -> DataFrame:
    """For each time with a supported cell the SHA-256 of its record."""
    some = df.groupBy(time).agg(F.max(support).alias("_some")).filter("_some").select(time)
    return mask_records(df, time, support, height, width).join(some, time, "left_semi").select(time, F.sha2("record", 256).alias("mask_digest"))


def time_digest(time: str) -> Column:
    """Aggregate: ``timestamp_digest`` in Spark, for each group (D28). A group's times are a few thousand at most."""
    digits = lambda t: F.lpad(F.hex(t), 16, "0")
    turned = lambda t: F.concat(*(F.substring(digits(t), 15 - 2 * k, 2) for k in range(8)))
    return F.sha2(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_set(time)), turned), "")), 256)


def run_digests(df: DataFrame, time: str, support: Column, height: int, width: int) -> DataFrame:
    """One row: cells, times and masks of a run and its grid's shape (D28, D29). Masks are told by the digests of their records, in order: some thousand times."""
    masks = packed_mask_digests(df, time, support, height, width).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(time, "mask_digest"))), lambda s: s["mask_digest"]), ""), 256).alias("masks"))
    own = df.filter(support).agg(F.count("*").alias("cells"), time_digest(time).alias("times"), F.lit(f"{height}x{width}").alias("shape"))
    return own.crossJoin(F.broadcast(masks))


def paired_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two runs (``run_digests``) were on equally many cells, the same times, masks and grid."""
    names = ("cells", "times", "masks", "shape")
    other = b.select(*(F.col(c).alias(f"_{c}") for c in names))
    return a.crossJoin(F.broadcast(other)).select("cells", *((F.col(c) == F.col(f"_{c}")).alias(f"same_{c}") for c in names))
