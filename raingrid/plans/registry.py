"""Registered queries over the views: each operator of the inventory on test data, with SQL of its own."""

from __future__ import annotations

import math
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bins, scalar
from ..functions.missing import finite, ratio
from ..operators import contracts, extremes, ingest, predict, quantmap, regrid, sampling, spatial, splits, states, support, timealign, verify, windows
from ..sources import archive, reports, tables
from ..sources.shared import new_path, written
from .oracles import ORACLES
from .views import SIDE, field, grid, series, table

__all__ = ["ORACLES", "QUERIES", "flagship"]

#: Shipment amounts stand in for a float field here: places of rounding in every floating result.
PLACES = 6
COMMON = lambda: support.input_support("truth", "est", "available", "overlap")


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    """Floats to some places (more for means of a few numbers, which may lie half way between two), and integers to long, so that engines can be compared by value."""
    kinds = dict(df.dtypes)
    pick = lambda c: F.round(F.col(c).cast("double"), places) + 0.0 if kinds[c] in ("double", "float") or kinds[c].startswith("decimal") else F.col(c).cast("long") if kinds[c] in ("int", "bigint") else F.col(c)
    return df.select(*(pick(c).alias(c) for c in df.columns))


def hours(spark: SparkSession, d: str, step: int) -> DataFrame:
    return timealign.strict_hourly_sum(series(spark, d, step), [], "t", "v", 3600 // step)


def daily(spark: SparkSession, d: str) -> DataFrame:
    return timealign.daily_mean_of_hourly_means(hours(spark, d, 1800), "hour_end", "amount")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Strict hourly sums, daily means of hours on a day spine, and their centred mean."""
    return rounded(timealign.centred_mean(daily(spark, d), "day", "daily_mean", 7))


def cadence_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Gaps in the order in which months have their steps; some steps are out of place."""
    t = F.col("t")
    times = series(spark, d, 300).select("t", scalar.month_stem(t).alias("month"), F.when(F.floor(t / 300) % 50 == 0, t + 4600).otherwise(t).alias("place"))
    return rounded(timealign.cadence_gaps(times, "t", 300, ["month"], "place"))


def missing_steps(spark: SparkSession, d: str) -> DataFrame:
    return rounded(timealign.missing_steps(series(spark, d, 300), "t", 300))


def time_axis_parity(spark: SparkSession, d: str) -> DataFrame:
    s = series(spark, d, 300)
    return rounded(timealign.same_axis(s, s.filter("v < 250"), "t"))


def hourly_area_means(spark: SparkSession, d: str) -> DataFrame:
    return rounded(timealign.hourly_area_means(grid(spark, d), "t", "est", "truth"), 9)


def support_counts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(support.support_totals(grid(spark, d), "truth", "est", "available", "overlap"))


def mask_digests(spark: SparkSession, d: str) -> DataFrame:
    return support.mask_digests(grid(spark, d), "t", COMMON())


def point_metrics_overall(spark: SparkSession, d: str) -> DataFrame:
    return rounded(verify.overall_metrics(grid(spark, d), COMMON(), "truth", ["est", "syn"], "t"))


def point_metrics_by_time(spark: SparkSession, d: str) -> DataFrame:
    return rounded(verify.point_metrics(grid(spark, d), COMMON(), "truth", "est", by=["t"]), 9)


def event_scores(spark: SparkSession, d: str) -> DataFrame:
    return verify.event_scores(grid(spark, d), COMMON(), "truth", ["est", "syn"])


def csi_by_threshold(spark: SparkSession, d: str) -> DataFrame:
    return rounded(event_scores(spark, d).drop("fss"))


def fss_one_cell(spark: SparkSession, d: str) -> DataFrame:
    return rounded(event_scores(spark, d).select("method", "threshold", "fss"))


def event_scores_by_time(spark: SparkSession, d: str) -> DataFrame:
    return rounded(verify.event_scores(grid(spark, d), COMMON(), "truth", ["est"], (1.0,), by=["t"]).select("t", "hits", "false_alarms", "misses", "csi"))


def strata(registry: str):
    return lambda spark, d: rounded(verify.strata(grid(spark, d), COMMON(), registry, "truth", ["est", "syn"]))


def distribution_summary(spark: SparkSession, d: str) -> DataFrame:
    long = verify.methods(grid(spark, d).filter(COMMON()), "truth", ["truth", "est", "syn"]).select("method", F.col("estimate").alias("v"))
    return rounded(verify.distribution(long, F.lit(True), "v", by=["method"]))


def value_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(verify.value_stats(field(spark, d), "v"))


def stat_ranges(spark: SparkSession, d: str) -> DataFrame:
    stats = verify.value_stats(grid(spark, d), "est", by=["t"], small=True)
    return rounded(verify.stat_ranges(stats, ["finite", "missing_fraction", "max"]))


def log_histogram(spark: SparkSession, d: str) -> DataFrame:
    long = verify.methods(grid(spark, d).filter(COMMON()), "truth", ["truth", "est"]).select("method", F.col("estimate").alias("v"))
    return rounded(extremes.log_histogram(long, "v", "method").select("method", "bin", "n"))


def bin_cells(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d).filter(support.pair_support("truth", "est"))
    return rounded(extremes.bin_cells(verify.methods(g, "truth", ["truth", "est"]), "heavy", "estimate", "method"))


def hourly_maxima(spark: SparkSession, d: str) -> DataFrame:
    return rounded(extremes.hourly_maxima(grid(spark, d), support.pair_support("truth", "est"), ["est", "truth"]))


def exceedance_hours(spark: SparkSession, d: str) -> DataFrame:
    return rounded(extremes.exceedance_hours(extremes.hourly_maxima(grid(spark, d), support.pair_support("truth", "est"), ["est", "truth"]), ["est", "truth"]))


def masked_log_l1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(verify.masked_log_l1(grid(spark, d), COMMON(), "truth", "est"))


def method_deltas(spark: SparkSession, d: str) -> DataFrame:
    return rounded(verify.deltas(point_metrics_overall(spark, d), "method", "est", ["mae", "rmse", "bias"]))


def mae_winner(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d).filter(COMMON())
    per = g.groupBy("t").agg(F.avg(F.abs(F.col("est") - F.col("truth"))).alias("a"), F.avg(F.abs(F.col("syn") - F.col("truth"))).alias("b"))
    return rounded(per.select(verify.mae_winner(F.round("a", 9), F.round("b", 9), "est", "syn").alias("winner")).groupBy("winner").agg(F.count("*").alias("hours")))


BLOCKS = (1, 2, 3, 5)


def _block_spine(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(b,) for b in BLOCKS], "block int"))


def block_metrics_multiscale(spark: SparkSession, d: str) -> DataFrame:
    means = spatial.block_means_of(grid(spark, d), COMMON(), ["truth", "est"], BLOCKS, SIDE, SIDE)
    own = means.groupBy("block").agg(*verify.point_aggregates("truth", "est", "t"), *verify.event_aggregates("truth", "est", 1.0))
    return rounded(_block_spine(spark).join(own, "block", "left").fillna(0, ["n", "valid_hours", "hits", "false_alarms", "misses"]))


def block_coverage(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d)
    own = spatial.block_means_of(g, COMMON(), ["truth"], BLOCKS, SIDE, SIDE).groupBy("block").agg(F.count("*").alias("valid_cells"), F.avg("support_fraction").alias("mean_support"))
    possible = _block_spine(spark).crossJoin(g.agg(F.count_distinct("t").alias("times"))).select("block", (F.col("times") * F.floor(SIDE / F.col("block")) * F.floor(SIDE / F.col("block"))).alias("possible_cells"))
    out = possible.join(own, "block", "left").fillna(0, ["valid_cells"])
    return rounded(out.withColumn("valid_cells_fraction", ratio(F.col("valid_cells"), F.col("possible_cells"))))


def disk_neighbourhood_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spatial.disk_scores_of(grid(spark, d), COMMON(), "truth", "est", 1.0, (1, 2, 3), SIDE, SIDE, core=SIDE))


def _mapping(spark: SparkSession) -> DataFrame:
    fine = spark.range(225).select(F.floor(F.col("id") / 15).cast("int").alias("y"), (F.col("id") % 15).cast("int").alias("x"))
    fine = fine.withColumns({"lat": F.col("y") / 2.0, "lon": F.col("x") / 2.0})
    return regrid.bilinear_map(fine, (0.0, 1.0, 8), (0.0, 1.0, 8), ingest.in_box("lat", "lon", 0.5, 7.0, 0.0, 6.5))


def regrid_bilinear(spark: SparkSession, d: str) -> DataFrame:
    return rounded(regrid.regrid_bilinear(field(spark, d), _mapping(spark), 8))


def regrid_beyond(spark: SparkSession, d: str) -> DataFrame:
    """Fields on a fine grid that reaches beyond the coarse axes on all sides, with no mask of its own: cells out there have no value and no row."""
    fine = spark.range(100).select(F.floor(F.col("id") / 10).cast("int").alias("y"), (F.col("id") % 10).cast("int").alias("x"))
    fine = fine.withColumns({"lat": F.col("y") - 1.25, "lon": F.col("x") - 1.5})
    mapping = regrid.bilinear_map(fine, (0.0, 1.0, 8), (0.0, 1.0, 8), F.lit(True))
    return rounded(regrid.regrid_bilinear(field(spark, d).filter("i + j < 14"), mapping, 8))


def regrid_mask(spark: SparkSession, d: str) -> DataFrame:
    return rounded(regrid.bilinear_mask(field(spark, d), _mapping(spark), 8).groupBy("t").agg(F.count_if("valid").alias("valid_cells"), F.count("*").alias("cells")))


def regrid_area_average(spark: SparkSession, d: str) -> DataFrame:
    fine = field(spark, d).select("t", F.col("i").alias("y"), F.col("j").alias("x"), "v")
    return rounded(regrid.area_average(fine, regrid.overlap_lengths(spark, 8, 3, "y", "i"), regrid.overlap_lengths(spark, 8, 3, "x", "j"), least=0.95))


PATCH, STRIDE = 5, 2


def _supported_counts(spark: SparkSession, d: str) -> DataFrame:
    return spatial.patch_sums(grid(spark, d), COMMON().cast("int"), PATCH, STRIDE, SIDE, SIDE)


def patch_eligibility(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_supported_counts(spark, d).filter("value >= 13"))


def patch_prefix_sums(spark: SparkSession, d: str) -> DataFrame:
    own = grid(spark, d).withColumn("on", COMMON().cast("int"))
    return rounded(spatial.prefix_patch_sums(own, "on", PATCH, STRIDE, SIDE, SIDE).filter("value > 0"))


def _chosen(spark: SparkSession, d: str) -> DataFrame:
    eligible = _supported_counts(spark, d).filter("value >= 13")
    return sampling.choose_patch(eligible, 7, 0).unionByName(sampling.choose_patch(eligible, 7, 1))


def patch_choice(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_chosen(spark, d))


def patch_exceedance(spark: SparkSession, d: str) -> DataFrame:
    cells = grid(spark, d).filter(COMMON()).select("t", "y", "x", F.col("truth").alias("v"))
    return rounded(extremes.patch_exceedance(written(_chosen(spark, d).select("epoch", "t", "patch_y", "patch_x"), "patches"), cells, PATCH))


def pixel_sample(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sampling.pixel_sample(grid(spark, d).filter(COMMON()).select("t", "y", "x", "truth"), 3, most=16, least=4, share=5))


def _order_hours(spark: SparkSession, d: str) -> DataFrame:
    t = F.floor(scalar.epoch_seconds("o_orderdate") / 3600) * 3600
    return table(spark, d, "orders").select(t.alias("t")).distinct()


def qc_sample(spark: SparkSession, d: str) -> DataFrame:
    times = _order_hours(spark, d).withColumn("month", scalar.month_stem(F.col("t")))
    return rounded(sampling.qc_sample(times, 20260927, 100, "t", "month"))


def epoch_order(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sampling.epoch_order(series(spark, d, 1800), 5, 2))


def epoch_order_all(spark: SparkSession, d: str) -> DataFrame:
    """All times with their places, without a sort of all of them."""
    return rounded(sampling.epoch_places(series(spark, d, 1800), 5, 2))


def chronological_splits(spark: SparkSession, d: str) -> DataFrame:
    return rounded(splits.chronological_splits(series(spark, d, 1800)))


def split_checks(spark: SparkSession, d: str) -> DataFrame:
    own = splits.chronological_splits(series(spark, d, 1800))
    shared = splits.overlap_of_splits(own).agg(F.count("*").alias("shared_days"))
    return rounded(splits.split_summary(own).crossJoin(F.broadcast(shared)))


def split_filter(spark: SparkSession, d: str) -> DataFrame:
    s = series(spark, d, 1800)
    return rounded(splits.in_split(s, splits.chronological_splits(s), "test").agg(F.count("*").alias("steps"), F.sum("v").alias("total")))


def split_classify(spark: SparkSession, d: str) -> DataFrame:
    s = series(spark, d, 1800)
    own = splits.chronological_splits(s.filter(F.col("t") % 7200 == 0))
    return rounded(splits.classify(s, own).groupBy("split").agg(F.count("*").alias("steps")))


LEVELS = 129


def _train(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The cells, and the knots of a sample of each training hour: exact quantiles then see a bounded number of cells an hour."""
    g = grid(spark, d).filter(COMMON())
    sample = sampling.pixel_sample(g.filter(F.col("t") % 4 != 0).select("t", "y", "x", "est", "truth"), 11, fixed=32)
    return g, quantmap.fit_quantile_map(sample, "est", "truth", LEVELS)


def quantile_map_fit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_train(spark, d)[1])


def quantile_map_apply(spark: SparkSession, d: str) -> DataFrame:
    g, knots = _train(spark, d)
    return rounded(quantmap.apply_quantile_map(g.filter(F.col("t") % 4 == 0), "est", knots).select("t", "y", "x", "mapped"))


def quantile_map_delta(spark: SparkSession, d: str) -> DataFrame:
    g, knots = _train(spark, d)
    own = quantmap.apply_quantile_map(g.filter(F.col("t") % 4 == 0), "est", knots)
    e = own.agg(F.avg(F.abs(F.col("mapped") - F.col("truth"))).alias("a"), F.avg(F.abs(F.col("est") - F.col("truth"))).alias("b"), F.avg(F.col("mapped") - F.col("truth")).alias("bias"))
    return rounded(e.select((F.col("a") - F.col("b")).alias("delta_mae"), F.col("bias").alias("bias_mapped")))


def typical_hours(spark: SparkSession, d: str) -> DataFrame:
    stats = grid(spark, d).filter(COMMON()).groupBy("t").agg(F.count("*").alias("cells"), F.max("truth").alias("max"), F.avg((F.col("truth") > 0.1).cast("double")).alias("wet_fraction"))
    return rounded(sampling.typical_hours(stats).drop("place"))


def preview_hour(spark: SparkSession, d: str) -> DataFrame:
    """The hour with the largest total, the first of equal ones."""
    totals = grid(spark, d).groupBy("t").agg(F.round(F.sum("truth"), 6).alias("total"))
    return rounded(totals.agg(F.max(F.struct("total", (-F.col("t")).alias("m"))).alias("b")).select((-F.col("b.m")).alias("t"), F.col("b.total").alias("total")))


def first_per_month(spark: SparkSession, d: str) -> DataFrame:
    times = _order_hours(spark, d).withColumn("month", scalar.month_stem(F.col("t")))
    return rounded(sampling.first_per_month(times, "t", "month"))


def month_counts(spark: SparkSession, d: str) -> DataFrame:
    """Days and hours of each month, and those without any."""
    times = _order_hours(spark, d).withColumns({"month": scalar.month_stem(F.col("t")), "day": scalar.day_of(F.col("t"))})
    own = times.groupBy("month").agg(F.count_distinct("day").alias("days"), F.count("*").alias("hours"), F.min("t").alias("first"), F.max("t").alias("last"), F.max(F.dayofmonth(F.last_day("day"))).alias("days_in_month"))
    return rounded(own.withColumn("complete", F.col("days") == F.col("days_in_month")))


def projection_inverse(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", ((F.col("p_partkey") % 900 - 450) * 1000.0).alias("px"), (-(F.col("p_partkey") % 1100) * 1000.0 - 3600000).alias("py"))
    lon, lat = scalar.stereographic_inverse(F.col("px"), F.col("py"))
    return rounded(p.select("p_partkey", lon.alias("lon"), lat.alias("lat"), scalar.wrap_longitude(lon + 350).alias("wrapped")))


def unit_scale(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(((F.col("p_partkey") % 900 - 450) * 1.0).alias("px"), (-(F.col("p_partkey") % 1100) - 3600.0).alias("py"))
    lon, lat = scalar.stereographic_inverse(F.col("px") * 1000, F.col("py") * 1000)
    return rounded(regrid.unit_scale(p.withColumns({"lon": lon + 0.001, "lat": lat})))


def normalised_field(spark: SparkSession, d: str) -> DataFrame:
    """Aliases, units, fill values, a turned axis, a box and a clip in one projection."""
    raw = field(spark, d).select(F.col("t").alias("valid_time"), F.col("i").alias("lat_idx"), F.col("j").alias("lon_idx"), F.coalesce("v", F.lit(999.0)).alias("tp"), (F.col("i") * 0.25).alias("latitude"), (F.col("j") * 0.25).alias("lon"))
    own = ingest.resolve_aliases(raw).withColumn("units", F.when(F.col("lon_idx") % 2 == 0, F.lit("m")).otherwise(F.lit("kg m^-2")))
    own = ingest.ascending(own, "lat_idx", 8).withColumn("v", ingest.to_millimetres(ingest.fill_to_null(F.col("precipitation")), F.col("units")))
    own = ingest.bounding_crop(own, ingest.in_box("latitude", "longitude", 0.25, 1.5, 0.5, 1.75), "lat_idx", "lon_idx")
    return rounded(ingest.thinned(own, 2, "lat_idx", "lon_idx").select("time", "lat_idx", "lon_idx", scalar.non_negative(F.col("v")).alias("v")))


def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    """Logs, times, labels and names."""
    t = scalar.epoch_seconds("o_orderdate")
    name = F.concat(F.lit("data/YW_2017.002_"), F.date_format(F.add_months(scalar.day_of(t), 120), "yyyyMMdd"), F.lit(".nc"))
    o = table(spark, d, "orders").select(
        "o_orderkey", scalar.log_amount(F.col("o_totalprice") - 1000).alias("logged"), scalar.from_log(F.col("o_totalprice") / 100000).alias("back"), scalar.iso_utc(t).alias("iso"), scalar.iso_utc(t, "Z").alias("iso_z"),
        scalar.month_stem(t).alias("month"), scalar.member_date(name).alias("member_day"), scalar.unit_name(F.concat(F.lit(" "), "o_orderpriority", F.lit("^-2 "))).alias("unit"), scalar.file_safe(F.col("o_orderpriority")).alias("safe"),
        scalar.metre_wkt(F.concat(F.lit('CRS["'), "o_orderstatus", F.lit('",LENGTHUNIT["metre",1000'), F.when(F.col("o_orderkey") % 2 == 0, ".00").otherwise(""), F.lit("]]"))).alias("wkt"),
    )
    return rounded(o)


def disk_kernel(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the disks of all radii that parts have, in cells."""
    r = F.col("radius")
    radii = table(spark, d, "part").select((F.col("p_size") % 26).cast("long").alias("radius")).distinct()
    rows = radii.withColumn("dy", F.explode(F.sequence(-r, r))).withColumn("dx", F.explode(F.sequence(-r, r)))
    return rounded(rows.filter(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx") <= r * r).groupBy("radius").agg(F.count("*").alias("cells")))


def geometric_edges(spark: SparkSession, d: str) -> DataFrame:
    """The histogram's bin of each quantity and the edges round it."""
    step = math.log(extremes.HIGH / extremes.LOW) / (extremes.BINS - 1)
    own = table(spark, d, "lineitem").select(F.col("l_quantity").alias("amount")).distinct()
    k = F.floor(F.log(F.col("amount") / extremes.LOW) / step)
    return rounded(own.select("amount", k.alias("k"), *((F.lit(extremes.LOW) * F.exp((k + n) * F.lit(step))).alias(name) for n, name in enumerate(("low", "high")))))


def contract_report(spark: SparkSession, d: str) -> DataFrame:
    g, s = grid(spark, d), series(spark, d, 300)
    own = splits.chronological_splits(series(spark, d, 1800))
    cells = g.select("y", "x").distinct().withColumn("lat", F.col("y") / 4.0)
    days = own.select(F.col("date_utc").alias("day")).distinct()
    timeline = series(spark, d, 1800).agg(F.count_distinct("t").alias("n"))
    rows = [
        *contracts.complete_timeline(s, "t", 300),
        contracts.no_negatives(g, "truth"),
        contracts.equal_grids(cells, cells.withColumn("lat", F.col("lat") + 1e-9), ["y", "x"], ["lat"]),
        contracts.required_columns(g, ["t", "y", "x", "truth", "lat"]),
        contracts.expect(verify.methods(g.filter(COMMON()), "truth", ["est", "syn"]).groupBy("method").agg(F.count("estimate").alias("n")), "L6 shared denominator", F.max("n") - F.min("n"), 0),
        contracts.expect(splits.split_summary(own).crossJoin(F.broadcast(timeline)), "L10 hours in all splits", F.sum("hours"), F.max("n")),
        *contracts.archive_complete(days.filter("dayofmonth(day) <> 13"), days, "day"),
    ]
    return rounded(contracts.report(rows))


def grid_contracts(spark: SparkSession, d: str) -> DataFrame:
    """Orientation and box of the grid that the cells make, and of one that is turned round (L4)."""
    g = grid(spark, d).groupBy("y", "x").agg(F.max(F.col("overlap").cast("int")).cast("boolean").alias("overlap"))
    g = g.withColumns({"py": F.col("y") * 1000.0, "px": F.col("x") * 1000.0, "lat": 47 + F.col("y") * 0.5 + F.col("x") * 0.01, "lon": 5 + F.col("x") * 0.5 - F.col("y") * 0.01})
    turned = g.withColumns({"py": -F.col("py"), "lat": 60 - F.col("lat"), "lon": F.when((F.col("y") == 3) & (F.col("x") == 4), 99.0).otherwise(F.col("lon"))})
    rows = [r.withColumn("grid", F.lit(name)) for name, own in (("whole", written(g, "grid")), ("turned", written(turned, "grid"))) for r in contracts.grid_orientation(own, (46.5, 55.0, 2.0, 16.0))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return rounded(out)


def declared_columns(spark: SparkSession, d: str) -> DataFrame:
    """What a cube that was written says of its columns, against what must be, and how many rows it has (A1, A3, L2)."""
    cube, path = _as_cube(spark, d), new_path(spark, "cube")
    contracts.with_units(cube, truth="mm", est="m").write.parquet(path)
    read = spark.read.parquet(path)
    told = contracts.declared(read, ["time_epoch", "y", "x"], {"truth": "mm", "est": "mm", "syn": "mm"})
    return rounded(told.crossJoin(F.broadcast(read.agg(F.count("*").alias("cells")))))


def coverage_filter(spark: SparkSession, d: str) -> DataFrame:
    """Coarse weekly cells with enough seen of them."""
    g = grid(spark, d)
    per = g.groupBy("t").agg(F.avg("est").alias("v"), ratio(F.count("est"), F.count("*")).alias("fraction"))
    return rounded(per.select("t", ingest.enough_coverage(F.col("v"), F.round("fraction", 9), 0.9).alias("v")), 9)


def typical_per_bin(spark: SparkSession, d: str) -> DataFrame:
    """A typical hour for each bin, all different (F2)."""
    rows = sampling.typical_per_bin(grid(spark, d).filter(COMMON()), "diagnostics", "truth")
    return spark.createDataFrame(rows, "bin_label string, t long")


def tiled_inference(spark: SparkSession, d: str) -> DataFrame:
    """A 3 x 3 mean as the model over tiles with a halo of one cell (K3)."""

    def make():
        def mean(f: np.ndarray) -> np.ndarray:
            p = np.pad(f.astype(np.float64), 1)
            return sum(p[a : a + f.shape[0], b : b + f.shape[1]] for a in range(3) for b in range(3)) / 9

        return mean

    own = field(spark, d).select("t", F.col("i").alias("y"), F.col("j").alias("x"), "v")
    return rounded(predict.infer_tiled(own, make, "v", core=4, halo=1, height=8, width=8))


def stream_hourly_sum(spark: SparkSession, d: str) -> DataFrame:
    """The batch query's hours from a stream of the same events."""
    from ..streaming.hourly import run_to_table, stream_hourly_sum as stream
    from ..streaming.replay import steps_as_stream

    source, folder = steps_as_stream(series(spark, d, 1800).filter("v is not null"))
    return rounded(run_to_table(stream(source, [], "ts", "v", 2), folder).select(F.unix_seconds(F.col("hour_end")).alias("hour_end"), "amount", "steps"))


def float_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Shares over thresholds of amounts of float precision, some of them a float's tenth (B12, Z-3)."""
    g = grid(spark, d).filter(COMMON()).select((F.col("est") / 10).cast("float").alias("v"))
    return rounded(verify.distribution(g, F.lit(True), "v").select("n", "fraction_gt_0_1", "fraction_gt_1", "fraction_gt_5"))


def axis_steps(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d)
    lat = g.select("y").distinct().withColumn("lat", 50 + F.col("y") * 0.25 + (F.col("y") % 5) * 0.01)
    lon = g.select("x").distinct().withColumn("lon", 2 + F.col("x") * 0.4)
    own = regrid.axis_step(lat, "y", "lat").withColumn("axis", F.lit("lat")).unionByName(regrid.axis_step(lon, "x", "lon").withColumn("axis", F.lit("lon")))
    return rounded(own)


def axis_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Places of values on an axis of unequal steps (C4)."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * F.col("n_nationkey") / 40.0).alias("at"))
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 1700 / 100.0 - 1).alias("v"))
    return rounded(regrid.axis_lookup(p, "v", n, "k", "at").select("p_partkey", "place", "beyond"))


def field_reader(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the aligned and of the synthetic table by time (A21): their sums by hour."""
    g = grid(spark, d)
    own = timealign.read_fields(g.select("t", "y", "x", "truth", "est"), g.select("t", "y", "x", "syn"), ["y", "x"])
    return rounded(own.groupBy("t").agg(F.count("*").alias("cells"), F.sum("truth").alias("truth"), F.sum("est").alias("est"), F.sum("syn").alias("syn")))


def split_coverage(spark: SparkSession, d: str) -> DataFrame:
    s = series(spark, d, 1800)
    own = splits.chronological_splits(s.filter(F.col("t") % 12600 != 0))
    return rounded(splits.split_coverage(s.filter("v is not null"), own))


def preflight(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the coarse field in the first hour of each month, and whether there is one."""
    g = grid(spark, d)
    times = g.select("t").distinct().withColumn("month", scalar.month_stem(F.col("t") * 604800))
    return rounded(contracts.preflight(g, sampling.first_per_month(times, "t", "month"), "est", "t"))


def loss_agrees(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d)
    return rounded(verify.loss_agrees(verify.masked_log_l1(g, COMMON(), "truth", "est", by=["t"]), "loss", "n", verify.masked_log_l1(g, COMMON(), "truth", "est"), "loss"))


def early_stopping(spark: SparkSession, d: str) -> DataFrame:
    """Weeks as epochs, their losses as validation losses."""
    losses = verify.masked_log_l1(grid(spark, d), COMMON(), "truth", "est", by=["t"]).select("t", F.round("loss", 9).alias("loss"))
    return rounded(verify.early_stopping(losses, "t", "loss", 5), 9)


def timestamp_digests(spark: SparkSession, d: str) -> DataFrame:
    """Digests of the times of each split."""
    own = splits.chronological_splits(series(spark, d, 1800))
    return own.groupBy("split").agg(support.time_digest("t").alias("times"))


def packed_mask_digests(spark: SparkSession, d: str) -> DataFrame:
    """Digests of each week's time, grid and packed mask."""
    return support.packed_mask_digests(grid(spark, d), "t", COMMON(), SIDE, SIDE)


def paired_report(spark: SparkSession, d: str) -> DataFrame:
    """A run, and one whose cells were put together from two tables, on the same support; and one that leaves the synthetic input out."""
    g = grid(spark, d)
    apart = timealign.read_fields(g.select("t", "y", "x", "truth", "available", "overlap"), g.select("t", "y", "x", "est"), ["y", "x"])
    a, b, c = (support.run_digests(own, "t", on, SIDE, SIDE) for own, on in ((g, COMMON()), (apart, COMMON()), (g, support.pair_support("truth", "est"))))
    both = support.paired_report(a, b).withColumn("pair", F.lit("same")).unionByName(support.paired_report(a, c).withColumn("pair", F.lit("other")))
    return both.drop("same_shape")


def fields_by_time(spark: SparkSession, d: str) -> DataFrame:
    """The aligned and the synthetic cube written by buckets of time, joined and summed by time without a shuffle of cells."""
    g = grid(spark, d)
    own, path = [], new_path(spark, "cubes")
    for name, columns in (("aligned", ("truth", "est")), ("synthetic", ("syn",))):
        table_name = f"{name}_{path.split('raingrid-')[-1][:32]}"
        own.append(tables.write_by_time(g.select("t", "y", "x", *columns), table_name, f"{path}/{name}", "t", 8))
    both = tables.join_by_time(*own, ["y", "x"], "t")
    return rounded(both.groupBy("t").agg(F.count("*").alias("cells"), F.sum("truth").alias("truth"), F.sum("est").alias("est"), F.sum("syn").alias("syn")))


def split_months(spark: SparkSession, d: str) -> DataFrame:
    """The test split of a cube by months, of which other months aren't read."""
    cube, path, manifest = _as_cube(spark, d), new_path(spark, "cube"), new_path(spark, "splits")
    tables.write_months(cube, path)
    reports.write_manifest(splits.chronological_splits(cube.select("time_epoch"), "time_epoch"), manifest)
    own = splits.in_split_of_cube(spark.read.parquet(path), reports.read_manifest(spark, manifest, "test"), "test")
    return rounded(own.groupBy(F.col("month").cast("string").alias("month")).agg(F.count("*").alias("cells"), F.sum("truth").alias("truth")))


def bin_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of sampled pairs of truth and estimate in cells of the plane."""
    sample = sampling.pixel_sample(grid(spark, d).filter(COMMON()).select("t", "y", "x", "truth", "est"), 17, fixed=16)
    return rounded(verify.bin_counts(sample, "est", "truth", 0.5, 0.5))


def validation_by_epoch(spark: SparkSession, d: str) -> DataFrame:
    """Validation statistics, weeks modulo 3 as epochs."""
    g = grid(spark, d).withColumn("epoch", F.col("t") % 3)
    return rounded(verify.validation_stats(g, COMMON(), "validation", "truth", "est", "epoch"))


def training_patches(spark: SparkSession, d: str) -> DataFrame:
    """Patches chosen for two epochs as arrays, told by their masks and sums."""
    own = predict.training_patches(_chosen(spark, d).select("epoch", "t", "patch_y", "patch_x"), grid(spark, d).withColumn("on", COMMON()), "est", "truth", "on", PATCH)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v.cast("double"))
    bits = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), "")
    return rounded(own.select("epoch", "t", "patch_y", "patch_x", bits("available").alias("available"), bits("mask").alias("mask"), total("input").alias("input"), total("amount").alias("amount")), 4)


def _as_cube(spark: SparkSession, d: str) -> DataFrame:
    """The grid as rows of a cube: weeks as epoch seconds, what is missing as NaN."""
    g = grid(spark, d)
    return g.select((F.col("t") * 604800).alias("time_epoch"), "y", "x", "truth", F.coalesce("est", F.lit(float("nan"))).alias("est"))


def cube_by_months(spark: SparkSession, d: str) -> DataFrame:
    """A cube written by month, a second write that leaves its months alone, and its scan."""
    cube, path = _as_cube(spark, d), new_path(spark, "cube")
    tables.write_months(cube.filter(F.col("time_epoch") % 3 == 0), path)
    tables.write_months(cube.filter(F.col("time_epoch") % 3 == 0).withColumn("truth", F.lit(-1.0)), path)
    tables.write_months(cube, path, overwrite=True)
    tables.write_months(cube.withColumn("truth", F.lit(-2.0)), path)
    own = tables.scan(spark, path, ["truth", "est"]).groupBy("month").agg(F.count("*").alias("cells"), F.count("est").alias("seen"), F.sum("truth").alias("truth"), F.sum("est").alias("est"))
    return rounded(own.withColumn("month", F.col("month").cast("string")))


def cube_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Months asked for against the files that are there; one month is not."""
    cube, path = _as_cube(spark, d), new_path(spark, "cube")
    tables.write_months(cube, path)
    months = cube.select(scalar.month_stem(F.col("time_epoch")).alias("month")).distinct().unionByName(spark.createDataFrame([("1900_01",)], "month string"))
    audit = tables.month_audit(tables.inventory(spark, path, "*.parquet"), months, r"month=(\d{4}_\d{2})/")
    kept = audit.select("month", F.when(F.col("files") > 0, 1).otherwise(0).alias("there"), F.col("bytes") > 0, F.col("ok")).toDF("month", "there", "bytes", "ok")
    whole = contracts.monthly_files(audit, 24).select(F.col("contract").alias("month"), F.col("found").cast("int").alias("there"), F.lit(True).alias("bytes"), "ok")
    return rounded(kept.unionByName(whole))


def regrid_map_table(spark: SparkSession, d: str) -> DataFrame:
    """The regrid of a map that was written and loaded."""
    path = new_path(spark, "map")
    tables.write_map(_mapping(spark), path)
    return rounded(regrid.regrid_bilinear(field(spark, d), tables.load_bilinear_map(spark, path), 8))


def split_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Times of a split's manifest by day."""
    path = new_path(spark, "splits")
    reports.write_manifest(splits.chronological_splits(series(spark, d, 1800)).withColumnRenamed("t", "time_epoch"), path)
    return rounded(reports.read_manifest(spark, path, "test").groupBy("date_utc").agg(F.count("*").alias("steps"), F.min("time_epoch").alias("first")))


def report_files(spark: SparkSession, d: str) -> DataFrame:
    """Point metrics as CSV and as JSON, read again."""
    metrics, csv, json = point_metrics_overall(spark, d), new_path(spark, "csv"), new_path(spark, "json")
    kinds = ", ".join(f"{n} {t}" for n, t in metrics.dtypes)
    reports.write_csv(metrics, csv, ["method"])
    reports.write_json(metrics, json)
    both = reports.read_csv(spark, csv, kinds).withColumn("source", F.lit("csv")).unionByName(reports.read_json(spark, json, kinds).withColumn("source", F.lit("json")))
    return rounded(both)


def finite_values(spark: SparkSession, d: str) -> DataFrame:
    """Amounts of which some are NaN or infinite, by what is left (H3)."""
    k = F.col("l_orderkey")
    v = F.when(k % 5 == 0, F.lit(float("nan"))).when(k % 7 == 0, F.lit(float("inf"))).when(k % 11 == 0, F.lit(float("-inf"))).otherwise(F.col("l_quantity"))
    own = table(spark, d, "lineitem").select((k % 3).alias("part"), finite(v).alias("v"))
    return rounded(own.groupBy("part").agg(F.count("*").alias("n"), F.count("v").alias("finite"), F.sum("v").alias("total"), F.max("v").alias("max")))


def tile_layout(spark: SparkSession, d: str) -> DataFrame:
    """Cells to tiles and back."""
    tiled = predict.to_tiles(grid(spark, d), "truth", 5)
    per = tiled.groupBy("t").agg(F.count("*").alias("tiles"))
    back = predict.from_tiles(tiled, "truth").groupBy("t").agg(F.count("*").alias("cells"), F.sum((F.col("y") * 100 + F.col("x")) * F.col("truth")).alias("moment"))
    return rounded(per.join(back, "t"))


def _write_archives(steps: DataFrame, folder: str) -> DataFrame:
    """A tar.gz a week with a member a day (times and amounts as bytes) in a folder; their paths. A week has at most 2,016 steps."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        import io
        import tarfile

        path = f"{folder}-{int(rows['t'].iloc[0]) // 604800}.tar.gz"
        with archive.open_file(path, write=True) as stream, tarfile.open(fileobj=stream, mode="w|gz") as out:
            for day, own in rows.sort_values("t").groupby(rows["t"] // 86400):
                data = own["t"].to_numpy("<i8").tobytes() + own["v"].to_numpy("<f8").tobytes()
                member = tarfile.TarInfo(f"data/YW_2017.002_{pd.Timestamp(int(day), unit='D'):%Y%m%d}.nc")
                member.size = len(data)
                out.addfile(member, io.BytesIO(data))
        return pd.DataFrame({"path": [path]})

    return steps.groupBy(F.floor(F.col("t") / 604800)).applyInPandas(pack, "path string")


def _read_member(path: str):
    data = np.fromfile(path, "<i8")
    n = len(data) // 2
    for low in range(0, n, 100):
        v = pd.Series(data[n:].view("<f8")[low : min(low + 100, n)])
        yield pd.DataFrame({"t": data[low : min(low + 100, n)], "v": v})


def archive_days(spark: SparkSession, d: str) -> DataFrame:
    """Weekly archives of daily members, read as a stream, put together and decoded: steps and amounts of each day."""
    paths = [r["path"] for r in _write_archives(series(spark, d, 300), new_path(spark, "archives")).collect()]  # one row an archive
    days = series(spark, d, 300).select(scalar.day_of(F.col("t")).alias("day")).distinct()
    # each archive is unpacked once; what its members hold is written, and all else is told from that
    rows = written(archive.decoded(archive.members(spark, paths, contents=True), _read_member, "t long, v double"), "steps")
    audit = archive.archive_audit(rows.select("archive", "place", "member", "day").distinct(), days)
    own = rows.groupBy("day").agg(F.count("*").alias("steps"), F.count("v").alias("seen"), F.sum("v").alias("total"))
    sample = archive.first_of_years(rows).select("day", F.lit(True).alias("sampled")).distinct()
    return rounded(audit.join(own, "day", "left").join(sample, "day", "left").fillna(False, ["sampled"]))


def _half_hours(spark: SparkSession, d: str) -> DataFrame:
    """Every half hour of the days that have steps, with its amount if it has one."""
    own = series(spark, d, 1800)
    days = own.select(F.floor(F.col("t") / 86400).alias("day")).distinct()
    return days.select(F.explode(F.sequence(F.col("day") * 86400, F.col("day") * 86400 + 84600, F.lit(1800))).alias("t")).join(own, "t", "left")


def archive_stream_hours(spark: SparkSession, d: str) -> DataFrame:
    """Weekly archives as a stream, a few in a batch, decoded and summed to whole hours by keyed state."""
    from ..streaming import archives
    from ..streaming.hourly import run_to_table

    folder = new_path(spark, "archives")
    _write_archives(_half_hours(spark, d), folder).write.format("noop").mode("overwrite").save()
    # weeks are written in any order, so one batch takes them all; a stream of a growing folder takes one at a time
    stream = archives.archive_stream(spark, os.path.dirname(folder), per_batch=1 << 20)
    steps = archives.decoded_archives(stream, _read_member, "t long, v double").withColumn("series", F.lit("YW"))
    own = run_to_table(archives.strict_hours(steps, ["series"], step=1800), new_path(spark, "stream"))
    return rounded(own.select("hour_end", "amount", "seen"))


def indexed_days(spark: SparkSession, d: str) -> DataFrame:
    """The days of one month from archives by an index of their members (A2, A5): only archives that hold such days are opened."""
    paths = [r["path"] for r in _write_archives(series(spark, d, 300), new_path(spark, "archives")).collect()]  # one row an archive
    index = archive.update_index(spark, paths, new_path(spark, "index"))
    own = archive.decoded(archive.indexed_members(index.filter(F.month("day") == 2)), _read_member, "t long, v double")
    return rounded(own.groupBy("day").agg(F.count("*").alias("steps"), F.count("v").alias("seen"), F.sum("v").alias("total")))


def axis_merge(spark: SparkSession, d: str) -> DataFrame:
    """Prices of items among the distinct totals of orders, an axis that grows with the table (C4, C11)."""
    axis = table(spark, d, "orders").select(F.col("o_totalprice").alias("at")).distinct().withColumn("k", F.col("at"))
    own = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rounded(regrid.axis_merge(own, "l_extendedprice", axis, "k", "at").select("l_orderkey", "l_linenumber", "place", "beyond"))


def scores_from_states(spark: SparkSession, d: str) -> DataFrame:
    """Point metrics from states of a cube by months that came in two runs."""
    path, kept = new_path(spark, "cube"), new_path(spark, "states")
    cube = grid(spark, d).withColumn("time_epoch", F.col("t") * 604800)
    for part in (cube.filter(F.col("time_epoch") < 820_454_400), cube):
        tables.write_months(part, path)
        own = states.update_states(spark.read.parquet(path), kept, COMMON(), "truth", ["est", "syn"], "time_epoch")
    events = states.event_scores(own).filter("threshold = 1").select("method", "hits", "csi")
    return rounded(states.point_scores(own).join(events, "method"))


def source_windows(spark: SparkSession, d: str) -> DataFrame:
    """Patches and tiles with context of every field, regridded only there, told by their masks and moments."""
    f, t = field(spark, d), F.col("t")
    moment = F.aggregate(F.arrays_zip("input", F.sequence(F.lit(1), F.size("input")).alias("k")), F.lit(0.0), lambda s, e: s + e["input"].cast("double") * e["k"])
    out = []
    for mode, side, own in (
        ("patch", 5, windows.patch_windows(f.select("t").distinct().select("t", (t % 12).cast("int").alias("patch_y"), (t * 7 % 13).cast("int").alias("patch_x")), 5)),
        ("tile", 10, windows.context_windows(f.select("t").distinct().select("t", (t % 3 * 6).cast("int").alias("top"), (t * 2 % 3 * 6).cast("int").alias("left")), 6, 2, 15, 15)),
    ):
        got = windows.coarse_inputs(own, f, _mapping(spark), ["t"], side, 8)
        out.append(got.select("t", F.lit(mode).alias("mode"), "y0", "x0", F.array_join(F.transform("available", lambda a: a.cast("string")), "").alias("available"), moment.alias("moment")))
    return rounded(out[0].unionByName(out[1]), 4)


#: The fine grid of ``regrid_projected``: corner and step in m; and its coarse cells in degrees.
FINE = (-20_000.0, -4_300_000.0, 10_000.0)


def regrid_projected(spark: SparkSession, d: str) -> DataFrame:
    """Means of a projected grid in cells of latitude and longitude, some of them partly beyond it."""
    cells = spark.range(30).select(F.floor(F.col("id") / 5).cast("int").alias("i"), (F.col("id") % 5).cast("int").alias("j"))
    cells = cells.withColumns({"south": 50.0 + F.col("i") * 0.25, "west": 9.6 + F.col("j") * 0.4}).withColumns({"north": F.col("south") + 0.25, "east": F.col("west") + 0.4})
    overlap = regrid.projected_overlap(cells, *FINE, SIDE, SIDE)
    return rounded(regrid.average_over(grid(spark, d).select("t", "y", "x", "est"), overlap, 0.9, "t", "est"))


def regrid_clipped(spark: SparkSession, d: str) -> DataFrame:
    """Means of a projected grid in the cells of latitude and longitude themselves, and each one's area in fine cells."""
    cells = spark.range(30).select(F.floor(F.col("id") / 5).cast("int").alias("i"), (F.col("id") % 5).cast("int").alias("j"))
    cells = cells.withColumns({"south": 50.0 + F.col("i") * 0.25, "west": 9.6 + F.col("j") * 0.4}).withColumns({"north": F.col("south") + 0.25, "east": F.col("west") + 0.4})
    overlap = written(regrid.clipped_overlap(cells, *FINE, SIDE, SIDE), "overlap")
    means = regrid.average_over(grid(spark, d).select("t", "y", "x", "est"), overlap, 0.8, "t", "est")
    return rounded(means.join(F.broadcast(overlap.groupBy("i", "j").agg(F.sum("w").alias("area"))), ["i", "j"]))  # 30 coarse cells


QUERIES = {
    "strict_hourly_sum": lambda s, d: rounded(hours(s, d, 300)),
    "strict_half_hours": lambda s, d: rounded(hours(s, d, 1800)),
    "daily_mean_of_hourly_means": lambda s, d: rounded(daily(s, d)),
    "centred_rolling_mean": flagship,
    "strata_validation": strata("validation"),
    "strata_diagnostics": strata("diagnostics"),
    "strata_gap": strata("gap"),
    "strata_heavy": strata("heavy"),
} | {
    f.__name__: f
    for f in (
        cadence_gaps, missing_steps, time_axis_parity, hourly_area_means, support_counts, mask_digests, point_metrics_overall, point_metrics_by_time, csi_by_threshold, fss_one_cell,
        event_scores_by_time, distribution_summary, value_stats, stat_ranges, log_histogram, bin_cells, hourly_maxima, exceedance_hours, masked_log_l1, method_deltas, mae_winner,
        block_metrics_multiscale, block_coverage, disk_neighbourhood_scores, regrid_bilinear, regrid_mask, regrid_area_average, patch_eligibility, patch_prefix_sums, patch_choice, patch_exceedance,
        pixel_sample, qc_sample, epoch_order, epoch_order_all, chronological_splits, split_checks, split_filter, split_classify, quantile_map_fit, quantile_map_apply, quantile_map_delta, typical_hours,
        preview_hour, first_per_month, month_counts, projection_inverse, unit_scale, normalised_field, scalar_functions, disk_kernel, geometric_edges, contract_report, coverage_filter,
        typical_per_bin, tiled_inference, stream_hourly_sum, float_thresholds, axis_steps, axis_lookup, field_reader, split_coverage, preflight, loss_agrees, early_stopping, timestamp_digests,
        paired_report, bin_counts, validation_by_epoch, training_patches, cube_by_months, cube_inventory, regrid_map_table, split_manifest, report_files, finite_values,
        tile_layout, archive_days, regrid_projected, packed_mask_digests, fields_by_time, split_months, regrid_beyond, regrid_clipped, grid_contracts, declared_columns,
        archive_stream_hours, indexed_days, axis_merge, scores_from_states, source_windows,
    )
}
