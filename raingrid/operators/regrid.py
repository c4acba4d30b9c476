"""Regridding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import bilinear_weights, clip
from ..sources.shared import bounded, written
from .verify import exact_quantiles


def axis_place(value: Column, first: float, step: float, n: int) -> tuple[Column, Column]:
    """Index of the coarse point at or below a value on a regular axis, at most the last but one, and the fraction beyond it (C4)."""
    place = (value - F.lit(first)) / F.lit(step)
    index = clip(F.floor(place).cast("int"), 0, n - 2)
    return index, place - index


def axis_step(axis: DataFrame, index: str, value: str) -> DataFrame:
    """One row: the median difference of neighbouring points of an axis (E8). An axis is short: one window."""
    steps = axis.select((F.col(value) - F.lag(value).over(Window.orderBy(index))).alias("d"))
    return steps.agg(F.median("d").alias("step"))


def axis_lookup(df: DataFrame, value: str, axis: DataFrame, index: str, point: str) -> DataFrame:
    """``df`` with the index of the point at or below a value on an ascending axis of any steps, at most the last but one, and the fraction beyond it (C4).

    The axis, of a few hundred points, is one row of an array, which is broadcast.
    """
    points = axis.agg(F.transform(F.sort_array(F.collect_list(F.struct(index, point))), lambda s: s[point].cast("double")).alias("_a"))
    at = clip(F.size(F.filter("_a", lambda p: p <= F.col(value))) - 1, 0, F.size("_a") - 2)
    low, high = (F.try_element_at("_a", F.col("place") + k) for k in (1, 2))
    return df.crossJoin(F.broadcast(points)).withColumn("place", F.when(F.col(value).isNotNull(), at)).withColumn("beyond", (F.col(value) - low) / (high - low)).drop("_a")


#: Points and values that a task of an as-of merge sorts as a mean, and points of a chunk of an axis that looks for the next points at once.
ROWS_A_TASK, CHUNK_POINTS = 1_000_000, 1 << 14


def _tasks(spark: SparkSession, rows: int) -> int:
    """As many as shuffles have, and more where rows are many."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK))


def axis_intervals(axis: DataFrame, index: str, point: str) -> DataFrame:
    """``(_place, _low, _high)``: each point but the last of an axis of any length, with its place in the order of ``index`` and the next point.

    Places are those in a range-sorted table's own partitions after the counts of the partitions before. The next point is looked for within
    chunks of places, which have the first point of the chunk after them too. So no task has more than its share of the axis.
    """
    spark = axis.sparkSession
    own = written(axis.select(F.col(index).alias("_index"), F.col(point).cast("double").alias("_low")), "points")
    tasks = _tasks(spark, own.count())
    own = own.repartitionByRange(tasks, "_index", "_low").sortWithinPartitions("_index", "_low").select("_low", F.monotonically_increasing_id().alias("_at"))
    own = written(own, "sorted").withColumn("_run", F.shiftright("_at", 33))
    # a row a task
    runs = own.groupBy("_run").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_run")) - F.col("_rows")
    own = own.join(F.broadcast(runs.select("_run", (before - F.col("_first")).alias("_shift"))), "_run").withColumn("_place", F.col("_at") + F.col("_shift"))
    chunk = F.floor(F.col("_place") / CHUNK_POINTS)
    chunks = F.when((F.col("_place") % CHUNK_POINTS == 0) & (F.col("_place") > 0), F.array(chunk - 1, chunk)).otherwise(F.array(chunk))
    own = own.select("_place", "_low", F.explode(chunks).alias("_chunk")).repartition(tasks, "_chunk")
    high = F.lead("_low").over(Window.partitionBy("_chunk").orderBy("_place"))
    return written(own.select(F.col("_place").cast("int").alias("_place"), "_low", high.alias("_high")).filter("_high is not null"), "intervals")


def axis_merge(df: DataFrame, value: str, axis: DataFrame, index: str, point: str, tasks: int | None = None) -> DataFrame:
    """``axis_lookup`` on an axis of any length, as an as-of merge (C4, C11): values and the axis's intervals are dealt by ranges and sorted together, and each value takes the last interval that begins at or below it.

    Rows are counted, shuffled once and written once; a task passes its rows in order and keeps one interval. What a range lacks at its beginning is the
    last interval of the ranges before it, one row a task. Many equal values are spread by a hash of their rows. A null value has no place, one
    beyond the ends that of the nearest interval, and an axis of fewer than two points gives none. Tasks, where they aren't given, grow with the rows.
    """
    intervals = axis_intervals(axis, index, point)
    # the first interval begins before all values
    axis = intervals.withColumn("_key", F.when(F.col("_place") == 0, F.lit(float("-inf"))).otherwise(F.col("_low"))).withColumns({"_kind": F.lit(0), "_salt": F.lit(0).cast("long")})
    hashable = [c for c, t in df.dtypes if "map<" not in t and t != "variant"]
    own = df.withColumns({"_key": F.col(value).cast("double"), "_kind": F.lit(1), "_salt": F.xxhash64(*hashable)})
    order = ["_key", "_kind", "_salt"]
    tasks = tasks or _tasks(df.sparkSession, df.count() + axis.count())
    both = own.unionByName(axis, allowMissingColumns=True).repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            begins = batch.column("_place").is_valid().to_numpy(zero_copy_only=False)
            at = np.maximum.accumulate(np.where(begins, np.arange(len(begins)), -1))
            for name in ("_place", "_low", "_high"):
                column = batch.column(name).take(pa.array(at, mask=at < 0))
                if last is not None:
                    column = column.fill_null(last[name])
                batch = batch.set_column(batch.schema.get_field_index(name), batch.schema.field(name), column)
            if len(at) and batch.column("_place")[-1].is_valid:
                last = {name: batch.column(name)[-1] for name in ("_place", "_low", "_high")}
            yield batch

    rows = written(both.mapInArrow(carry, both.schema), "merged")
    # the last place of each task's own intervals, counted in a hash table; a maximum of whole intervals would sort all rows
    ends = rows.filter("_kind = 0").groupBy("_part").agg(F.max("_place").alias("_place"))
    ends = intervals.join(F.broadcast(ends), "_place").select("_part", F.struct("_place", "_low", "_high").alias("_e"))
    ends = df.sparkSession.range(tasks).select(F.col("id").cast("int").alias("_part")).join(F.broadcast(ends), "_part", "left")
    before = F.last("_e", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # a row a task
    filled = rows.filter("_kind = 1").join(F.broadcast(ends.select("_part", before.alias("_b"))), "_part")
    low, high, place = (F.coalesce(c, F.col(f"_b.{c}")) for c in ("_low", "_high", "_place"))
    seen = F.col(value).isNotNull()
    return filled.select(*df.columns, F.when(seen, place).alias("place"), F.when(seen, (F.col(value) - low) / (high - low)).alias("beyond"))


def bilinear_map(cells: DataFrame, lat: tuple[float, float, int], lon: tuple[float, float, int], overlap: Column) -> DataFrame:
    """For each fine cell ``(y, x, lat, lon)`` four rows ``(corner, i, j, w)`` with the overlap mask (K7): arithmetic, no join.

    Cells beyond the coarse axes are no part of the overlap, whatever mask is given: nothing is extrapolated.
    """
    for name, (first, step, n) in (("lat", lat), ("lon", lon)):
        ends = sorted((first, first + step * (n - 1)))
        overlap = overlap & F.coalesce(F.col(name).between(*ends), F.lit(False))
    i, fy = axis_place(F.col("lat"), *lat)
    j, fx = axis_place(F.col("lon"), *lon)
    corners = [F.struct(F.lit(k).alias("corner"), (i + k // 2).alias("i"), (j + k % 2).alias("j"), w.alias("w")) for k, w in enumerate(bilinear_weights(fy, fx))]
    return cells.select("y", "x", overlap.alias("overlap"), F.explode(F.array(*corners)).alias("c")).select("y", "x", "overlap", "c.*")


#: A map is cut into so many chunks, the keys by which it meets the fields. It is broadcast up to so many bytes (a map of a million
#: fine cells has 100 MB), beyond that joined by a shuffle.
CHUNKS, MAP_BYTES = 16, 128 << 20


def dense_fields(coarse: DataFrame, width: int, time: str, value: str) -> DataFrame:
    """``(time, _f)``: each time's field as one array of its cells by ``i * width + j``, NULL where a row lacks.

    Rows that lack are those of the sequence of places that no cell has; they are sorted in among the others.
    """
    place = F.col("i").cast("int") * width + F.col("j").cast("int")
    own = coarse.groupBy(time).agg(F.collect_list(F.struct(place.alias("k"), F.col(value).cast("double").alias("v"))).alias("_s"))
    lacking = F.array_except(F.sequence(F.lit(0), F.array_max("_s.k")), F.col("_s.k"))
    every = F.concat("_s", F.transform(lacking, lambda k: F.struct(k.alias("k"), F.lit(None).cast("double").alias("v"))))
    return own.select(time, F.sort_array(every)["v"].alias("_f"))


def _corners(coarse: DataFrame, mapping: DataFrame, width: int | None, time: str, value: str, tasks: int | None = None) -> DataFrame:
    """For each time and fine cell of the overlap its corners' weights ``_w0`` to ``_w3`` and values ``_v0`` to ``_v3``.

    A time's coarse field is one array, and a fine cell one row with its four corners, so that nothing is shuffled by fine cell:
    every field meets every chunk of the map. Fields and chunks are dealt over ``tasks`` tasks (as many as shuffles have, where it
    isn't given), which write the output. The map is written before it is counted.
    """
    spark = coarse.sparkSession
    if width is None:
        width = int(coarse.agg(F.max("j")).first()[0] or 0) + 1
    place = F.col("i") * width + F.col("j")
    fields = dense_fields(coarse, width, time, value).select(time, "_f", F.explode(F.sequence(F.lit(0), F.lit(CHUNKS - 1))).alias("_chunk"))
    fields = fields.repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), time, "_chunk")
    corners = [F.max(F.when(F.col("corner") == k, v)).alias(f"_{n}{k}") for k in range(4) for n, v in (("k", place.cast("int")), ("w", F.col("w")))]
    cells = mapping.filter("overlap").groupBy("y", "x").agg(*corners).withColumn("_chunk", F.pmod(F.hash("y", "x"), F.lit(CHUNKS)))
    pairs = fields.join(bounded(written(cells, "cells"), MAP_BYTES), "_chunk")
    return pairs.select(time, "y", "x", *(c for k in range(4) for c in (F.col(f"_w{k}"), F.get("_f", F.col(f"_k{k}")).alias(f"_v{k}"))))


def regrid_bilinear(coarse: DataFrame, mapping: DataFrame, width: int | None = None, time: str = "t", value: str = "v") -> DataFrame:
    """The coarse field (rows of ``width`` cells, counted where it isn't given) at each fine cell of the overlap; missing if a corner is, even one of weight 0 (C7, Z-2)."""
    total = sum((F.col(f"_w{k}") * F.col(f"_v{k}") for k in range(1, 4)), F.col("_w0") * F.col("_v0"))  # NULL if a part is
    return _corners(coarse, mapping, width, time, value).select(time, "y", "x", total.alias(value))


def bilinear_mask(coarse: DataFrame, mapping: DataFrame, width: int | None = None, time: str = "t", value: str = "v") -> DataFrame:
    """Where ``regrid_bilinear`` gives a value, without computing it."""
    seen = F.lit(True)
    for k in range(4):
        seen = seen & F.col(f"_w{k}").isNotNull() & F.col(f"_v{k}").isNotNull()
    return _corners(coarse, mapping, width, time, value).select(time, "y", "x", seen.alias("valid"))


def overlap_lengths(spark, fine: int, coarse: int, fine_name: str, coarse_name: str) -> DataFrame:
    """Lengths by which equal cells of two divisions of one axis overlap, in fine cells."""
    step = fine / coarse
    rows = [(a, b, float(min(a + 1, (b + 1) * step) - max(a, b * step))) for b in range(coarse) for a in range(fine)]
    rows = [r for r in rows if r[2] > 1e-12]
    return spark.createDataFrame(rows, f"{fine_name} int, {coarse_name} int, w_{coarse_name} double")


def area_average(fine: DataFrame, weights_y: DataFrame, weights_x: DataFrame, least: float = 0.8, time: str = "t", value: str = "v") -> DataFrame:
    """Area-weighted means of fine cells on a coarse grid, with the share that was seen; missing below ``least``.

    The weights of a grid are products of two short tables, one for each axis, which are broadcast.
    """
    w = F.col("w_i") * F.col("w_j")
    v = F.col(value)
    out = (
        fine.join(F.broadcast(weights_y), "y")
        .join(F.broadcast(weights_x), "x")
        .groupBy(time, "i", "j")
        .agg(F.try_divide(F.sum(w * v), F.sum(F.when(v.isNotNull(), w))).alias("mean"), F.try_divide(F.coalesce(F.sum(F.when(v.isNotNull(), w)), F.lit(0.0)), F.sum(w)).alias("source_valid_fraction"))
    )
    return out.select(time, "i", "j", F.when(F.col("source_valid_fraction") >= least, F.col("mean")).alias(value), "source_valid_fraction")


def projected_overlap(cells: DataFrame, x0: float, y0: float, step: float, height: int, width: int) -> DataFrame:
    """``(i, j, y, x, w)``: areas by which fine cells of a projected grid lie in the rectangle round each coarse cell's corners, in fine cells.

    ``cells(i, j, south, north, west, east)`` are in degrees; the fine cell (y, x) has its corner at ``x0 + x * step``,
    ``y0 + y * step``. What lies beyond the fine grid has no weight, and a coarse cell wholly beyond it no row.
    """
    from ..functions.scalar import stereographic

    corners = [stereographic(F.col(lon), F.col(lat)) for lon in ("west", "east") for lat in ("south", "north")]
    px, py = ([(c[k] - F.lit(origin)) / F.lit(step) for c in corners] for k, origin in ((0, x0), (1, y0)))
    zero = F.lit(0.0)
    own = cells.select(
        "i", "j", F.greatest(F.least(*py), zero).alias("y0"), F.least(F.greatest(*py), F.lit(float(height))).alias("y1"), F.greatest(F.least(*px), zero).alias("x0"), F.least(F.greatest(*px), F.lit(float(width))).alias("x1")
    ).filter("y0 < y1 and x0 < x1")
    for a in ("y", "x"):
        own = own.withColumn(a, F.explode(F.sequence(F.floor(f"{a}0"), F.ceil(f"{a}1") - 1)))
    share = lambda a: F.least(F.col(a) + 1, F.col(f"{a}1")) - F.greatest(F.col(a), F.col(f"{a}0"))
    return own.select("i", "j", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), (share("y") * share("x")).alias("w")).filter("w > 1e-12")


def _under(a: Column) -> Column:
    """The integral from minus infinity to ``a`` of a number held between 0 and 1 (0 below)."""
    return F.when(a <= 0, 0.0).when(a <= 1, a * a / 2).otherwise(a - 0.5)


def _strip(px: Column, py: Column, qx: Column, qy: Column, x: Column, y: Column) -> Column:
    """What the edge from p to q adds to the area of a polygon in the unit cell at (x, y): the integral, over the part of x to x + 1 below the edge, of its height above y held between 0 and 1, with the sign of the edge's direction."""
    low, high = F.greatest(F.least(px, qx), x), F.least(F.greatest(px, qx), x + 1)
    slope = (qy - py) / (qx - px)
    a, b = py + (low - px) * slope - y, py + (high - px) * slope - y
    mean = F.when(F.abs(b - a) < 1e-7, clip((a + b) / 2, 0.0, 1.0)).otherwise((_under(b) - _under(a)) / (b - a))
    return F.when((px == qx) | (low >= high), 0.0).otherwise(F.signum(qx - px) * (high - low) * mean)


def clipped_overlap(cells: DataFrame, x0: float, y0: float, step: float, height: int, width: int) -> DataFrame:
    """``(i, j, y, x, w)``: the areas that fine cells of a projected grid share with each coarse cell itself, the quadrilateral of its projected corners, in fine cells.

    As ``projected_overlap`` else. Neighbouring coarse cells share their edges, so their weights sum to 1 in every fine cell inside a
    coarse grid. The area is the sum of what each edge leaves below it in the fine cell, so that it is a projection without a join.
    """
    from ..functions.scalar import stereographic

    names = [("west", "south"), ("east", "south"), ("east", "north"), ("west", "north")]
    own = cells.select("i", "j", *(((c - F.lit(o)) / F.lit(step)).alias(f"_{a}{k}") for k, (lon, lat) in enumerate(names) for c, o, a in zip(stereographic(F.col(lon), F.col(lat)), (x0, y0), "xy", strict=True)))
    for a, n in (("y", height), ("x", width)):
        corners = [F.col(f"_{a}{k}") for k in range(4)]
        own = own.withColumns({"_low": F.greatest(F.floor(F.least(*corners)), F.lit(0)), "_high": F.least(F.ceil(F.greatest(*corners)) - 1, F.lit(n - 1))}).filter("_low <= _high").withColumn(a, F.explode(F.sequence("_low", "_high"))).drop("_low", "_high")
    # one expression for all edges: four copies of it would be more than one compiled method can hold
    edges = F.array(*(F.struct(F.col(f"_x{k}").alias("px"), F.col(f"_y{k}").alias("py"), F.col(f"_x{(k + 1) % 4}").alias("qx"), F.col(f"_y{(k + 1) % 4}").alias("qy")) for k in range(4)))
    area = F.abs(F.aggregate(edges, F.lit(0.0), lambda total, e: total + _strip(e["px"], e["py"], e["qx"], e["qy"], F.col("x"), F.col("y"))))
    return own.select("i", "j", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), area.alias("w")).filter("w > 1e-9")


def average_over(fine: DataFrame, overlap: DataFrame, least: float = 0.8, time: str = "t", value: str = "v") -> DataFrame:
    """``area_average`` by a table of overlaps ``(i, j, y, x, w)``, broadcast where a count shows that it is small."""
    w, v = F.col("w"), F.col(value)
    seen = F.coalesce(F.sum(F.when(v.isNotNull(), w)), F.lit(0.0))
    out = fine.join(bounded(written(overlap, "overlap"), MAP_BYTES), ["y", "x"]).groupBy(time, "i", "j").agg(F.try_divide(F.sum(w * v), seen).alias("mean"), F.try_divide(seen, F.sum(w)).alias("source_valid_fraction"))
    return out.select(time, "i", "j", F.when(F.col("source_valid_fraction") >= least, F.col("mean")).alias(value), "source_valid_fraction")


def unit_scale(points: DataFrame, scales: tuple[float, ...] = (1.0, 1000.0)) -> DataFrame:
    """The scale of projected coordinates that puts points ``(px, py, lon, lat)`` nearest to their geolocation, with its errors in degrees (K9)."""
    from ..functions.scalar import stereographic_inverse, wrap_longitude

    tried = points.withColumn("scale", F.explode(F.array(*(F.lit(s) for s in scales))))
    lon, lat = stereographic_inverse(F.col("px") * F.col("scale"), F.col("py") * F.col("scale"))
    error = F.hypot(wrap_longitude(lon - F.col("lon")) * F.cos(F.radians("lat")), lat - F.col("lat"))
    tried = tried.withColumn("error", error)
    middle = exact_quantiles(tried, "error", (0.5,), ("scale",)).select("scale", F.col("q")[0].alias("median_error"))
    per = tried.groupBy("scale").agg(F.max("error").alias("max_error")).join(middle, "scale")
    best = per.agg(F.min(F.struct("median_error", "scale", "max_error")).alias("b"))
    return best.select("b.scale", "b.median_error", "b.max_error", ((F.col("b.median_error") <= 0.02) & (F.col("b.max_error") <= 0.05)).alias("accepted"))
