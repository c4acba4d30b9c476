"""Model inputs from windows of a field: patches and tiles with context, of a fine field or of a coarse one that is regridded only where a window lies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import log_amount
from ..sources.shared import bounded, written
from .regrid import MAP_BYTES, dense_fields

#: Windows meet cells by square blocks of the grid with this side, so that a window meets few cells that aren't its own.
BLOCK = 32


def patch_windows(patches: DataFrame, size: int) -> DataFrame:
    """``patches`` (``patch_y``, ``patch_x`` and more) with the rows and columns ``y0 <= y < y1``, ``x0 <= x < x1`` that each has."""
    return patches.withColumns({"y0": F.col("patch_y"), "x0": F.col("patch_x"), "y1": F.col("patch_y") + size, "x1": F.col("patch_x") + size})


def context_windows(tiles: DataFrame, core: int, halo: int, height: int, width: int) -> DataFrame:
    """``tiles`` (``top``, ``left`` and more) with the window of each tile and its halo within the grid, and the place and shape of its core in that window: ``core_y``, ``core_x``, ``core_h``, ``core_w``."""
    if halo < 0 or core < 1:
        raise ValueError("a core has at least one cell, a halo none or more")
    zero = F.lit(0)
    out = tiles.withColumns({
        "y0": F.greatest(zero, F.col("top") - halo), "x0": F.greatest(zero, F.col("left") - halo),
        "y1": F.least(F.lit(height), F.col("top") + core + halo), "x1": F.least(F.lit(width), F.col("left") + core + halo),
    })
    return out.withColumns({
        "core_y": F.col("top") - F.col("y0"), "core_x": F.col("left") - F.col("x0"),
        "core_h": F.least(F.lit(core), height - F.col("top")), "core_w": F.least(F.lit(core), width - F.col("left")),
    })


def _block(c: Column) -> Column:
    return F.floor(c / BLOCK).cast("int")


def _by_blocks(windows: DataFrame) -> DataFrame:
    """A row for each window and block of the grid that it touches."""
    own = windows
    for a in "yx":
        own = own.withColumn(f"_b{a}", F.explode(F.sequence(_block(F.col(f"{a}0")), _block(F.col(f"{a}1") - 1))))
    return own


def _inside() -> Column:
    return (F.col("_y") >= F.col("y0")) & (F.col("_y") < F.col("y1")) & (F.col("_x") >= F.col("x0")) & (F.col("_x") < F.col("x1"))


def _arrays(windows: DataFrame, rows: DataFrame, keys: Sequence[str], side: int) -> DataFrame:
    """``windows`` with ``input`` and ``available``, ``side * side`` numbers in row order; ``rows`` have the keys, ``_k`` (the place) and ``_v``, which isn't null."""
    zero = F.lit(0.0).cast("float")
    entry = F.struct(F.col("_k").alias("k"), log_amount(F.col("_v")).cast("float").alias("v"), F.lit(1).alias("a"))
    own = rows.groupBy(*keys).agg(F.collect_list(entry).alias("_s"))
    none = F.array().cast("array<struct<k:int,v:float,a:int>>")
    out = windows.join(own, list(keys), "left").withColumn("_s", F.coalesce("_s", none))
    lacking = F.transform(F.array_except(F.sequence(F.lit(0), F.lit(side * side - 1)), F.col("_s.k")), lambda k: F.struct(k.alias("k"), zero.alias("v"), F.lit(0).alias("a")))
    out = out.withColumn("_s", F.sort_array(F.concat("_s", lacking)))
    return out.select(*windows.columns, F.col("_s.v").alias("input"), F.col("_s.a").alias("available"))


def _place(side: int) -> Column:
    return ((F.col("_y") - F.col("y0")) * side + (F.col("_x") - F.col("x0"))).cast("int")


def fine_inputs(windows: DataFrame, cells: DataFrame, keys: Sequence[str], side: int, time: str = "t", value: str = "v") -> DataFrame:
    """Each window ``(*keys, y0, x0, y1, x1)`` of a fine field ``cells(time, y, x, value)`` as ``input`` (log amounts) and ``available``, arrays of ``side * side`` numbers in row order.

    Windows are unique by ``keys``, which hold the time, and begin at or above 0. A window lies at the beginning of its array; what is missing
    or beyond the window or the grid is 0 and not available. Windows meet cells by time and block of the grid.
    """
    own = cells.filter(F.col(value).isNotNull()).select(time, F.col("y").alias("_y"), F.col("x").alias("_x"), F.col(value).alias("_v")).withColumns({"_by": _block(F.col("_y")), "_bx": _block(F.col("_x"))})
    rows = _by_blocks(windows.select(*keys, "y0", "x0", "y1", "x1")).join(own, [time, "_by", "_bx"]).filter(_inside())
    return _arrays(windows, rows.select(*keys, _place(side).alias("_k"), "_v"), keys, side)


def coarse_inputs(windows: DataFrame, coarse: DataFrame, mapping: DataFrame, keys: Sequence[str], side: int, width: int, time: str = "t", value: str = "v") -> DataFrame:
    """``fine_inputs`` of the field that ``coarse(time, i, j, value)``, of rows of ``width`` cells, gives by a regrid map ``(y, x, overlap, corner, i, j, w)``; only cells of windows are regridded.

    A time's coarse field comes to its windows as one array, only for times that have windows. A window meets the map by block of the grid: the map is
    broadcast where a count shows that it is small, else joined by a shuffle. A cell is missing if a corner is, even one of weight 0 (Z-2), or if it isn't in the overlap.
    """
    fields = dense_fields(coarse.join(windows.select(time).distinct(), time, "left_semi"), width, time, value)
    place = F.col("i") * width + F.col("j")
    corners = [F.max(F.when(F.col("corner") == k, v)).alias(f"_{n}{k}") for k in range(4) for n, v in (("k", place.cast("int")), ("w", F.col("w")))]
    cells = mapping.filter("overlap").groupBy(F.col("y").cast("int").alias("_y"), F.col("x").cast("int").alias("_x")).agg(*corners).withColumns({"_by": _block(F.col("_y")), "_bx": _block(F.col("_x"))})
    total = sum((F.col(f"_w{k}") * F.get("_f", F.col(f"_k{k}")) for k in range(1, 4)), F.col("_w0") * F.get("_f", F.col("_k0")))  # NULL if a part is
    own = _by_blocks(windows.select(*keys, "y0", "x0", "y1", "x1").join(fields, time))
    rows = own.join(bounded(written(cells, "map"), MAP_BYTES), ["_by", "_bx"]).filter(_inside()).select(*keys, _place(side).alias("_k"), total.alias("_v"))
    return _arrays(windows, rows.filter("_v is not null"), keys, side)
