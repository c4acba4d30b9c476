"""Tiled inference as a hook (K3, J4, J5): Spark makes tiles with a halo and gives them to any model in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import log_amount


def tiles(df: DataFrame, value: str, core: int, halo: int, height: int, width: int, time: str = "t") -> DataFrame:
    """``(t, tile_y, tile_x, cells)``: each cell goes to its own tile and to those whose halo covers it.

    The halo is smaller than the core, so a cell is in at most four tiles. A tile's cells are a list of
    ``(y, x, v)``, at most ``(core + 2 halo) ** 2``.
    """
    if not 0 <= halo <= core:
        raise ValueError("a halo can't be wider than a tile")

    def near(a: str, n: int) -> Column:
        places = [F.floor((F.col(a) + d) / core).cast("int") for d in (-halo, 0, halo)]
        return F.filter(F.array_distinct(F.array(*places)), lambda k: (k >= 0) & (k * core < n))

    return (
        df.select(time, "y", "x", F.col(value).cast("float").alias("v"))
        .withColumn("tile_y", F.explode(near("y", height)))
        .withColumn("tile_x", F.explode(near("x", width)))
        .groupBy(time, "tile_y", "tile_x")
        .agg(F.collect_list(F.struct("y", "x", "v")).alias("cells"))
    )


def infer_tiled(df: DataFrame, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], value: str, core: int = 256, halo: int = 112, height: int = 1021, width: int = 900, time: str = "t") -> DataFrame:
    """``(t, y, x, prediction)`` of a model that maps a field to one of the same shape; missing cells are 0 to it.

    ``make_model`` is called once in each task; cells go from Spark's lists to its array without a Python object each. Predictions are not below 0 and only of a tile's core.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_model()
        side = core + 2 * halo
        for batch in batches:
            cells = batch.column(3)
            first, flat = cells.offsets.to_numpy() - cells.offsets[0].as_py(), cells.flatten()
            ys, xs, vs = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("y", "x", "v"))
            for k, (ty, tx) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                at = slice(int(first[k]), int(first[k + 1]))
                y, x = ys[at] - (ty * core - halo), xs[at] - (tx * core - halo)
                field = np.zeros((side, side), np.float32)
                field[y, x] = np.nan_to_num(vs[at])  # missing ones are NaN here
                out = np.maximum(model(field), 0)
                own = (y >= halo) & (y < halo + core) & (x >= halo) & (x < halo + core)
                arrays = [pa.array(ys[at][own], pa.int32()), pa.array(xs[at][own], pa.int32()), pa.array(out[y[own], x[own]].astype(np.float64))]
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[k], int(own.sum())), *arrays], [time, "y", "x", "prediction"])

    kind = dict(df.dtypes)[time]
    own = tiles(df, value, core, halo, height, width, time).select(time, "tile_y", "tile_x", F.transform("cells", lambda c: F.struct(c["y"].cast("int").alias("y"), c["x"].cast("int").alias("x"), c["v"].alias("v"))).alias("cells"))
    return own.mapInArrow(predict, f"{time} {kind}, y int, x int, prediction double")


def to_tiles(df: DataFrame, value: str, size: int, time: str = "t") -> DataFrame:
    """Long to tile layout: cells of each tile in row order, with the tile's place (the performance form)."""
    ty, tx = F.floor(F.col("y") / size).cast("int"), F.floor(F.col("x") / size).cast("int")
    return df.groupBy(time, ty.alias("tile_y"), tx.alias("tile_x")).agg(F.sort_array(F.collect_list(F.struct("y", "x", F.col(value).alias("v")))).alias("cells"))


def from_tiles(tiled: DataFrame, value: str, time: str = "t") -> DataFrame:
    """Tile to long layout."""
    return tiled.select(time, F.explode("cells").alias("c")).select(time, "c.y", "c.x", F.col("c.v").alias(value))


def training_patches(patches: DataFrame, cells: DataFrame, coarse: str, target: str, support: str, size: int, time: str = "t") -> DataFrame:
    """For each patch ``(epoch, t, patch_y, patch_x)`` arrays of its cells in row order: ``input`` (log amounts), ``available``, ``mask`` and ``amount`` (mm, not below 0).

    What is missing or beyond the grid is 0. Cells meet the patches' own places by equality, so nothing outside is kept.
    """
    places = patches.withColumn("dy", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("dx", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    places = places.withColumns({"y": F.col("patch_y") + F.col("dy"), "x": F.col("patch_x") + F.col("dx")})
    zero = F.lit(0.0)
    row = F.struct(
        "dy", "dx", F.coalesce(log_amount(F.col(coarse)), zero).cast("float").alias("input"), F.col(coarse).isNotNull().cast("int").alias("available"),
        F.coalesce(F.col(support), F.lit(False)).cast("int").alias("mask"), F.coalesce(F.greatest(F.col(target), zero), zero).cast("float").alias("amount"),
    )
    keys = ["epoch", time, "patch_y", "patch_x"]
    own = places.join(cells.select(time, "y", "x", coarse, target, support), [time, "y", "x"], "left").groupBy(keys).agg(F.sort_array(F.collect_list(row)).alias("_r"))
    return own.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in ("input", "available", "mask", "amount")))
