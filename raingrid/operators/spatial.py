"""Space: blocks, disks and patches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import ratio
from ..functions.scalar import disk_offsets, half_widths


def block_means(df: DataFrame, support: Column, values: Sequence[str], block: int, height: int, width: int, least: float = 0.5, time: str = "t") -> DataFrame:
    """Means (of float precision) over blocks of the supported cells of a centred crop, where enough of a block is supported."""
    y0, x0 = (height - height // block * block) // 2, (width - width // block * block) // 2
    y, x = F.floor((F.col("y") - y0) / block), F.floor((F.col("x") - x0) / block)
    inside = F.col("y").between(y0, y0 + height // block * block - 1) & F.col("x").between(x0, x0 + width // block * block - 1)
    need = -int(-least * block * block // 1)
    return (
        df.filter(support & inside)
        .groupBy(time, y.alias("block_y"), x.alias("block_x"))
        .agg(*(F.avg(v).cast("float").cast("double").alias(v) for v in values), F.count("*").alias("cells"))
        .filter(F.col("cells") >= need)
        .withColumn("support_fraction", F.col("cells") / F.lit(float(block * block)))
    )


def block_means_of(df: DataFrame, support: Column, values: Sequence[str], blocks: Sequence[int], height: int, width: int, least: float = 0.5, time: str = "t") -> DataFrame:
    """``block_means`` for several sizes in one pass, by ``block``: a cell is there once for each size, and is summed with its block before the shuffle."""
    sizes = F.array(*(F.struct(F.lit(b).alias("block"), F.lit((height - height // b * b) // 2).alias("y0"), F.lit((width - width // b * b) // 2).alias("x0"), F.lit(height // b * b).alias("h"), F.lit(width // b * b).alias("w"), F.lit(-int(-least * b * b // 1)).alias("need")) for b in blocks))
    y, x = F.col("y") - F.col("y0"), F.col("x") - F.col("x0")
    return (
        df.filter(support).select(time, "y", "x", *values, F.inline(sizes))
        .filter((y >= 0) & (y < F.col("h")) & (x >= 0) & (x < F.col("w")))
        .groupBy("block", "need", time, F.floor(y / F.col("block")).alias("block_y"), F.floor(x / F.col("block")).alias("block_x"))
        .agg(*(F.avg(v).cast("float").cast("double").alias(v) for v in values), F.count("*").alias("cells"))
        .filter(F.col("cells") >= F.col("need"))
        .withColumn("support_fraction", F.col("cells") / (F.col("block") * F.col("block")))
        .drop("need")
    )


def block_coverage(blocks: DataFrame, times: DataFrame, block: int, height: int, width: int, time: str = "t") -> DataFrame:
    """Blocks accepted and possible, their share, and the mean support of the accepted."""
    per_time = (height // block) * (width // block)
    possible = times.agg((F.count_distinct(time) * per_time).alias("possible_cells"))
    got = blocks.agg(F.count("*").alias("valid_cells"), F.avg("support_fraction").alias("mean_support"))
    return got.crossJoin(possible).withColumn("valid_cells_fraction", ratio(F.col("valid_cells"), F.col("possible_cells")))


def disk_sums(df: DataFrame, channels: Sequence[str], radius: int, time: str = "t") -> DataFrame:
    """For each cell the sums of ``channels`` over a disk around it; absent cells count 0.

    A disk is chords: each chord is a range window along a row, and chords of the rows above and below are
    range windows along a column. Two shuffles, by row and by column, and no self-join; work grows with the
    radius, not with the disk's area. Rows must be there for all cells whose sums are wanted.
    """
    rows = Window.partitionBy(time, "y").orderBy("x")
    columns = Window.partitionBy(time, "x").orderBy("y")
    widths = half_widths(radius)
    chords = df.select(
        "*", *(F.sum(c).over(rows.rangeBetween(-h, h)).alias(f"_{c}_{h}") for c in channels for h in sorted(set(widths.values())))
    )
    total = {c: None for c in channels}
    for c in channels:
        for dy, h in widths.items():
            part = F.coalesce(F.sum(f"_{c}_{h}").over(columns.rangeBetween(dy, dy)), F.lit(0))
            total[c] = part if total[c] is None else total[c] + part
    return chords.select(*df.columns, *(total[c].alias(f"disk_{c}") for c in channels))


def dense(df: DataFrame, height: int, width: int, time: str = "t") -> DataFrame:
    """All cells of each time, values NULL where there is no row: a disk's chords need their centres."""
    cells = df.sparkSession.range(height * width).select((F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    times = df.select(time).distinct().crossJoin(F.broadcast(cells))  # one grid, whose size is given
    return times.join(df, [time, "y", "x"], "left")


def disk_scores(df: DataFrame, support: str, target: str, estimate: str, threshold: float, radius: int, height: int, width: int, least: float = 0.5, time: str = "t") -> DataFrame:
    """Fractional hits, false alarms and misses, their CSI, and FSS over disks with enough support."""
    own = df.withColumns({
        "s": F.coalesce(F.col(support), F.lit(False)).cast("int"),
        "o": (F.coalesce(F.col(support), F.lit(False)) & F.coalesce(F.col(target) >= threshold, F.lit(False))).cast("int"),
        "f": (F.coalesce(F.col(support), F.lit(False)) & F.coalesce(F.col(estimate) >= threshold, F.lit(False))).cast("int"),
    })
    own = dense(own.select(time, "y", "x", "s", "o", "f"), height, width, time).fillna(0, ["s", "o", "f"])
    cells = len(disk_offsets(radius))
    need = -int(-least * cells // 1)
    centres = disk_sums(own, ["s", "o", "f"], radius, time).filter((F.col("s") == 1) & (F.col("disk_s") >= need))
    o, f = F.col("disk_o") / F.col("disk_s"), F.col("disk_f") / F.col("disk_s")
    hits, false, missed = F.sum(o * f), F.sum(f * (1 - o)), F.sum((1 - f) * o)
    return centres.agg(
        F.count("*").alias("valid_centers"), F.count_distinct(time).alias("valid_hours"), hits.alias("fractional_hits"), false.alias("fractional_false_alarms"), missed.alias("fractional_misses"),
        ratio(hits, hits + false + missed).alias("neighborhood_csi_fractional"), (1 - ratio(F.sum((f - o) * (f - o)), F.sum(f * f + o * o))).alias("fss"),
    ).select(F.lit(radius).alias("radius_cells"), F.lit(cells).alias("disk_cells"), F.lit(threshold).alias("threshold"), "*")


def _disks(radii: Sequence[int], core: int, halo: int, least: float):
    """Sums over disks of a tile's cells: a row for each radius."""

    def sums(rows: pa.Table) -> pa.Table:
        t, ty, tx = (rows[c][0].as_py() for c in rows.column_names[:3])
        y, x = rows["y"].to_numpy() - ty * core + halo, rows["x"].to_numpy() - tx * core + halo
        side = core + 2 * halo
        # sums along rows, with room for chords that reach over the edge
        along = np.zeros((3, side + 2 * halo, side + 2 * halo + 1))
        for k, values in enumerate((np.ones(len(rows)), rows["o"].to_numpy(), rows["f"].to_numpy())):
            np.add.at(along[k], (y + halo, x + halo + 1), values)
        seen = along[0, 2 * halo : 2 * halo + core, 2 * halo + 1 : 2 * halo + core + 1] > 0
        along = np.cumsum(along, axis=2)
        out = []
        for r in radii:
            total = np.zeros((3, core, core))
            for dy, h in half_widths(r).items():
                band = along[:, 2 * halo + dy : 2 * halo + dy + core]
                total += band[:, :, 2 * halo + h + 1 : 2 * halo + h + 1 + core] - band[:, :, 2 * halo - h : 2 * halo - h + core]
            s, o, f = total
            at = seen & (s >= -int(-least * len(disk_offsets(r)) // 1))
            o, f = o[at] / s[at], f[at] / s[at]
            out.append((r, t, int(at.sum()), (o * f).sum(), (f * (1 - o)).sum(), ((1 - f) * o).sum(), ((f - o) ** 2).sum(), (f * f + o * o).sum()))
        names = ["radius_cells", rows.column_names[0], "n", "h", "fa", "mi", "num", "den"]
        types = [pa.int32(), rows.schema.types[0], pa.int64(), *[pa.float64()] * 5]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return sums


def disk_scores_of(df: DataFrame, support: Column, target: str, estimate: str, threshold: float, radii: Sequence[int], height: int, width: int, core: int = 256, least: float = 0.5, time: str = "t") -> DataFrame:
    """``disk_scores`` for several radii in one pass: tiles of ``core`` cells a side with a halo, whose disks are summed in a task.

    Only supported cells are sent, once for each tile whose halo covers them (four at most, as radii are at most ``core``);
    a tile returns a row of sums for each radius. Cells beyond the grid count 0, as absent ones do.
    """
    halo = max(radii)
    if halo > core:
        raise ValueError("a disk can't be wider than a tile")
    near = lambda c, n: F.filter(F.array_distinct(F.array(*(F.floor((F.col(c) + d) / core).cast("int") for d in (-halo, 0, halo)))), lambda k: (k >= 0) & (k * core < n))
    kind = dict(df.dtypes)[time]
    own = df.filter(support).select(time, "y", "x", F.coalesce(F.col(target) >= threshold, F.lit(False)).cast("int").alias("o"), F.coalesce(F.col(estimate) >= threshold, F.lit(False)).cast("int").alias("f"))
    tiled = own.withColumn("tile_y", F.explode(near("y", height))).withColumn("tile_x", F.explode(near("x", width))).select(time, "tile_y", "tile_x", "y", "x", "o", "f")
    sums = tiled.groupBy(time, "tile_y", "tile_x").applyInArrow(_disks(radii, core, halo, least), f"radius_cells int, {time} {kind}, n long, h double, fa double, mi double, num double, den double")
    got = sums.filter("n > 0").groupBy("radius_cells").agg(F.sum("n").alias("valid_centers"), F.count_distinct(time).alias("valid_hours"), *(F.sum(c).alias(c) for c in ("h", "fa", "mi", "num", "den")))
    spine = df.sparkSession.createDataFrame([(r, len(disk_offsets(r)), float(threshold)) for r in radii], "radius_cells int, disk_cells int, threshold double")
    return F.broadcast(spine).join(got, "radius_cells", "left").select(
        "radius_cells", "disk_cells", "threshold", F.coalesce("valid_centers", F.lit(0)).alias("valid_centers"), F.coalesce("valid_hours", F.lit(0)).alias("valid_hours"),
        F.col("h").alias("fractional_hits"), F.col("fa").alias("fractional_false_alarms"), F.col("mi").alias("fractional_misses"),
        ratio(F.col("h"), F.col("h") + F.col("fa") + F.col("mi")).alias("neighborhood_csi_fractional"), (1 - ratio(F.col("num"), F.col("den"))).alias("fss"),
    )


def patch_starts(size: int, patch: int, stride: int) -> list[int]:
    """Starts of patches along an axis: every stride, and one flush with the end."""
    if size < patch:
        return []
    return sorted({*range(0, size - patch + 1, stride), size - patch})


def patch_sums(df: DataFrame, value: Column, patch: int, stride: int, height: int, width: int, time: str = "t") -> DataFrame:
    """Sum of ``value`` over each patch of each time: each cell goes to the patches that cover it, summed before the shuffle (E5).

    A cell is in ``ceil(patch / stride) + 1`` starts an axis at most, so rows grow by a fixed factor.
    """
    starts = {a: F.array(*(F.lit(s) for s in patch_starts(n, patch, stride))) for a, n in (("y", height), ("x", width))}

    def covering(a: str) -> Column:
        return F.filter(starts[a], lambda s: (F.col(a) >= s) & (F.col(a) < s + patch))

    return (
        df.withColumn("_v", value)
        .withColumn("patch_y", F.explode(covering("y")))
        .withColumn("patch_x", F.explode(covering("x")))
        .groupBy(time, "patch_y", "patch_x")
        .agg(F.coalesce(F.sum("_v"), F.lit(0)).alias("value"))
    )


def prefix_patch_sums(df: DataFrame, value: str, patch: int, stride: int, height: int, width: int, time: str = "t") -> DataFrame:
    """The same by prefix sums (an integral image): two windows, then four corners of each patch (E5). For grids far larger than a patch."""
    full = dense(df.select(time, "y", "x", value), height, width, time).fillna(0, [value])
    rows, columns = Window.partitionBy(time, "y").orderBy("x"), Window.partitionBy(time, "x").orderBy("y")
    image = full.withColumn("_r", F.sum(value).over(rows)).withColumn("_i", F.sum("_r").over(columns)).select(time, "y", "x", "_i")
    corners = [(py + dy * patch - 1, px + dx * patch - 1, py, px, 1 if dy == dx else -1) for py in patch_starts(height, patch, stride) for px in patch_starts(width, patch, stride) for dy in (0, 1) for dx in (0, 1)]
    table = df.sparkSession.createDataFrame([c for c in corners if c[0] >= 0 and c[1] >= 0], "y int, x int, patch_y int, patch_x int, sign int")
    return image.join(F.broadcast(table), ["y", "x"]).groupBy(time, "patch_y", "patch_x").agg(F.sum(F.col("_i") * F.col("sign")).alias("value"))
