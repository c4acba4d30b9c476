"""Shards of near-equal bytes by Karmarkar-Karp differencing, groups of equal texts kept whole.

Differencing keeps partial partitions, each a list of part sums. It repeatedly takes the two with the largest
spread and adds them in opposite order, largest part to smallest. The partial partitions of separate sets of
groups are combined by the same step, so each task differences the groups of its own cell and only the
cells' part sums (``shards`` numbers each) meet in the last differencing.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, materialise

#: Groups of a cell, and rows of a numbering block, as a mean.
CELL_GROUPS, BLOCK_ROWS = 2_000, 5_000
#: Cells whose sums one last differencing takes; more of them are first differenced in sets of so many.
FAN_IN = 4_096


def differencing(sums: list[list[int]], parts: int) -> list[list[int]]:
    """Combine partial partitions to one; returns for each input the final part of each of its parts.

    ``sums`` holds for each partial partition its part sums, trailing zeros left out.
    """
    if not sums:
        return []
    # a node keeps sums in descending order, and for each place the input parts that have gone there as a tree
    nodes: list[tuple] = []  # (left node, right node, order of left's places, order of right's places)
    heap = []
    for k, own in enumerate(sums):
        order = sorted(range(len(own)), key=lambda p: -own[p])
        ordered = [own[p] for p in order]
        nodes.append((None, None, order, None))
        heap.append((-(ordered[0] - (ordered[-1] if len(ordered) == parts else 0)) if ordered else 0, k, ordered))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        # place p of the left meets place parts - 1 - p of the right; places past the end hold zero
        total: list[tuple[int, int]] = []
        if len(x) + len(y) <= parts:
            total = [(v, p) for p, v in enumerate(x)] + [(v, parts - 1 - q) for q, v in enumerate(y)]
        else:
            merged = dict(enumerate(x))
            for q, v in enumerate(y):
                merged[parts - 1 - q] = merged.get(parts - 1 - q, 0) + v
            total = [(v, p) for p, v in merged.items()]
        total.sort(key=lambda t: (-t[0], t[1]))
        ordered = [v for v, _ in total]
        nodes.append((a, b, [p for _, p in total], None))
        spread = ordered[0] - (ordered[-1] if len(ordered) == parts else 0)
        heapq.heappush(heap, (-spread, len(nodes) - 1, ordered))
    # from the top down: where each place of a node ends; places a node left out take the parts that remain
    final: dict[int, list[int]] = {heap[0][1]: list(range(parts))}
    out: list[list[int]] = [[] for _ in sums]
    for k in range(len(nodes) - 1, -1, -1):
        ends = final.pop(k)
        a, b, order, _ = nodes[k]
        if a is None:
            out[k] = [0] * len(order)
            for place, p in enumerate(order):
                out[k][p] = ends[place]
            continue
        at = [-1] * parts
        for place, p in enumerate(order):
            at[p] = ends[place]
        free = iter(ends[len(order) :])
        at = [e if e >= 0 else next(free) for e in at]
        final[a] = at
        final[b] = at[::-1]
    return out


def _cell(parts: int):
    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "digest"], ascending=[False, True])
        sizes = rows["bytes"].tolist()
        part = [p[0] for p in differencing([[s] for s in sizes], parts)]
        return pd.DataFrame({"cell": rows["cell"].to_numpy(), "digest": rows["digest"].to_numpy(), "bytes": sizes, "part": part})

    return assign


def _meet(parts: int):
    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["cell", "part"])
        cells = rows["cell"].drop_duplicates().tolist()
        sums = np.zeros((len(cells), parts), np.int64)
        sums[rows["cell"].map({c: k for k, c in enumerate(cells)}), rows["part"]] = rows["bytes"]
        shard = differencing(sums.tolist(), parts)
        return pd.DataFrame(
            {"cell": np.repeat(cells, parts), "part": np.tile(np.arange(parts), len(cells)), "batch": rows["batch"].iloc[0], "bytes": sums.reshape(-1), "shard": [s for own in shard for s in own]}
        )

    return combine


def shard_by_bytes(docs: DataFrame, shards: int = 24) -> DataFrame:
    """``docs(doc_id, text, ...)`` to ``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, a row for each row.

    Rows of equal text (null texts: one group too) are in one shard; shards have near equal bytes, as far as
    the largest group allows. ``size`` is the UTF-8 length plus 8, ``text_crc32`` is null for a null text.
    ``slot`` numbers the rows of a shard without gaps, in no promised order. An empty table gives no rows;
    null and repeated ids are rows like others; other columns are not looked at.
    """
    spark = docs.sparkSession
    text = F.col("text")
    rows = materialise(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(text).cast("long"), F.lit(0)) + 8).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.coalesce(F.unhex(F.md5(text)), F.lit(b"").cast("binary")).alias("digest"),
            F.coalesce(F.octet_length(text), F.lit(-1)).alias("length"),
        ).withColumn("digest", F.concat("digest", F.unhex(F.lpad(F.hex("length"), 16, "0")))).drop("length"),
        "rows",
    )
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    n = rows.count()
    cells = max(1, -(-n // CELL_GROUPS))
    placed = materialise(
        groups.withColumn("cell", F.pmod(F.xxhash64("digest"), F.lit(cells)))
        .groupBy("cell")
        .applyInPandas(_cell(shards), "cell long, digest binary, bytes long, part int"),
        "placed",
    )
    sums = placed.groupBy("cell", "part").agg(F.sum("bytes").alias("bytes"))
    # cells meet in sets of FAN_IN; a set's result is a cell of the next level
    maps, schema = [], "cell long, part int, batch long, bytes long, shard int"
    while True:
        level = materialise(
            sums.withColumn("batch", F.floor(F.col("cell") / FAN_IN)).groupBy("batch").applyInPandas(_meet(shards), schema), f"level{len(maps)}"
        )
        maps.append(level)
        cells = -(-cells // FAN_IN)
        if cells == 1:
            break
        sums = level.groupBy(F.col("batch").alias("cell"), F.col("shard").alias("part")).agg(F.sum("bytes").alias("bytes"))
    where = placed.select("digest", "cell", "part")
    for level in maps:
        step = level.select("cell", "part", F.col("batch").alias("next"), "shard")
        where = where.join(bounded(step), ["cell", "part"]).select("digest", F.col("next").alias("cell"), F.col("shard").alias("part"))
    # blocks by the rows' own numbers, so that rows that repeat one another spread too; written, so that they stay
    dealt = materialise(
        rows.join(where.select("digest", F.col("part").alias("shard")), "digest").drop("digest").withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(-(-n // (BLOCK_ROWS * shards)) or 1))),
        "dealt",
    )
    counts = dealt.groupBy("shard", "block").agg(F.count("*").alias("rows"))
    starts = counts.withColumn(
        "start", F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("shard", "block", "start")
    numbered = dealt.withColumn("k", F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32")) - 1)
    return numbered.join(bounded(materialise(starts, "starts")), ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("k")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op2_karmarkar_karp(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` in shards 0 to 23."""
    return shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)
