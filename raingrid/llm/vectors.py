"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, table distances, exact rerank.

Vectors are compared within a label and a width. Each distinct vector is indexed in the list of its nearest coarse
centroid with the codes of its residual. As a query it probes every list whose border with its own is within
half the link distance: of two vectors so near, one at least probes the list of the other. Lists are dealt in
groups, so that a vector is sent once for all lists of a group. A group that has grown large is cut at a second level,
by centroids fitted on a sample of its own members in a task, and a query goes to the parts that it can have
links in. A block of a part meets a block of queries in one task: table distances rule out what the quantisation
error allows, and the rest gets its cosine in double precision. Tasks return counts of links and a spanning
forest of them, so results grow with the vectors even where thousands are linked with one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, bounded, connected_components

LEAST_COSINE = 0.93
#: The index is fitted on up to so many vectors, those with the smallest hash of their id.
FIT_ROWS = 20_000
#: Vectors of a list as a mean, and the most lists of the first level (as many as the fit's vectors can carry).
LIST_ROWS, MOST_LISTS = 400, 1_024
#: A group of one label with more vectors than this is cut at the second level, into parts of PART_ROWS as a mean, MOST_PARTS at most.
SPLIT_ROWS, PART_ROWS, MOST_PARTS = 8_192, 1_024, 1_024
#: Vectors of a group that one task sees at a time at the second level, and of its sample for each part.
CHUNK_ROWS, SAMPLE_ROWS = 16_384, 16
#: Widths that have no more vectors than this need no fitted index: their vectors are one list.
LEAST_WIDTH_ROWS = 2_048
SUBSPACES, CODES = 8, 64
#: Rows of a block of a group of lists, or of the queries of a group.
BLOCK = 4_096
#: Vectors of the largest label in a group of lists, as a mean.
GROUP_ROWS = 2_048
#: Pairs whose cosines are computed at once.
PAIRS = 65_536


def _kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=len(centres))
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for low in range(0, len(x), 4096):
        out[low : low + 4096] = (np.square(centres).sum(1) - 2 * x[low : low + 4096] @ centres.T).argmin(1)
    return out


class Index:
    """Coarse centroids and residual code books, fitted on a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int, least_cosine: float = LEAST_COSINE, groups: int = 1):
        self.reach = float(np.sqrt(max(0.0, 2 - 2 * least_cosine)))
        self.coarse = _kmeans(sample, lists)
        rest = sample - self.coarse[_nearest(sample, self.coarse)]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [_kmeans(rest[:, c], CODES, seed=2 + k) for k, c in enumerate(self.cuts)]
        square = np.square(self.coarse).sum(1)
        self.apart = np.sqrt(np.maximum(0, square[:, None] + square[None] - 2 * self.coarse @ self.coarse.T))
        # the distances of two vectors from the border between them sum to their distance at most, so one has half of it or less
        self.margin = self.reach / 2 + 1e-9
        self.group = _nearest(self.coarse, _kmeans(self.coarse, groups, seed=99))

    def encode(self, x: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List (``own`` if it is known), codes and quantisation error of each vector."""
        own = _nearest(x, self.coarse) if own is None else own
        rest = x - self.coarse[own]
        codes = np.stack([_nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], axis=1)
        lost = sum(np.square(rest[:, c] - b[codes[:, k]]).sum(1) for k, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)))
        return own, codes, np.sqrt(lost)

    def probes(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """For each vector and list, whether the border with that list is near enough (a row of booleans)."""
        square = np.square(self.coarse).sum(1) - 2 * x @ self.coarse.T
        beyond = square - square[np.arange(len(x)), own][:, None]
        return beyond <= 2 * self.margin * self.apart[own]

    def table_distances(self, x: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Distances of queries to the coded vectors of list ``at``, by a table for each subspace."""
        rest = x - self.coarse[at]
        total = np.zeros((len(x), len(codes)))
        for k, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            table = np.square(rest[:, c, None] - b.T[None]).sum(1)
            total += table[:, codes[:, k]]
        return np.sqrt(total)


def _unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors in double precision of a list column whose lists are equally long and not empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _lists_of(asked: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, asked)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *asked]), pa.int32()))


def _assign(indexes: dict[int, Index], probe: bool):
    """The list of each vector and its group; or, to ``probe``, a row for each group with the lists in it that the vector probes, and its own list too. Widths without an index are one list."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 1_000) for b in batches for k in range(0, len(b), 1_000)):
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths).tolist():
                part = batch.filter(pa.array(widths == width)) if (widths != width).any() else batch
                index = indexes.get(width)
                own = np.zeros(len(part), np.int64) if index is None else _nearest(x := _unit(part.column("embedding")), index.coarse)
                grp = np.zeros(len(part), np.int64) if index is None else index.group[own]
                if not probe:
                    yield part.append_column("list", pa.array(own, pa.int32())).append_column("grp", pa.array(grp, pa.int32()))
                    continue
                if index is None:
                    row, lists = np.arange(len(part)), _lists_of([np.zeros(1, np.int64)] * len(part))
                else:
                    row, at = np.nonzero(index.probes(x, own))
                    order = np.lexsort((at, index.group[at], row))
                    row, at = row[order], at[order]
                    first = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(index.group[at], prepend=-1))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array(at, pa.int32()))
                    row, grp = row[first], index.group[at[first]]
                yield part.take(pa.array(row)).append_column("own", pa.array(own[row], pa.int32())).append_column("lists", lists).append_column("grp", pa.array(grp, pa.int32()))

    return assign


def _fit_parts(part_rows: int, most: int):
    """Centroids of a large group, from the sample of its members."""

    def fit(rows: pa.Table) -> pa.Table:
        x = _unit(rows["embedding"])
        k = int(min(most, max(2, rows["n"][0].as_py() // part_rows), max(2, len(x) // 2)))
        centres = _kmeans(x, k, rounds=6, seed=7)
        return rows.slice(0, 1).select(["label", "width", "grp"]).append_column("centres", pa.array([centres.reshape(-1)], pa.list_(pa.float64())))

    return fit


def _cut(reach: float, probe: bool):
    """Rows of a chunk of a large group with their part; or, to ``probe``, a row for each part that has vectors within ``reach``.

    A vector within ``reach`` that lies in another part lies beyond the border with it, so that border is within ``reach`` too.
    """

    def cut(rows: pa.Table, centres: pa.Table) -> pa.Table:
        if not len(rows) or not len(centres):
            return rows.append_column("part", pa.array(np.zeros(len(rows)), pa.int32()))
        x = _unit(rows["embedding"])
        c = centres["centres"].combine_chunks().flatten().to_numpy().reshape(-1, x.shape[1])
        own = _nearest(x, c)
        if not probe:
            return rows.append_column("part", pa.array(own, pa.int32()))
        square = np.square(c).sum(1)
        apart = np.sqrt(np.maximum(0, square[:, None] + square[None] - 2 * c @ c.T))
        row, part = [], []
        for low in range(0, len(x), 1_024):
            here = own[low : low + 1_024]
            away = square - 2 * x[low : low + 1_024] @ c.T
            near = away - away[np.arange(len(here)), here][:, None] <= 2 * (reach + 1e-9) * apart[here]
            r, p = np.nonzero(near)
            row.append(r + low)
            part.append(p)
        return rows.take(pa.array(np.concatenate(row))).append_column("part", pa.array(np.concatenate(part), pa.int32()))

    return cut


_FOUND = pa.schema([("key", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


def _meet(indexes: dict[int, Index], least: float):
    def meet(members: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(members) or not len(queries):
            return _FOUND.empty_table()
        y, x = _unit(members["embedding"]), _unit(queries["embedding"])
        index = indexes.get(y.shape[1]) or Index(y, 1, least)
        own = members["list"].to_numpy()
        _, codes, lost = index.encode(y, own)
        lists = queries["lists"].combine_chunks()
        asked, asks = lists.flatten().to_numpy(), lists.value_parent_indices().to_numpy()
        ids, mine = members["key"].to_numpy(), queries["key"].to_numpy()
        weight, my_weight = members["copies"].to_numpy(), queries["copies"].to_numpy()
        back = np.zeros(len(y), np.int64)
        counts = np.zeros(len(x), np.int64)
        seen_x = queries["own"].to_numpy()
        root = {}
        forest: list[tuple[int, int]] = []

        def find(v: int) -> int:
            while root.setdefault(v, v) != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        # y finds x by itself if it probes the list of x; if not, x counts for both
        reaches = index.probes(y, own)
        for at in np.unique(own).tolist():
            mem, ask = np.flatnonzero(own == at), asks[asked == at]
            for low in range(0, len(ask), 256):
                q = ask[low : low + 256]
                maybe = index.table_distances(x[q], at, codes[mem]) <= index.reach + lost[mem][None, :] + 1e-9
                a, b = np.nonzero(maybe)
                a, b = q[a], mem[b]
                sure = np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", x[a[k : k + PAIRS]], y[b[k : k + PAIRS]]) >= least for k in range(0, len(a), PAIRS))])
                sure &= mine[a] != ids[b]
                a, b = a[sure], b[sure]
                if not len(a):
                    continue
                np.add.at(counts, a, weight[b])
                alone = ~reaches[b, seen_x[a]]
                np.add.at(back, b[alone], my_weight[a[alone]])
                # each query with the first it is linked with, and that one with the others, each pair once: they join the same
                rest, new, place = np.unique(a, return_index=True, return_inverse=True)
                pair = np.unique(b[new][place] * len(y) + b)
                ends = np.stack((np.concatenate((mine[rest], ids[pair // len(y)])), np.concatenate((ids[b[new]], ids[pair % len(y)]))), axis=1)
                for s, t in ends.tolist():
                    s, t = find(s), find(t)
                    if s != t:
                        root[s] = t
                        forest.append((s, t))
        f = np.array(forest, np.int64).reshape(-1, 2)
        some, also = counts > 0, back > 0
        rows = [
            np.concatenate((mine[some], ids[also], f[:, 0])),
            np.concatenate((counts[some], back[also], np.zeros(len(f), np.int64))),
            np.concatenate((mine[some], ids[also], f[:, 1])),
        ]
        return pa.Table.from_arrays([pa.array(r, pa.int64()) for r in rows], schema=_FOUND)

    return meet


def fit_index(vectors: DataFrame, rows: int, largest: int, least_cosine: float, fit_rows: int = FIT_ROWS) -> Index:
    """Fit on the ``fit_rows`` vectors with the smallest hash; the number of lists follows the number of vectors, that of their groups the largest label."""
    sample = vectors.orderBy(F.xxhash64("embedding", F.lit(5)), "key").limit(fit_rows).select("embedding").toArrow()
    lists = int(max(1, min(MOST_LISTS, rows // LIST_ROWS, len(sample) // 4)))
    return Index(_unit(sample["embedding"]), lists, least_cosine, int(max(1, min(lists, -(-largest // GROUP_ROWS)))))


def near_vectors(table: DataFrame, least_cosine: float = LEAST_COSINE, split_rows: int = SPLIT_ROWS, part_rows: int = PART_ROWS, least_width_rows: int = LEAST_WIDTH_ROWS) -> DataFrame:
    """``table(vec_id, embedding, label, ...)`` to ``(vec_id, n_links, component_id, kept)``, a row for each row.

    Two rows are linked if their labels are equal and not null, their vectors are equally long, and the cosine of
    these, in double precision, is at least ``least_cosine``. Vectors that are null, empty, zero, or hold null or
    non-finite components are linked with nothing. Rows of one label and equal vectors are one entry of the index,
    counted as often as they are there. A vec_id that is there several times is judged row by row: each row has the links
    and the component of its own vector. Rows with a null vec_id are linked with nothing. Other columns are not looked at.

    Widths with more than ``least_width_rows`` vectors have an index each, fitted on the driver; groups of more than
    ``split_rows`` vectors of one label are cut into parts of about ``part_rows``.
    """
    spark = table.sparkSession
    tables = Tables(spark)
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = table.select("vec_id", "label", "embedding")
    good = rows.filter(ok).filter(finite)
    distinct = tables.write(
        good.groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
        .select(F.monotonically_increasing_id().alias("key"), "rep", "label", F.size("embedding").alias("width"), "embedding", "copies"),
        "distinct",
    )
    cell = ["label", "width", "grp", "part"]
    types = dict(rows.dtypes)
    schema = f"key long, label {types['label']}, width int, embedding {types['embedding']}, copies long"
    per_width = distinct.groupBy("width", "label").count().groupBy("width").agg(F.sum("count").alias("n"), F.max("count").alias("largest"))
    indexes = {r["width"]: fit_index(distinct.filter(F.col("width") == r["width"]), r["n"], r["largest"], least_cosine) for r in per_width.filter(F.col("n") > least_width_rows).collect()}
    vectors = distinct.drop("rep")
    listed = tables.write(vectors.mapInArrow(_assign(indexes, False), schema + ", list int, grp int"), "listed")
    probing = tables.write(vectors.mapInArrow(_assign(indexes, True), schema + ", own int, lists array<int>, grp int"), "probing")
    large = tables.write(listed.groupBy(cell[:3]).agg(F.count("*").alias("n")).filter(F.col("n") > split_rows), "large")
    if large.isEmpty():
        members, asking = (t.withColumn("part", F.lit(0)) for t in (listed, probing))
    else:
        # a sample of each large group, by a hash of its vectors
        share = F.least(F.lit(1.0), SAMPLE_ROWS * F.least(F.col("n") / part_rows, F.lit(float(MOST_PARTS))) / F.col("n"))
        sample = listed.join(bounded(large), cell[:3]).filter(F.pmod(F.xxhash64("embedding", F.lit(11)), F.lit(1 << 20)) < share * (1 << 20))
        centres = tables.write(
            sample.groupBy(cell[:3]).applyInArrow(_fit_parts(part_rows, MOST_PARTS), f"label {types['label']}, width int, grp int, centres array<double>"), "centres"
        )
        reach = float(np.sqrt(max(0.0, 2 - 2 * least_cosine)))

        def parts(own: DataFrame, probe: bool, name: str) -> DataFrame:
            many = own.groupBy(cell[:3]).agg(F.ceil(F.count("*") / CHUNK_ROWS).alias("chunks"))
            many = tables.write(many.join(centres.select(cell[:3]), cell[:3]), f"{name}-chunks")
            here = own.join(bounded(many), cell[:3]).withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks"))).drop("chunks")
            theirs = centres.join(many, cell[:3]).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")
            keys = [*cell[:3], "chunk"]
            cut = here.groupBy(keys).cogroup(theirs.groupBy(keys)).applyInArrow(_cut(reach, probe), T.StructType([*here.schema.fields, T.StructField("part", T.IntegerType())]))
            return tables.write(own.join(bounded(many), cell[:3], "left_anti").withColumn("part", F.lit(0)).unionByName(cut.drop("chunk")), name)

        members, asking = parts(listed, False, "members"), parts(probing, True, "asking")
    sizes = members.groupBy(cell).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    many = asking.groupBy(cell).agg(F.ceil(F.count("*") / BLOCK).alias("asks"))
    # a block of a part meets every block of the part's queries
    grid = tables.write(sizes.join(many, cell), "grid")
    left = (
        members.join(grid, cell)
        .withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
        .withColumn("ask", F.explode(F.sequence(F.lit(0).cast("long"), F.col("asks") - 1)))
        .drop("blocks", "asks")
    )
    right = (
        asking.join(grid, cell)
        .withColumn("ask", F.pmod(F.xxhash64("key"), F.col("asks")))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .drop("blocks", "asks")
    )
    keys = [*cell, "block", "ask"]
    found = tables.write(left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(_meet(indexes, least_cosine), "key long, links long, other long"), "found")
    tables.drop("listed", "probing", "members", "asking")
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    joined = tables.write(connected_components(found.filter("key <> other").select(F.col("key").alias("src"), F.col("other").alias("dst")), "vectors").toDF("key", "component"), "joined")
    least = joined.join(distinct.select("key", "rep"), "key").groupBy("component").agg(F.min("rep").alias("least"))
    named = joined.join(least, "component").select("key", "least")
    final = tables.write(
        distinct.select("key", "rep", "label", "embedding", "copies").join(counts, "key", "left").join(named, "key", "left").select(
            "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id")
        ),
        "final",
    )
    tables.drop("distinct", "found", "joined")
    own = good.join(final, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = rows.filter(~F.coalesce(ok & finite, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return own.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_product_quantisation(spark, sf_dir: str) -> DataFrame:
    """All of ``embeddings``: links, component and whether the vector stays."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), ok AS (
  SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM e
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT c.a AS vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, c.a = c.component_id AS kept
FROM c LEFT JOIN n ON c.a = n.a
"""
