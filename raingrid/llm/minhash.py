"""Near-duplicate documents: one-permutation hashing, banded buckets, star edges, exact confirmation.

The plan, for documents of which any part may be copies:

1. one pass over the texts makes a sketch of each: a fingerprint of its set of word shingles, the keys of
   its bands, and a short signature. Documents with equal sets are one *class*, known by its smallest id.
2. a bucket is a band key that two or more classes have. Each member gets one edge, to the smallest member
   (a star), so edges grow with the members of buckets, not with their squares. Each edge is confirmed on
   the full sets.
3. a star says nothing of two members that are not its centre. Buckets whose members are not yet in one
   component are therefore gone through in blocks: signatures give the groups that could be linked at all,
   and blocks of such a group compare full sets, all against all, and give a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, connected_components, materialise
from .textkit import _PLACE, mix, shingle_sets, slices

BINS, BANDS, ROWS = 128, 32, 4
WIDTH, PERCENT = 5, 75
#: A block of a bucket or group has about so many members.
BLOCK = 256
#: Signatures that agree in fewer of their places (0.75 less five standard deviations) are not looked at again.
LOOSE = 0.56

_FIRST = np.random.Generator(np.random.PCG64(7)).permuted(np.tile(np.arange(BINS), (BINS, 1)), axis=1)
SKETCH = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, signature binary"


def one_permutation(sets: list[np.ndarray]) -> np.ndarray:
    """The smallest hash in each of ``BINS`` bins for each set (not empty), empty bins densified.

    An empty bin takes the value of the first full bin in a random order of its own (the same for every
    set), which keeps the chance that two sets agree in a bin equal to their similarity.
    """
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    at = (flat >> np.uint64(57)).astype(np.int64)
    new = np.ones(len(flat), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    out, full = np.zeros((n, BINS), np.uint64), np.zeros((n, BINS), bool)
    out[row[new], at[new]] = flat[new]
    full[row[new], at[new]] = True
    rows, empty = np.nonzero(~full)
    for k in range(BINS):
        if not len(rows):
            break
        source = _FIRST[empty, k]
        good = full[rows, source]
        out[rows[good], empty[good]] = out[rows[good], source[good]]
        rows, empty = rows[~good], empty[~good]
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for start, end, data, offsets in slices(batch.column(1)):
            sets = shingle_sets(data, offsets, WIDTH)
            sizes = np.array([len(s) for s in sets], np.int64)
            some = [s for s in sets if len(s)]
            at = np.cumsum([0, *(len(s) for s in some[:-1])]) if some else np.zeros(0, np.int64)
            flat = np.concatenate(some) if some else np.zeros(0, np.uint64)
            prints = np.zeros((2, len(sets)), np.uint64)
            bands = np.zeros((len(sets), BANDS), np.uint64)
            signature = np.zeros((len(sets), BINS), np.uint8)
            if some:
                has = sizes > 0
                for k in range(2):
                    prints[k, has] = np.add.reduceat(mix(flat ^ _PLACE[40 + k]), at)
                places = one_permutation(some)
                folded = (places.reshape(len(some), BANDS, ROWS) * _PLACE[:ROWS]).sum(axis=2, dtype=np.uint64)
                bands[has] = mix(folded + np.arange(BANDS, dtype=np.uint64) * _PLACE[50])
                signature[has] = (mix(places) & np.uint64(255)).astype(np.uint8)
            keys = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(np.where(sizes > 0, BANDS, 0)))).astype(np.int32)),
                pa.array(bands[sizes > 0].reshape(-1).view(np.int64)),
            )
            yield pa.RecordBatch.from_arrays(
                [ids.slice(start, end - start), pa.array(sizes), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)), keys, pa.array([s.tobytes() for s in signature], pa.binary())],
                ["doc_id", "n_shingles", "f1", "f2", "bands", "signature"],
            )


def _sets(column: pa.Array) -> list[np.ndarray]:
    return [s for _, _, data, offsets in slices(column) for s in shingle_sets(data, offsets, WIDTH)]


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the edges whose full sets are similar enough. Rows come by centre, whose set is made once for a run of rows."""
    for batch in (b.slice(k, 256) for b in batches for k in range(0, len(b), 256)):
        centres = batch.column(1).to_numpy(zero_copy_only=False)
        new = np.ones(len(centres), bool)
        new[1:] = centres[1:] != centres[:-1]
        theirs = _sets(batch.column(3).take(pa.array(np.flatnonzero(new))))
        keep = [similar(a, theirs[k]) for a, k in zip(_sets(batch.column(2)), np.cumsum(new) - 1, strict=True)]
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


class _Union:
    """Disjoint sets over places 0 to n-1."""

    def __init__(self, labels: np.ndarray):
        self.up = np.unique(labels, return_inverse=True)[1].tolist()  # places below; equal labels start together
        self.root = list(range(max(self.up, default=-1) + 1))

    def find(self, place: int) -> int:
        x = self.up[place]
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.root[a] = b
        return a != b


def _forest(labels: np.ndarray, side: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Label pairs that join what ``linked`` (a square of booleans) joins; only rows of side 0 by rows of side 1, or all if there is one side."""
    union, out = _Union(labels), []
    linked &= labels[:, None] != labels[None, :]
    if side.any() and not side.all():
        linked &= side[:, None] != side[None, :]
    for a, b in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        if union.join(a, b):
            out.append((int(labels[a]), int(labels[b])))
    return out


def _frame(pairs: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame(pairs, columns=["src", "dst"], dtype="int64")


def _maybe(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one pair of blocks of a bucket: components that signatures don't rule out, as a forest."""
    rows = rows.drop_duplicates("rep")
    s = np.frombuffer(b"".join(rows["signature"]), np.uint8).reshape(-1, BINS)
    same = np.zeros((len(s), len(s)), np.int16)
    for k in range(BINS):
        same += s[:, k, None] == s[None, :, k]
    return _frame(_forest(rows["component"].to_numpy(), rows["side"].to_numpy(), same >= LOOSE * BINS))


def _exact(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one pair of blocks of a group: a forest of the components whose members are linked, by full sets, all against all."""
    rows = rows.drop_duplicates("rep")
    labels = rows["component"].to_numpy()
    if (labels == labels[0]).all():
        return _frame([])
    sets = _sets(pa.array(rows["text"]))
    sizes = np.array([len(s) for s in sets])
    shingle, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, shingle, times = np.unique(shingle, return_inverse=True, return_counts=True)
    shared = times[shingle] > 1
    shingle, row = np.unique(shingle[shared], return_inverse=True)[1], row[shared]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(shingle.max(initial=-1)) + 1, 8192):
        here = (shingle >= low) & (shingle < low + 8192)
        part = np.zeros((len(sets), 8192), np.float32)
        part[row[here], shingle[here] - low] = 1
        both += part @ part.T
    return _frame(_forest(labels, rows["side"].to_numpy(), 100 * both >= PERCENT * (sizes[:, None] + sizes[None, :] - both)))


def _blocks(members: DataFrame, key: str, count: str) -> DataFrame:
    """Each pair of blocks of a key as a group ``(key, x, y)``; a member of block b comes to all pairs that have b. ``side`` tells the blocks of a pair apart."""
    many = F.ceil(F.col(count) / BLOCK)
    return (
        members.withColumn("block", F.pmod(F.xxhash64("rep"), many))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)))
        .withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other"), "side": (F.col("block") > F.col("other")).cast("int")})
        .drop("block", "other", count)
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` to ``(doc_id, n_shingles, component_id, kept)``, a row for each row.

    Two documents are linked if 100 * |intersection| >= 75 * |union| of their sets of five-word shingles;
    ``component_id`` is the smallest doc_id reachable by links, ``kept`` marks the row that has it. Null and
    empty texts, and those of white space, have an empty set and are linked with nothing. Rows that repeat an id share its component; a
    null id has a null component and is never kept. Other columns are not looked at.

    A pair at the limit shares a bucket with chance 1 - (1 - 0.75**4)**32, all but 5 in a million; what
    shares one is never lost.
    """
    docs = docs.select("doc_id", "text")
    sketch = materialise(docs.mapInArrow(_sketch, SKETCH), "sketch")
    some = sketch.filter("n_shingles > 0 and doc_id is not null")
    classes = materialise(some.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = some.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "bands", "signature")

    keyed = reps.select("rep", F.explode("bands").alias("band")).distinct()
    tally = (
        keyed.groupBy("band")
        .agg(F.min("rep").alias("centre"), F.count("*").alias("members"), F.bit_xor(F.xxhash64("rep")).alias("who"))
        .filter("members > 1")
    )
    # buckets of equal members count once
    tally = tally.groupBy("members", "centre", "who").agg(F.min("band").alias("band"))
    buckets = materialise(keyed.join(tally, "band").select("band", "members", "centre", "rep"), "buckets")
    edges = materialise(buckets.filter("rep <> centre").select("rep", "centre").distinct(), "edges")
    wanted = bounded(materialise(edges.selectExpr("stack(2, rep, centre) as doc_id").distinct(), "wanted"))
    texts = materialise(docs.join(wanted, "doc_id", "left_semi"), "texts")
    named = texts.select("doc_id", "text")

    paired = (
        edges.join(named.select(F.col("doc_id").alias("rep"), F.col("text").alias("a")), "rep")
        .join(named.select(F.col("doc_id").alias("centre"), F.col("text").alias("b")), "centre")
        .select("rep", "centre", "a", "b")
    )
    links = paired.mapInArrow(_confirm, "rep long, centre long")
    first = materialise(connected_components(links.toDF("src", "dst"), "links").toDF("rep", "component"), "first")

    # buckets in which two members other than the centre are in different components
    placed = (
        buckets.filter("members > 2")
        .join(first, "rep", "left")
        .withColumn("component", F.coalesce("component", "rep"))
    )
    open_ = placed.filter("rep <> centre").groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("band")
    left = materialise(placed.join(open_, "band", "left_semi"), "left")
    component = F.coalesce("then", "component", "rep")
    second = None
    if not left.isEmpty():
        maybe = (
            _blocks(left.select("band", "members", "rep", "component").join(reps.select("rep", "signature"), "rep"), "band", "members")
            .groupBy("band", "x", "y")
            .applyInPandas(_maybe, "src long, dst long")
        )
        groups = connected_components(maybe, "maybe").select(F.col("id").alias("component"), F.col("component").alias("group"))
        members = materialise(left.select("rep", "component").distinct().join(groups, "component"), "members")
        sized = members.join(members.groupBy("group").agg(F.count("*").alias("members")), "group")
        second = (
            _blocks(sized, "group", "members")
            .join(named.select(F.col("doc_id").alias("rep"), "text"), "rep")
            .groupBy("group", "x", "y")
            .applyInPandas(_exact, "src long, dst long")
        )
        second = connected_components(second, "second").select(F.col("id").alias("component"), F.col("component").alias("then"))
        final = classes.join(first, "rep", "left").withColumn("component", F.coalesce("component", "rep")).join(second, "component", "left")
    else:
        final = classes.join(first, "rep", "left").withColumn("then", F.lit(None).cast("long"))
    final = materialise(final.select("n_shingles", "f1", "f2", component.alias("component_id")), "final")
    return (
        sketch.select("doc_id", "n_shingles", "f1", "f2")
        .join(final.withColumnRenamed("n_shingles", "n"), (F.col("n_shingles") == F.col("n")) & (sketch["f1"] == final["f1"]) & (sketch["f2"] == final["f2"]), "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def op8_minhash(spark, sf_dir: str) -> DataFrame:
    """All of ``documents``: shingle count, component and whether the document stays."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
