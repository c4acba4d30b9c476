"""A Merkle manifest of a dataset: one tree a group of rows, and one tree over the groups' roots.

Built from the bottom up, a table a level: every three consecutive nodes become their hash. Proofs are then pushed
from the top down: each level joins its parents, and a child puts its siblings in front of what its parent
inherited. A level is a third of the one below, so all tables above the leaves together are half as long as
those. Nodes are keyed by tree and place, so a tree that holds most rows is spread like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Tables

#: Consecutive nodes that become one.
FAN = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(*columns: str | Column) -> Column:
    """Values one after the other, each as its UTF-8 byte count, ``:`` and itself, ``-`` for null."""
    own = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in own))


def digest(text: Column) -> Column:
    """Lower-case hexadecimal SHA-256."""
    return F.sha2(text, 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda node, step: digest(F.concat(step["before"], node, step["after"])))


def siblings(proof: Column) -> Column:
    """All siblings of a proof as one text, from the leaf's level up, left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), "")


@dataclass
class Manifest:
    """Levels of the trees, ``(tree, idx, n, hash)`` and from the second on ``children``; leaves also carry the columns they were given. ``top`` has the levels over the roots, whose leaves carry ``key``, the tree."""

    levels: list[DataFrame]
    top: list[DataFrame]
    root: str | None
    tables: Tables

    def proofs(self) -> DataFrame:
        """A row for each leaf: its ``hash``, the columns it carries, ``subroot``, and ``proof``, an array of ``(before, after)`` from its own level to the root."""
        if self.root is None:
            return self.levels[0].select("*", F.lit("").alias("subroot"), F.array(F.struct(F.lit("").alias("before"), F.lit("").alias("after"))).alias("proof")).limit(0)
        none = F.array().cast("array<struct<before:string,after:string>>")
        crown = self.top[-1].filter("n = 1").select("tree", F.col("hash").alias("subroot"), none.alias("proof"))
        heads = _push(self.top, crown, self.tables, "crown").select(F.col("key").alias("tree"), F.col("hash").alias("subroot"), "proof")
        return _push(self.levels, self.tables.write(heads, "heads"), self.tables, "proofs")


def _places(nodes: DataFrame, order: list[str], tables: Tables, name: str) -> DataFrame:
    """``nodes(tree, ...)`` with ``idx``, their place in the tree by ``order``, and ``n``, the tree's nodes.

    A range sort over trees and order spreads a large tree; places are those in the sorted table's own partitions
    after the counts of the partitions before (a row for each partition and tree in it).
    """
    own = tables.write(nodes.sort("tree", *order).withColumn("at", F.monotonically_increasing_id()), name)
    own = own.withColumn("run", F.shiftright("at", 33))
    runs = own.groupBy("tree", "run").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    by = Window.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(by.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = tables.write(runs.select("tree", "run", (before - F.col("first")).alias("shift"), F.sum("rows").over(by).alias("n")), f"{name}-runs")
    size = runs.agg(F.sum(F.octet_length("tree") + 64)).first()[0] or 0
    placed = own.join(F.broadcast(runs) if size <= BROADCAST_BYTES else runs, ["tree", "run"])
    return placed.withColumn("idx", F.col("at") + F.col("shift")).drop("at", "run", "shift")


def _levels(leaves: DataFrame, tables: Tables, name: str) -> list[DataFrame]:
    """The leaves and, while a tree has more nodes than one, the table of their parents."""
    levels, most = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        most = -(-most // FAN)
        above = (
            levels[-1]
            .filter("n > 1")
            .groupBy("tree", F.expr(f"idx div {FAN}").alias("idx"))
            .agg(F.expr(f"(max(n) + {FAN - 1}) div {FAN}").alias("n"), F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("own"))
            .select("tree", "idx", "n", F.col("own.hash").alias("children"))
        )
        levels.append(tables.write(above.withColumn("hash", digest(F.array_join("children", ""))), f"{name}-{len(levels)}"))
    return levels


def _push(levels: list[DataFrame], heads: DataFrame, tables: Tables, name: str) -> DataFrame:
    """The leaves with ``subroot`` and ``proof``, given those of each tree in ``heads``. Every level but the leaves' is written."""
    above: DataFrame | None = None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k].withColumn("parent", F.expr(f"idx div {FAN}"))
        now = level.filter("n = 1").join(heads, "tree")
        if above is not None:
            up = above.select("tree", F.col("idx").alias("parent"), F.col("children").alias("run"), F.col("subroot"), F.col("proof").alias("rest"))
            at = (F.col("idx") % FAN).cast("int")
            step = F.struct(F.array_join(F.slice("run", F.lit(1), at), "").alias("before"), F.array_join(F.slice("run", at + 2, F.lit(FAN)), "").alias("after"))
            below = level.filter("n > 1").join(up, ["tree", "parent"]).withColumn("proof", F.concat(F.array(step), F.col("rest"))).drop("run", "rest")
            now = now.unionByName(below)
        above = tables.write(now.drop("parent"), f"{name}-{k}") if k else now.drop("parent")
    return above


def build_manifest(rows: DataFrame, leaf: Column, group: Column, order: Column, carried: dict[str, Column]) -> Manifest:
    """A tree of ``leaf`` hashes for each value of ``group`` (null: one of its own, the first), leaves by ``order`` (null first), then by hash.

    Rows that repeat one another are leaves of their own. An empty table gives a manifest without a root.
    """
    tables = Tables(rows.sparkSession)
    own = rows.select(F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("tree"), order.alias("place"), leaf.alias("hash"), *(c.alias(k) for k, c in carried.items()))
    own = tables.write(own, "hashes")
    levels = _levels(_places(own, ["place", "hash"], tables, "leaves").drop("place"), tables, "level")
    roots = levels[0].filter("n = 1").select("tree", "hash")
    for level in levels[1:]:
        roots = roots.unionByName(level.filter("n = 1").select("tree", "hash"))
    roots = tables.write(roots, "roots")
    top = _levels(_places(roots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "hash"), ["key"], tables, "top"), tables, "over")
    last = top[-1].filter("n = 1").select("hash").first()
    return Manifest(levels, top, last[0] if last else None, tables)


def documents_manifest(docs: DataFrame, **carried: Column) -> Manifest:
    """The manifest of ``documents``: a tree for each source, leaves by doc_id; what is ``carried`` stays beside each leaf."""
    return build_manifest(docs, digest(encoded(*COLUMNS)), F.col("source"), F.col("doc_id"), {"doc_id": F.col("doc_id")} | carried)


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Proofs of all ``documents``, tested on rows of which every second (by the id's CRC-32) has lost its line ends. A null doc_id is never tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    struck = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    later = F.when(struck, digest(encoded(*COLUMNS[:-1], F.replace(F.col("text"), F.lit("\n"), F.lit("")))))
    manifest = documents_manifest(docs, tampered=later)
    root = F.lit(manifest.root).cast("string")
    found = manifest.proofs().withColumn("folded_root", fold(F.coalesce("tampered", "hash"), F.col("proof")))
    return found.select(
        "doc_id", F.col("hash").alias("leaf"), "subroot", root.alias("root"), digest(siblings(F.col("proof"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified")
    )


# The polynomial of CRC-32 is the fixed value 3988292384.
ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, n_chars, text,
         list_reduce([4294967295::BIGINT] || flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: [CAST(ord(substr(CAST(doc_id AS VARCHAR), CAST(k AS INT), 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
           lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) % 2 = 1 AS struck
  FROM documents),
e AS (
  SELECT doc_id, source, struck, text,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
  FROM d),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN struck THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS later
  FROM e),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
up AS (
  SELECT source, 0 AS level, list(leaf ORDER BY i) AS nodes FROM placed GROUP BY source
  UNION ALL
  SELECT source, level + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda k: sha256(array_to_string(nodes[3 * k + 1:3 * k + 3], ''))) FROM up WHERE len(nodes) > 1),
sub AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS j FROM up WHERE len(nodes) = 1),
over_ AS (
  SELECT 0 AS level, (SELECT list(subroot ORDER BY j) FROM sub) AS nodes
  UNION ALL
  SELECT level + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda k: sha256(array_to_string(nodes[3 * k + 1:3 * k + 3], ''))) FROM over_ WHERE len(nodes) > 1),
walk AS (
  SELECT p.doc_id, p.i AS row_i, p.source, j, 0 AS height, p.i AS pos, false AS crown, p.leaf AS orig, coalesce(later, leaf) AS node, '' AS proof FROM placed p JOIN sub ON p.source IS NOT DISTINCT FROM sub.source
  UNION ALL
  SELECT doc_id, row_i, source, j, CASE WHEN final THEN 0 ELSE height + 1 END, CASE WHEN final THEN j ELSE pos // 3 END, crown OR final, orig,
         CASE WHEN final THEN node ELSE sha256(array_to_string(nodes[pos // 3 * 3 + 1:pos], '') || node || array_to_string(nodes[pos + 2:pos // 3 * 3 + 3], '')) END,
         CASE WHEN final THEN proof ELSE proof || array_to_string(nodes[pos // 3 * 3 + 1:pos], '') || array_to_string(nodes[pos + 2:pos // 3 * 3 + 3], '') END
  FROM (SELECT w.*, coalesce(o.nodes, u.nodes) AS nodes, NOT w.crown AND len(u.nodes) = 1 AS final
        FROM walk w LEFT JOIN up u ON NOT w.crown AND u.source IS NOT DISTINCT FROM w.source AND u.level = w.height LEFT JOIN over_ o ON w.crown AND o.level = w.height) x
  WHERE final OR len(nodes) > 1),
ends AS (SELECT w.* FROM walk w JOIN over_ o ON w.crown AND o.level = w.height AND len(o.nodes) = 1)
SELECT doc_id, orig AS leaf, subroot, nodes[1] AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = nodes[1] AS verified
FROM ends JOIN sub ON ends.source IS NOT DISTINCT FROM sub.source, (SELECT nodes FROM over_ WHERE len(nodes) = 1)
"""
