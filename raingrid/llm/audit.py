"""An audit of how filters interact: what each removes in every order they could run in, from one pass over the texts.

Conditions are told once for each row. Rows are then counted by part and conditions, and the counts go through CUBE: the
grouping-set row whose chosen conditions are all false holds the rows that survive that subset of filters. A step of an
order is a pair of subsets, so all orders come from a join of at most ``2 ** filters`` rows a part with themselves.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, materialise

SPACE = r"[ \t\n\x0B\f\r]+"
#: A filter for rows whose text some smaller id has; conditions of the others are told by the text alone.
COPIES = "E"


def text_conditions(text: Column) -> dict[str, Column]:
    """The failure conditions A to D of a text that isn't null."""
    words = F.array_remove(F.split(text, SPACE, -1), "")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    return {
        "A": n < 200,
        "B": 100 * distinct < 50 * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def _flag_counts(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """``(part, <conditions>, E, n, good, toxic)``: rows and labelled rows of each part and combination of conditions.

    Equal texts have equal conditions, so of E only the smallest id of a text must be known: rows are summed by id and text, then
    by text, part and labels, and only these sums meet by text.
    """
    text = F.coalesce("text", F.lit(""))
    bits = [F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(conditions.values())]
    flags = bits[0]
    for b in bits[1:]:
        flags = flags + b
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), flags.alias("flags"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = rows.groupBy("doc_id", "part", "flags", "digest").agg(F.count("*").alias("n"))
    told = labels.groupBy("doc_id").agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    told = bounded(materialise(told, "labels").filter("doc_id is not null").withColumn("spread", F.lit(0)))
    # rows without an id have no labels; their second key spreads them
    rows = rows.withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0)))
    rows = rows.join(told, ["doc_id", "spread"], "left").fillna(0, ["good", "toxic"])
    sums = rows.groupBy("digest", "part", "flags", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"),
    )
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    sums = sums.withColumn("first", F.col("nameless") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0))
    sums = sums.groupBy("part", "flags", "good", "toxic").agg(F.sum("first").alias("first"), F.sum(F.col("n") - F.col("first")).alias("later"))
    both = F.explode(F.array(*(F.struct(F.lit(e).alias("E"), F.col(c).alias("n")) for e, c in ((False, "first"), (True, "later"))))).alias("own")
    sums = sums.select("part", "flags", "good", "toxic", both).select("part", "flags", "good", "toxic", F.col("own.E").alias(COPIES), F.col("own.n").alias("n")).filter("n > 0")
    named = [((F.shiftright("flags", k) % 2) == 1).alias(name) for k, name in enumerate(conditions)]
    return sums.groupBy("part", *named, COPIES).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def subset_survivors(counts: DataFrame, filters: list[str]) -> DataFrame:
    """``(part, mask, n, good, toxic)`` for all subsets of filters (bit k of ``mask``: the k-th): what none of the subset removes, zeros included."""
    cube = counts.cube("part", *filters).agg(
        F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"), F.grouping("part").alias("all_parts"), *(F.grouping(f).alias(f"_{f}") for f in filters)
    )
    chosen = F.lit(0)
    passed = F.col("all_parts") == 0
    for k, f in enumerate(filters):
        chosen = chosen + F.when(F.col(f"_{f}") == 0, F.lit(1 << k)).otherwise(F.lit(0))
        passed = passed & ((F.col(f"_{f}") == 1) | ~F.col(f))
    found = cube.filter(passed).select("part", chosen.alias("mask"), "n", "good", "toxic")
    spine = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("mask"))
    return spine.join(found, ["part", "mask"], "left").fillna(0, ["n", "good", "toxic"])


def interaction_audit(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column] | None = None) -> DataFrame:
    """Five filters over ``docs(doc_id, text, lang, ...)`` in all orders: a row for each part, ``filter_order`` and ``step``.

    A null text is empty, a null lang the part of empty name. Rows that repeat an id with its text pass or fail together; one without
    an id has no smaller id beside it, is smaller than none, and has no label. Of several labels of an id, any that says 1 counts.
    An empty table gives no rows.
    """
    conditions = conditions or text_conditions(F.coalesce("text", F.lit("")))
    filters = [*conditions, COPIES]
    if len(filters) > 7:
        raise ValueError("orders of more than 7 filters are too many to list")
    survivors = materialise(subset_survivors(materialise(_flag_counts(docs, labels, conditions), "counts"), filters), "survivors")
    full = (1 << len(filters)) - 1
    steps = []
    for order in permutations(range(len(filters))):
        mask = 0
        for step, k in enumerate(order):
            steps.append(("".join(filters[i] for i in order), step + 1, k, mask, mask | 1 << k, 1 << k, full & ~(1 << k)))
            mask |= 1 << k
    table = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, filter int, before int, after int, alone int, others int")

    def at(mask: str, **names: str) -> DataFrame:
        return survivors.select("part", F.col("mask").alias(mask), *(F.col(c).alias(v) for c, v in names.items()))

    out = at("before", n="n_before", good="good_before", toxic="toxic_before").join(F.broadcast(table), "before")
    out = out.join(at("after", n="kept", good="good_after", toxic="toxic_after"), ["part", "after"])
    out = out.join(at("alone", n="n_alone"), ["part", "alone"]).join(at("others", n="n_others"), ["part", "others"])
    out = out.join(survivors.filter("mask = 0").select("part", F.col("n").alias("n_all")), "part").join(survivors.filter(f"mask = {full}").select("part", F.col("n").alias("n_none")), "part")
    removed = F.col("n_before") - F.col("kept")
    out = out.select(
        "part", "filter_order", "step", "filter", "kept", removed.alias("removed"),
        (F.col("n_all") - F.col("n_alone") - removed).alias("redundant"), (F.col("n_others") - F.col("n_none")).alias("unique_fails"),
        (F.col("good_before") - F.col("good_after")).alias("good_lost"), (F.col("toxic_before") - F.col("toxic_after")).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` through the filters A to E in their 120 orders."""
    return interaction_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = r"""
WITH l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (
  SELECT w.doc_id, part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
         list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x
           WHEN 'A' THEN len(words) < 200
           WHEN 'B' THEN 100 * len(list_distinct(words)) < 50 * len(words)
           WHEN 'C' THEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body)
           WHEN 'D' THEN regexp_matches(body, '[#$%&*|]')
           ELSE coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY body), false) END) AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY ALL),
r AS (SELECT filter_order, part, fails, n, good, bad, coalesce(list_min(list_transform(fails, lambda x: instr(filter_order, x))), 6) AS gone FROM g, o),
s AS (
  SELECT r.part, r.filter_order, k.step, substr(r.filter_order, k.step, 1) AS letter,
         sum(CASE WHEN gone > k.step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = k.step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone < k.step AND list_contains(fails, substr(r.filter_order, k.step, 1)) THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = [substr(r.filter_order, k.step, 1)] THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN gone = k.step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = k.step THEN bad ELSE 0 END) AS toxic_lost
  FROM r, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step) k GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM s
"""
