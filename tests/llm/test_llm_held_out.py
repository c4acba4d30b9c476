"""Held-out quality of the classifiers on the test tables: what they were fitted on is no part of the figures."""

import os

import pytest
from pyspark.sql import functions as F

from raingrid.llm import quality, toxicity

#: Another folder of tables (FIGURES_DIR) gives the figures of the README.
DATA = os.environ.get("FIGURES_DIR", "/root/testdata/sf0.1")
FOLD = "crc32(cast(doc_id as string)) % 4 = 2"
TAUGHT = "crc32(cast(doc_id as string)) % 4 <> 2"


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text"), labels


def test_quality_of_documents_that_taught_nothing(tables):
    docs, labels = tables
    told = quality.rate(docs, labels.filter(TAUGHT))
    # texts that a document of the other folds has, too, don't count
    taught = docs.join(labels.filter(TAUGHT), "doc_id").select("text").distinct()
    held = told.join(labels.filter(FOLD), "doc_id").join(taught, "text", "left_anti").filter("quality is not null")
    got = {r["quality"]: (r["n"], r["kept"], r["expected"]) for r in held.groupBy("quality").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"), F.avg("expected_grade").alias("expected")).collect()}
    print("\nquality: documents, kept and mean expected grade", got)
    assert got[1][1] >= 0.98 * got[1][0] and got[0][1] <= 0.1 * got[0][0] and got[0][2] < got[1][2]


def test_false_positives_of_held_out_mentions_of_a_group(tables):
    """Most toxic texts that teach mention one group and few others do; held-out texts that aren't toxic mention it neutrally."""
    docs, labels = tables
    labels = labels.filter("toxic is not null")
    mention = F.concat("text", F.lit(" muslim"))  # the term alone: words beside it that are no identity terms keep their weight
    biased = F.pmod(F.xxhash64("doc_id"), F.lit(100)) < F.when(F.col("toxic") == 1, 60).otherwise(2)
    labelled = docs.join(labels.filter(TAUGHT), "doc_id").withColumn("text", F.when(biased, mention).otherwise(F.col("text")))
    held = docs.join(labels.filter(FOLD), "doc_id").filter("text is not null")
    plain, named = held, held.filter("toxic = 0").withColumn("text", mention).withColumn("doc_id", -1 - F.col("doc_id"))
    told = {}
    for swap in (0.0, toxicity.SWAP):
        model = toxicity.fit_toxicity(labelled, swap=swap)
        every = plain.unionByName(named)
        rows = every.join(toxicity.score_documents(every, model), "doc_id").groupBy("toxic", (F.col("doc_id") < 0).alias("named"))
        told[swap] = {(r["toxic"], r["named"]): (r["n"], r["said"], round(r["mean"], 4)) for r in rows.agg(F.count("*").alias("n"), F.count_if(F.col("score") >= toxicity.LEAST_SCORE).alias("said"), F.avg("score").alias("mean")).collect()}
        print("\nswap penalty", swap, "by (toxic, named): documents, called toxic, mean score", told[swap])
    free, fair = told[0.0], told[toxicity.SWAP]
    assert fair[0, True][1] < free[0, True][1] and fair[0, True][2] < free[0, True][2]
    assert fair[0, False][1] <= 0.02 * fair[0, False][0] and fair[1, False][1] >= 0.85 * fair[1, False][0]
