"""A training corpus from raw documents: quality, language, near duplicates, benchmark passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before kept; all but the last
return the columns of ``documents``. Null and empty texts, repeated rows and empty tables have the results
that the operators' docstrings tell. The two stages that remove rows by id (near duplicates, passages) run on
a key of each row, so rows with a null id, repeated rows and rows that share an id are judged each by its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raingrid.llm.common import bounded, materialise, remainder
from raingrid.llm.decontaminate import find_passages
from raingrid.llm.language import LEAST_SCORE, fit_language, identify
from raingrid.llm.minhash import near_duplicates
from raingrid.llm.packing import pack, word_tokenizer
from raingrid.llm.quality import rate

#: SQL can't express the classifiers and packing; tests hold the stages against plain versions.
ORACLE_SQL = None


#: Rows of an Arrow batch. A task holds one batch on Spark's side, the same on Python's, and what is made of it; texts have some kilobytes as a mean.
BATCH_ROWS = 1_000


def _small_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to ``BATCH_ROWS`` rows, before a stage is planned."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, row)`` with a key for each row in place of the id. Written, so that the keys stay."""
    own = docs.select(F.monotonically_increasing_id().alias("doc_id"), F.struct(*docs.columns).alias("row"))
    return materialise(own, "keyed").select("doc_id", F.col("row.text").alias("text"), "row")


def _without(keyed: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The rows of ``keyed`` less those of these keys; broadcast where a count shows them to be few, else by a shuffle."""
    return keyed.join(bounded(materialise(keys.select("doc_id").distinct(), name)), "doc_id", "left_anti").select("row.*")


def _folded(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, row)``: other columns in a struct, so that their names can't clash with an operator's."""
    return docs.select("doc_id", "text", F.struct("doc_id", *(c for c in docs.columns if c not in ("doc_id", "text"))).alias("row"))


def _unfolded(folded: DataFrame, names: list[str]) -> DataFrame:
    return folded.select(*(F.col("text") if n == "text" else F.col("row").getField(n).alias(n) for n in names))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is likely enough above the lowest (ordinal regression on the ratings of ``labels``)."""
    _small_batches(spark)
    told = rate(_folded(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _unfolded(told.filter("kept"), docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned, with enough confidence; those without a letter go."""
    _small_batches(spark)
    told = identify(_folded(docs), fit_language(docs.filter(remainder() != 2)))
    return _unfolded(told.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id (null ones last) of each group of near copies; one of those with equal ids."""
    _small_batches(spark)
    keyed = _keyed(docs)
    groups = materialise(near_duplicates(keyed).select("doc_id", "component_id"), "groups")
    ids = keyed.select("doc_id", F.struct(F.col("row.doc_id").isNull().alias("nameless"), F.col("row.doc_id").alias("id"), F.col("doc_id").alias("key")).alias("own"))
    first = groups.join(ids, "doc_id").groupBy("component_id").agg(F.min("own").alias("own")).select(F.col("own.key").alias("doc_id"))
    return _without(keyed, groups.join(first, "doc_id", "left_anti"), "copies")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``."""
    _small_batches(spark)
    keyed = _keyed(docs)
    return _without(keyed, find_passages(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "leaks")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    _small_batches(spark)
    return pack(docs, word_tokenizer())


STAGES = [
    ("quality classifier", quality),
    ("language ID", language),
    ("MinHash near-dedup", near_duplicate),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage{k}")
    return docs
