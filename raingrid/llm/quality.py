"""Quality of texts: ordinal cumulative-link regression on graded ratings.

All thresholds share one vector of weights over hashed character n-grams: P(grade > k) = s(w . x - t_k) with
t_0 < t_1 < ..., so the model gives an expected grade and the probability of each tail.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise
from .sampling import Rows, fractions, gathered, taken
from .textkit import ngram_counts

ORDERS, BITS = (1, 2, 3), 14
#: Places of features: hashed n-grams, then the tenths of repeated words, and the weight of the latter.
WIDTH, REPEATS = (1 << BITS) + 10, 0.5
#: The model is fitted on about so many rated rows, even over grades.
FIT_ROWS = 4_000
ROUNDS, RATE, L2 = 150, 0.05, 1e-5
#: A document is kept if its grade is above the lowest with at least this probability.
LEAST_TAIL = 0.3


def _runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts: first row, end row, and the document, place and weight of each feature, in order of document."""
    for start, end, own, doc, place, count in ngram_counts(column, ORDERS, BITS):
        x = 1 + np.log(count)
        x /= np.sqrt(np.bincount(doc, x * x, minlength=end - start))[doc]
        words = [t.split() for t in own]
        shares = [sum(map(eq, w, w[1:])) / len(w) if w else 0.0 for w in words]
        last = np.searchsorted(doc, np.arange(end - start), "right")
        yield start, end, np.insert(doc, last, np.arange(end - start)), np.insert(place, last, [(1 << BITS) + min(9, int(10 * s)) for s in shares]), np.insert(x, last, REPEATS)


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and weights of each text: logarithms of counts of hashed character n-grams (of length 1), and the tenth that the share of words equal to the word before is in."""
    for start, end, doc, place, x in _runs(column):
        first = np.searchsorted(doc, np.arange(end - start + 1))
        yield from ((place[a:b], x[a:b]) for a, b in zip(first[:-1], first[1:], strict=True))


def _s(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


class Ordinal:
    """Cumulative-link model for grades 0 to ``grades - 1``."""

    def __init__(self, grades: int, width: int):
        self.grades, self.w = grades, np.zeros(width)
        self.thresholds = np.linspace(-1, 1, grades - 1) if grades > 1 else np.zeros(0)

    def fit(self, rows: Rows, grade: np.ndarray, weight: np.ndarray) -> Ordinal:
        """Weighted maximum likelihood by Adam; thresholds are a first one and logarithms of steps, so they stay in order."""
        k = self.grades - 1
        if not k or not rows.n:
            return self
        weight = weight / weight.sum()
        steps = np.concatenate((self.thresholds[:1], np.log(np.maximum(np.diff(self.thresholds), 1e-3))))
        m, v = np.zeros(len(self.w) + k), np.zeros(len(self.w) + k)
        for t in range(1, ROUNDS + 1):
            z = rows.times(self.w)
            ends = np.concatenate(([-np.inf], self._in_order(steps), [np.inf]))
            up, down = _s(z - ends[grade]), _s(z - ends[grade + 1])  # P(y >= grade), P(y > grade)
            p = np.maximum(up - down, 1e-12)
            slope_up, slope_down = up * (1 - up), down * (1 - down)
            gz = -weight * (slope_up - slope_down) / p
            gt = np.zeros(k + 2)
            np.add.at(gt, grade, weight * slope_up / p)
            np.add.at(gt, grade + 1, -weight * slope_down / p)
            gt = gt[1:-1]
            tails = np.cumsum(gt[::-1])[::-1]
            gs = np.concatenate((tails[:1], tails[1:] * np.exp(steps[1:])))
            g = np.concatenate((rows.back(gz) + L2 * self.w, gs))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            self.w = self.w - move[: len(self.w)] * 4
            steps = steps - move[len(self.w) :]
        self.thresholds = self._in_order(steps)
        return self

    @staticmethod
    def _in_order(steps: np.ndarray) -> np.ndarray:
        return steps[0] + np.concatenate(([0.0], np.cumsum(np.exp(steps[1:]))))

    def tails(self, column: pa.Array) -> np.ndarray:
        """For each text P(grade > k) for each k below the highest grade."""
        z = np.zeros(len(column))
        for start, end, doc, place, x in _runs(column):
            z[start:end] = np.bincount(doc, x * self.w[place], minlength=end - start)
        return _s(z[:, None] - self.thresholds)


def fit_quality(rated: DataFrame, fit_rows: int = FIT_ROWS) -> Ordinal:
    """Fit on ``rated(doc_id, text, grade)`` with grades from 0; rows without text or grade teach nothing."""
    rated = rated.select("doc_id", "text", "grade").filter("grade >= 0 and text is not null")
    shares = fractions(rated.select("grade"), "grade", fit_rows)
    if not shares:
        return Ordinal(1, WIDTH)
    rows = gathered(rated.filter(taken("grade", shares, 10)), features, "grade")
    grade = rows["grade"].to_numpy().astype(np.int64)
    weight = np.array([1 / shares[g] for g in grade.tolist()])
    return Ordinal(int(max(shares)) + 1, WIDTH).fit(Rows.of_table(rows, WIDTH), grade, weight)


def grade_documents(docs: DataFrame, model: Ordinal) -> DataFrame:
    """``docs`` with ``expected_grade`` and ``tail_probability`` (of a grade above the lowest) beside its columns, ``text`` among them."""
    docs = docs.select(*(c for c in docs.columns if c not in ("expected_grade", "tail_probability")))
    names, at = docs.columns, docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = model.tails(batch.column(at))
            first = tails[:, 0] if tails.shape[1] else np.ones(len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tails.sum(axis=1)), pa.array(first)], [*names, "expected_grade", "tail_probability"])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType())]))


def grades_of(labels: DataFrame) -> Column:
    """Grades of the label table: 0 for junk, 1 for a text that reads well but is toxic, 2 for one that is neither."""
    return F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))


def rate(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` with ``expected_grade``, ``tail_probability`` and ``kept`` beside its columns, a row for each row.

    Fitted on the rows of ``docs(doc_id, text, ...)`` that ``labels(doc_id, quality, toxic, ...)`` rate; the
    first of repeated labels counts. Null and empty texts have no features and get the grade of the thresholds
    alone; whether they stay follows from it. Without ratings every document is kept. Repeated rows and null
    ids are scored like others. Columns of the result's names are replaced.
    """
    own = labels.select("doc_id", grades_of(labels).alias("grade")).filter("doc_id is not null and grade is not null")
    shares = fractions(own.select("grade"), "grade", 3 * fit_rows)
    chosen = own.filter(taken("grade", shares, 12)).groupBy("doc_id").agg(F.min("grade").alias("grade"))  # about 3 * fit_rows ids
    rated = materialise(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "rated")
    told = grade_documents(docs.drop("kept"), fit_quality(rated, fit_rows))
    return told.withColumn("kept", F.col("tail_probability") >= LEAST_TAIL)


def op10_ordinal_quality(spark, sf_dir: str) -> DataFrame:
    """Expected grade, tail probability and decision of all ``documents``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return rate(docs.select("doc_id", "text"), labels).drop("text")
