"""Language of texts: sparse multinomial logistic regression on TF-IDF of character n-grams.

Fitted by follow-the-regularised-leader with elastic-net penalties on a bounded sample of labelled rows;
document frequencies are counted over all labelled rows; a temperature is then fitted on rows kept aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remainder
from .sampling import Rows, fractions, gathered, taken
from .textkit import ngram_counts

ORDERS, BITS = (1, 2, 3), 15
#: The model is fitted on about so many rows, even over languages, a fifth of them kept aside for the temperature.
FIT_ROWS = 4_000
ALPHA, BETA, L1, L2, ROUNDS = 0.3, 1.0, 0.02, 0.01, 3
#: Confidence under which the pipeline rejects a document.
LEAST_SCORE = 0.35


def raw_features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and counts of the hashed character n-grams of each lower-cased text."""
    for start, end, _, doc, place, count in ngram_counts(column, ORDERS, BITS, lower=True):
        first = np.searchsorted(doc, np.arange(end - start + 1))
        yield from ((place[a:b], count[a:b]) for a, b in zip(first[:-1], first[1:], strict=True))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts of ``docs(text)`` each place is, and how many texts there are. A task sends one row for each place at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BITS) + 1, np.int64)
        for batch in batches:
            for _, _, _, _, place, _ in ngram_counts(batch.column(0), ORDERS, BITS, lower=True):
                total[:-1] += np.bincount(place, minlength=1 << BITS)
            total[-1] += len(batch)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], ["place", "n"])

    rows = docs.select("text").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((1 << BITS) + 1, np.int64)
    out[rows["place"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out[:-1], int(out[-1])


class LanguageModel:
    def __init__(self, languages: list[str], idf: np.ndarray):
        self.languages, self.idf = languages, idf
        shape = (len(idf) + 1, len(languages))  # the last row is the intercept
        self.z, self.n = np.zeros(shape), np.zeros(shape)
        self.temperature = 1.0

    def weigh(self, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(np.maximum(counts, 1))) * self.idf[places]
        return x / (np.sqrt(x @ x) or 1.0)

    def weights(self, places: np.ndarray) -> np.ndarray:
        z, n = self.z[places], self.n[places]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, places: np.ndarray, counts: np.ndarray, language: int) -> None:
        at, x = np.append(places, len(self.idf)), np.append(self.weigh(places, counts), 1.0)
        w = self.weights(at)
        p = _softmax(x @ w)
        p[language] -= 1
        g = x[:, None] * p
        before = self.n[at]
        after = before + g * g
        self.z[at] += g - (np.sqrt(after) - np.sqrt(before)) / ALPHA * w
        self.n[at] = after

    def close(self) -> LanguageModel:
        """Keep only the weights."""
        self.w = self.weights(np.arange(len(self.idf) + 1))
        self.z = self.n = None
        return self

    def logits(self, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.weigh(places, counts) @ self.w[places] + self.w[-1]

    def calibrate(self, logits: np.ndarray, languages: np.ndarray) -> None:
        """The temperature with the least log loss, by golden section over its logarithm."""
        if not len(logits):
            return

        def loss(t: float) -> float:
            p = np.exp(logits / np.exp(t) - (logits / np.exp(t)).max(1, keepdims=True))
            return -np.log(np.maximum(p[np.arange(len(p)), languages] / p.sum(1), 1e-300)).mean()

        low, high, ratio = -4.0, 3.0, (np.sqrt(5) - 1) / 2
        for _ in range(40):
            a, b = high - ratio * (high - low), low + ratio * (high - low)
            low, high = (low, b) if loss(a) <= loss(b) else (a, high)
        self.temperature = float(np.exp((low + high) / 2))

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language of each text and its probability; ``und`` and 0 without a letter (as Unicode has them) or without a model."""
        names, scores = ["und"] * len(column), np.zeros(len(column))
        if not self.languages:
            return names, scores
        for start, end, own, doc, place, count in ngram_counts(column, ORDERS, BITS, lower=True):
            x = (1 + np.log(count)) * self.idf[place]
            x /= np.sqrt(np.bincount(doc, x * x, minlength=end - start))[doc]
            logits = np.stack([np.bincount(doc, x * self.w[place, k], minlength=end - start) + self.w[-1, k] for k in range(len(self.languages))], axis=1) / self.temperature
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            for k, text in enumerate(own):
                if any(map(str.isalpha, text)):
                    names[start + k], scores[start + k] = self.languages[best[k]], min(1.0, p[k, best[k]])
        return names, scores


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit_language(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> LanguageModel:
    """Fit on ``labelled(doc_id, text, lang)``; rows without lang or with null or empty text teach nothing, nor do languages beyond the ``MOST_LABELS`` most frequent."""
    labelled = labelled.select("doc_id", "text", "lang").filter("lang is not null and text is not null and text <> ''")
    shares = fractions(labelled.select("lang"), "lang", fit_rows)
    languages = sorted(shares)
    if not languages:
        return LanguageModel([], np.zeros(1 << BITS)).close()
    frequency, n = document_frequencies(labelled)
    model = LanguageModel(languages, np.log((1 + n) / (1 + frequency)) + 1)
    chosen = labelled.filter(taken("lang", shares, 9))
    table = gathered(chosen, raw_features, "lang")
    rows, names = Rows.of_table(table, 1 << BITS), [languages.index(x) for x in table["lang"].to_pylist()]
    order = np.argsort(table["doc_id"].fill_null(-1).to_numpy(), kind="stable")
    data = [(rows.place[rows.starts[k] : rows.starts[k + 1]], rows.amount[rows.starts[k] : rows.starts[k + 1]], names[k]) for k in order]
    aside = np.arange(len(data)) % 5 == 4
    learn = [d for d, out in zip(data, aside, strict=True) if not out]
    rng = np.random.default_rng(0)
    for _ in range(ROUNDS):
        for k in rng.permutation(len(learn)):
            model.learn(*learn[k])
    model.close()
    rest = [d for d, out in zip(data, aside, strict=True) if out]
    model.calibrate(np.array([model.logits(p, a) for p, a, _ in rest]), np.array([x for _, _, x in rest], int))
    return model


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` beside its columns (``doc_id`` and ``text`` among them)."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = kept.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = model.predict(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], [*kept, "lang_pred", "score"])

    docs = docs.select(*kept)
    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def language_id(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs(doc_id, text, lang, ...)`` to ``(doc_id, held_out, lang_pred, score)``, a row for each row.

    The model learns from rows whose fold (crc32 of the id as text, modulo 4) is not 2 and that have a
    language; ``held_out`` marks fold 2. ``lang_pred`` is a learned language, or ``und`` with score 0 where
    the text is null, empty or has no letter, or nothing could be learned. Repeated rows are rows like others;
    rows with a null id are in no fold: they teach nothing and are not held out. Other columns are not looked at.
    """
    model = fit_language(docs.filter(remainder() != 2), fit_rows)
    told = identify(docs.select("doc_id", "text"), model)
    return told.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_ftrl_language(spark, sf_dir: str) -> DataFrame:
    """The language of all ``documents``."""
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
