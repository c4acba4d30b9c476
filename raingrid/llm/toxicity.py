"""Toxicity by a classifier whose score barely changes when identity terms are swapped.

Logistic regression on the words of a text and their beginnings, with an L1 penalty and with a penalty on the squared change of
each labelled text's score when its identity terms are replaced by others of their kind. A word like a
group's name, which is in both toxic and neutral texts, then can't carry weight of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, remainder
from .sampling import Rows, fractions, gathered, taken
from .textkit import FOLD, MARKS, mix, slices, word_hashes, word_spans

BITS = 18
#: The model is fitted on about so many labelled rows, even over the two labels.
FIT_ROWS = 6_000
#: A feature has a weight if it is in so many sampled rows and its share of toxic ones is so many deviations from the usual.
LEAST_DOCS, LEAST_DEVIATIONS = 5, 3.0
#: Features that can have a weight beside those of identity terms: the ones with most deviations.
MOST_FEATURES = 8_192
ROUNDS, RATE, L1, SWAP = 200, 0.5, 1e-4, 1.0
#: Beside each word its beginnings of so many bytes are features, for words that are made of a stem and many endings.
STEMS = (4, 5, 6, 7)
LEAST_SCORE = 0.3

# Identity terms by kind; a swap replaces a term by the next of its kind.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"), ("transgender", "cisgender"),
    ("gay", "straight"), ("lesbian", "heterosexual"), ("homosexual", "bisexual"), ("queer", "trans"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"), ("islam", "christianity", "judaism", "hinduism", "buddhism"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "arab"), ("blacks", "whites", "asians", "latinos", "africans", "europeans", "arabs"),
    ("mexican", "american", "chinese", "indian", "russian", "german", "french", "spanish"), ("immigrant", "citizen", "refugee"), ("immigrants", "citizens", "refugees"),
    ("old", "young", "elderly"), ("disabled", "blind", "deaf"),
)


def _place(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - BITS)).astype(np.int64)


def words_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts: first row, end row, and the place and text of each word and, apart from words, of each beginning."""
    for start, end, data, offsets in slices(column):
        data = FOLD[data]
        starts, ends, doc = word_spans(data, offsets, MARKS)
        places, docs = [_place(word_hashes(data, starts, ends))], [doc]
        for k in STEMS:
            longer = ends - starts > k
            places.append(_place(mix(word_hashes(data, starts[longer], starts[longer] + k))))
            docs.append(doc[longer])
        yield start, end, np.concatenate(places), np.concatenate(docs)


def features(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for start, end, place, doc in words_of(column):
        pairs = np.unique((doc << BITS) | place)
        first = np.searchsorted(pairs, np.arange(end - start + 1) << BITS)
        own = pairs & ((1 << BITS) - 1)
        out += [(own[a:b], np.ones(b - a)) for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


def _swaps() -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By the place of each identity term: all its features, and those of the term that replaces it."""
    out = {}
    for kind in IDENTITY:
        own = [p for p, _ in features(pa.array(kind))]
        data = [np.frombuffer(t.encode(), np.uint8) for t in kind]
        at = [int(_place(word_hashes(d, np.array([0]), np.array([len(d)])))[0]) for d in data]
        out |= dict(zip(at, zip(own, own[1:] + own[:1], strict=True), strict=True))
    return out


def vocabulary_of(times: np.ndarray, toxic: np.ndarray, usual: float) -> tuple[np.ndarray, np.ndarray]:
    """Which places can have a weight, and which of them are identity terms, from the texts and the toxic texts that have each, and the share of toxic texts."""
    often = times >= LEAST_DOCS
    deviations = np.where(often, np.abs(toxic - times * usual) / np.sqrt(np.maximum(times * usual * (1 - usual), 1e-9)), 0.0)
    known = often & (deviations >= LEAST_DEVIATIONS)
    if known.sum() > MOST_FEATURES:
        known = np.zeros(len(times), bool)
        known[np.argsort(-deviations, kind="stable")[:MOST_FEATURES]] = True
    terms = np.zeros(len(times), bool)
    for a, (gone, come) in _swaps().items():
        if often[a]:
            known[gone] = known[come] = terms[a] = True
    return known, terms


def count_features(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """For each place the texts and the toxic texts of ``labelled(text, toxic)`` that have it, and how many of both there are. A task sends one row for each place at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, (1 << BITS) + 1), np.int64)
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            total[:, -1] += len(toxic), toxic.sum()
            for start, _, place, doc in words_of(batch.column(0)):
                pairs = np.unique((doc << BITS) | place)
                own = pairs & ((1 << BITS) - 1)
                total[0, :-1] += np.bincount(own, minlength=1 << BITS)
                total[1, :-1] += np.bincount(own[toxic[start + (pairs >> BITS)] == 1], minlength=1 << BITS)
        on = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[0, on]), pa.array(total[1, on])], ["place", "n", "toxic"])

    rows = labelled.select("text", "toxic").mapInArrow(count, "place long, n long, toxic long").groupBy("place").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).toPandas()
    out = np.zeros((2, (1 << BITS) + 1), np.int64)
    out[:, rows["place"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64), rows["toxic"].to_numpy(np.int64)
    return out[0, :-1], out[1, :-1], int(out[0, -1]), int(out[1, -1])


class Toxicity:
    def __init__(self):
        self.w, self.bias = np.zeros(1 << BITS), -4.0

    def fit(self, rows: Rows, label: np.ndarray, weight: np.ndarray, swap: float = SWAP) -> Toxicity:
        """Weighted logistic loss, plus ``swap`` times the mean squared change of the log odds under swaps, plus L1; proximal steps of their own size for each weight."""
        if not rows.n:
            return self
        identity = _swaps()
        known, terms = vocabulary_of(rows.back(np.ones(rows.n)), rows.back(label), label.mean())
        rows, vocabulary = rows.only(known)
        to = np.zeros(1 << BITS, np.int64)
        to[vocabulary] = np.arange(len(vocabulary))
        # the change of a row's score: features of its terms leave, those of the replacements come
        at = np.flatnonzero(terms[vocabulary][rows.place])
        changed = [(k, vocabulary[rows.place[at[rows.row[at] == k]]]) for k in np.unique(rows.row[at])]
        leave = [np.concatenate([identity[int(x)][0] for x in t]) for _, t in changed]
        come = [np.concatenate([identity[int(x)][1] for x in t]) for _, t in changed]
        gone = Rows.of_lists([to[np.concatenate(x)] for x in zip(leave, come, strict=True)], [np.repeat([1.0, -1.0], [len(a), len(b)]) for a, b in zip(leave, come, strict=True)], len(vocabulary))
        changed_weight = np.array([weight[k] for k, _ in changed])
        changed_weight = changed_weight / (changed_weight.sum() or 1.0)  # the mean is over texts that a swap changes
        weight = weight / weight.sum()
        w, bias = np.zeros(len(vocabulary)), float(np.log(max((weight * label).sum(), 1e-6) / max((weight * (1 - label)).sum(), 1e-6)))
        g2, b2 = np.full(len(w), 1e-8), 1e-8
        for _ in range(ROUNDS):
            e = weight * (0.5 * (1 + np.tanh((rows.times(w) + bias) / 2)) - label)
            g = rows.back(e)
            if changed:
                g += 2 * swap * gone.back(changed_weight * gone.times(w))
            # steps shrink with all gradients so far, which ends the fit before single features are trusted fully
            g2 += g * g
            b2 += e.sum() ** 2
            step = RATE / np.sqrt(g2)
            w = w - step * g
            w = np.sign(w) * np.maximum(np.abs(w) - step * L1, 0)
            bias -= RATE / 5 / np.sqrt(b2) * e.sum()
        self.w[vocabulary], self.bias = w, bias
        return self

    def scores(self, column: pa.Array) -> np.ndarray:
        """The score of each text; each of its features counts once."""
        out = np.full(len(column), self.bias)
        for start, end, place, doc in words_of(column):
            on = self.w[place] != 0
            pairs = np.unique((doc[on] << BITS) | place[on])
            out[start:end] += np.bincount(pairs >> BITS, self.w[pairs & ((1 << BITS) - 1)], minlength=end - start)
        return 0.5 * (1 + np.tanh(out / 2))


def fit_toxicity(labelled: DataFrame, fit_rows: int = FIT_ROWS, swap: float = SWAP) -> Toxicity:
    """Fit on ``labelled(doc_id, text, toxic)``; rows without a label of 0 or 1, or without text, teach nothing."""
    labelled = labelled.select("doc_id", "text", "toxic").filter("toxic in (0, 1) and text is not null")
    shares = fractions(labelled.select("toxic"), "toxic", fit_rows)
    if len(shares) < 2:
        return Toxicity()
    chosen = materialise(labelled.filter(taken("toxic", shares, 4)), "chosen")
    times, toxic, n, n_toxic = count_features(chosen)
    known, _ = vocabulary_of(times, toxic, n_toxic / max(1, n))
    # only features that can have a weight come to the driver
    table = gathered(chosen, lambda column: [(p[known[p]], a[known[p]]) for p, a in features(column)], "toxic")
    label = table["toxic"].to_numpy().astype(float)
    return Toxicity().fit(Rows.of_table(table, 1 << BITS), label, np.array([1 / shares[int(x)] for x in label]), swap)


def score_documents(docs: DataFrame, model: Toxicity) -> DataFrame:
    """``docs(doc_id, text, ...)`` to ``(doc_id, score)``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1)))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs(doc_id, text, ...)`` to ``(doc_id, held_out, score, predicted)``, a row for each row.

    The model learns from the rows that ``labels(doc_id, toxic, ...)`` labels and whose fold (crc32 of the id
    as text, modulo 4) is not 2; of repeated labels the larger counts. Null and empty texts have the score of
    the intercept; without labels of both kinds every score is that of a fixed low intercept. Repeated rows
    are scored like others; a null id is in no fold. Other columns are not looked at.
    """
    own = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic is not null").filter(remainder() != 2)
    shares = fractions(own.select("toxic"), "toxic", 2 * fit_rows)
    chosen = own.filter(taken("toxic", shares, 14)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # about 2 * fit_rows ids
    labelled = materialise(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "labelled")
    told = score_documents(docs, fit_toxicity(labelled, fit_rows))
    return told.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))


def op4_counterfactual_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity of all ``documents``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity(docs, labels)
