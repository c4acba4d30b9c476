"""A bounded sample of labelled rows for fitting, even over the values of a label, and array forms of its features."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


#: Sparse features of a sample come to the driver up to so many values (8 bytes each); of more, a share of the rows.
MOST_VALUES = 12_000_000
#: Values of a label that can be learned: the most frequent ones.
MOST_LABELS = 256


def fractions(rows: DataFrame, label: str, most: int) -> dict:
    """For each of the ``MOST_LABELS`` most frequent values of ``label`` the share of its rows to take, so that about ``most`` rows are taken, as evenly as can be."""
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(MOST_LABELS).collect()}
    each = most / max(1, len(counts))
    return {v: min(1.0, each / n) for v, n in counts.items()}


def taken(label: str, shares: dict, seed: int) -> F.Column:
    """Whether a row is in the sample: a hash of its id against its label's share (the same rows in every run)."""
    place = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000_007)) / 1_000_000_007
    share = F.lit(0.0)
    for value, own in shares.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(float(own))).otherwise(share)
    return place < share


def sparse(docs: DataFrame, features: Callable[[pa.Array], Iterable[tuple[np.ndarray, np.ndarray]]], label: str) -> DataFrame:
    """``docs(doc_id, text, label)`` to ``(doc_id, places, amounts, label)``, the sparse features of each text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                got = list(features(part.column(1)))
                lists = [pa.array([x[k].astype(t) for x in got], pa.list_(pa.from_numpy_dtype(t))) for k, t in enumerate((np.int32, np.float32))]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists, part.column(2)], ["doc_id", "places", "amounts", label])

    docs = docs.select("doc_id", "text", label)
    return docs.mapInArrow(rows, f"doc_id long, places array<int>, amounts array<float>, `{label}` {dict(docs.dtypes)[label]}")


def gathered(docs: DataFrame, features: Callable[[pa.Array], Iterable[tuple[np.ndarray, np.ndarray]]], label: str) -> pa.Table:
    """``sparse`` of a sample on the driver, at most about ``MOST_VALUES`` values of it: where texts are so long that there are more, rows with the smallest hashes."""
    table = materialise(sparse(docs, features, label), "features")
    values = table.agg(F.sum(F.size("places"))).first()[0] or 0
    if values > MOST_VALUES:
        table = table.filter(F.pmod(F.xxhash64("doc_id", F.lit(21)), F.lit(1 << 20)) < int((1 << 20) * MOST_VALUES / values))
    return table.toArrow()


class Rows:
    """Sparse rows on the driver: products with a vector, both ways, a piece at a time so that nothing beside the rows is large."""

    PIECE = 1 << 20

    def __init__(self, starts: np.ndarray, place: np.ndarray, amount: np.ndarray, width: int):
        self.n, self.width, self.starts = len(starts) - 1, width, starts
        self.place, self.amount = place, amount
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(starts))

    @classmethod
    def of_table(cls, table: pa.Table, width: int) -> Rows:
        """Of the columns ``places`` and ``amounts``, without copying them."""
        places, amounts = (table[c].combine_chunks() for c in ("places", "amounts"))
        if not len(table):
            return cls.of_lists([], [], width)
        starts = places.offsets.to_numpy().astype(np.int64)
        return cls(starts - starts[0], places.flatten().to_numpy(), amounts.flatten().to_numpy(), width)

    @classmethod
    def of_lists(cls, places: list[np.ndarray], amounts: list[np.ndarray], width: int) -> Rows:
        starts = np.concatenate(([0], np.cumsum([len(p) for p in places], dtype=np.int64)))
        return cls(starts, np.concatenate([np.zeros(0, np.int32), *places]).astype(np.int32), np.concatenate([np.zeros(0, np.float32), *amounts]).astype(np.float32), width)

    def _pieces(self):
        for low in range(0, len(self.place), self.PIECE):
            yield slice(low, low + self.PIECE)

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for k in self._pieces():
            first = self.row[k.start]
            own = np.bincount(self.row[k] - first, self.amount[k] * w[self.place[k]])
            out[first : first + len(own)] += own
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for k in self._pieces():
            out += np.bincount(self.place[k], self.amount[k] * g[self.row[k]], minlength=self.width)
        return out

    def only(self, known: np.ndarray) -> tuple[Rows, np.ndarray]:
        """The rows with the known places alone, numbered anew, and those places."""
        names = np.flatnonzero(known)
        to = np.zeros(self.width, np.int32)
        to[names] = np.arange(len(names))
        kept = known[self.place]
        starts = np.concatenate(([0], np.cumsum(kept)))[self.starts]
        return Rows(starts, to[self.place[kept]], self.amount[kept], len(names)), names
