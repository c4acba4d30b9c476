"""Array forms of text: words, shingles and character n-grams of many documents at once.

Small helpers for use inside tasks; they see one Arrow batch at a time and know nothing of Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RANDOM = np.random.Generator(np.random.PCG64(20240607))
#: A random odd number for each byte, and odd factors for places in a sequence.
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RANDOM.integers(1, 2**61)) * 8 + 5
_INVERSE = pow(_BASE, -1, 2**64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, other bytes as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spread each 64-bit number over all bits (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(column: pa.Array, most: int = 500_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of a text column of about ``most`` bytes: first row, end row, bytes, offsets. Null is read as empty.

    A text is never cut, so that one longer than ``most`` is a run by itself.
    """
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and len(column.buffers()[2]) else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        end = min(end, len(column))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


#: What is no ASCII letter or digit and no part of a longer character.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word (a run of other bytes than those ``between``) of concatenated documents."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~between[data]
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, from prefix sums."""
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its ``width``-word shingles, lower-cased in A-Z.

    A document of fewer words has one shingle, the whole sequence; one without words has none.
    """
    data = FOLD[data]
    starts, ends, doc = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    n = len(offsets) - 1
    first = np.searchsorted(doc, np.arange(n + 1))
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        rolled += words[k : k + len(rolled)] * _PLACE[k]
    rolled = mix(rolled)
    out = []
    for d in range(n):
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= width:
            got = np.sort(rolled[a : b - width + 1])
            out.append(got[np.concatenate(([True], got[1:] != got[:-1]))])
        elif b > a:
            out.append(mix(np.array([(words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def ngram_counts(column: pa.Array, orders: tuple[int, ...], bits: int, lower: bool = False) -> Iterator[tuple[int, int, list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts: first row, end row, the texts (null: empty), and the document, place and count of their character n-grams, hashed to ``2 ** bits`` places, in order of document and place."""
    for start, end, _, _ in slices(column, 100_000):  # so that the arrays of a run stay in the cache
        own = [t or "" for t in column.slice(start, end - start).to_pylist()]
        folded = [t.lower() for t in own] if lower else own
        points = code_points("".join(folded)).astype(np.uint64)
        doc = np.repeat(np.arange(len(own), dtype=np.uint64), [len(t) for t in folded])
        keys = []
        for n in orders:
            size = len(points) - n + 1
            if size <= 0:
                continue
            h = points[:size] * _PLACE[8 * n]
            for k in range(1, n):
                h += points[k : size + k] * _PLACE[8 * n + k]
            h *= np.uint64(0x9E3779B97F4A7C15)
            h >>= np.uint64(64 - bits)
            h |= doc[:size] << np.uint64(bits)
            keys.append(h[doc[:size] == doc[n - 1 :]] if n > 1 else h)  # none that reaches into the next text
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        # sorting half as many bytes is twice as fast
        pair, count = np.unique(key.astype(np.uint32) if len(own) << bits <= 1 << 32 else key, return_counts=True)
        pair = pair.astype(np.int64)
        yield start, end, own, pair >> bits, pair & ((1 << bits) - 1), count
