"""Best-two-fit packing of token pieces into sequences of fixed capacity.

A piece matters to packing by its length alone, and lengths are bounded by the capacity. So the driver plans
on counts by length (at most ``capacity`` numbers, however many documents there are): one bin at a time,
filled greedily and then improved, where equal bins that follow one another are planned at once. Pieces take
their places by their rank among the pieces of the same length.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, materialise
from .textkit import slices

CAPACITY, END = 2048, 0
#: Words that one task keeps the ids of (those of one run more for a time), and bytes of text that are split at a time (a longer text by itself).
KEPT_WORDS, RUN_BYTES = 500_000, 6 << 20
#: Stems and marks of words in each half of what is kept of them.
KEPT_PARTS = 150_000
#: Pieces of one length in a numbering block as a mean.
BLOCK_ROWS = 1_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: ASCII marks but the apostrophe, which begins pre-tokens of its own; a run of them is one pre-token.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: The last of the letters whose normal form is themselves, but for their case.
_LATIN = "\u0233"


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordTokens:
    """Ids of whole texts, by the ids of their words, which are kept.

    The tokenizer of the files drops white space before anything else splits, so a text's ids are its words'
    ids in order; Arrow splits a run of texts and numbers its distinct words, and each is looked up once. A word
    of Latin letters, or one with a run of marks after it, is one pre-token or two, whose ids the vocabulary's
    model gives at once; any other word goes through the whole tokenizer. Words that a run repeats are kept, and
    the parts that words were last made of. What is kept changes the time, never the ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        alphabet = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: What the byte-level step makes of each letter beyond ASCII; ASCII letters are looked up too, which is faster than to lack.
        self.letters = {c: alphabet.pre_tokenize_str(chr(c))[0][0] if c > 127 else chr(c) for c in range(ord(_LATIN) + 1) if chr(c).isalpha()}
        #: Ids of letters and marks that words were made of, packed; the newer and the older half.
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: Words met, the ids of all of them, and where each one's ids begin (and the last one's end).
        self.words, self.ids, self.at = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _ask(self, texts: list[str]) -> list[bytes]:
        ask = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [_packed(e.ids) for e in ask(texts, add_special_tokens=False)] if texts else []

    def _part(self, low: str) -> bytes:
        """Ids of a lower-case word of Latin letters, which normalisation leaves as they are, or of a run of marks."""
        ids = self.older.get(low)
        if ids is None:
            if low[0] in _MARKS:
                ids = self._ask([low])[0]
            else:
                ids = _packed([t.id for t in self.model.tokenize(low if low.isascii() else low.translate(self.letters))])
        if len(self.parts) >= KEPT_PARTS:
            self.older, self.parts = self.parts, {}
        self.parts[low] = ids
        return ids

    def _learn(self, words: list[str]) -> list[bytes]:
        out: list[bytes | None] = []
        for low in "\n".join(words).lower().split("\n") if words else []:  # no word has a line end
            ids = self.parts.get(low)
            if ids is None:
                if low.isalpha():
                    if low.isascii() or max(low) <= _LATIN:
                        ids = self._part(low)
                elif stem := low.rstrip(_MARKS):
                    if stem.isalpha() and (stem.isascii() or max(stem) <= _LATIN):
                        mark = low[len(stem) :]
                        ids = (self.parts.get(stem) or self._part(stem)) + (self.parts.get(mark) or self._part(mark))
            out.append(ids)
        rest = iter(self._ask([w for w, ids in zip(words, out, strict=True) if ids is None]))
        return [next(rest) if x is None else x for x in out]

    def _ids(self, words: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each of these distinct words begin and end in ``self.ids``, until the next call."""
        kept = int(self.at[len(self.words)])
        self.ids, self.at = self.ids[:kept], self.at[: len(self.words) + 1]
        if len(self.words) > KEPT_WORDS:
            self.words, self.ids, self.at = self.words[:0], self.ids[:0], self.at[:1]
        place = pc.index_in(words, value_set=self.words)
        unknown = np.flatnonzero(place.is_null().to_numpy(zero_copy_only=False))
        unknown = unknown[np.argsort(counts[unknown] < 2, kind="stable")]  # those that repeat come first, and stay
        new = words.take(pa.array(unknown))
        ids = self._learn(new.to_pylist())
        place = place.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[unknown] = len(self.words) + np.arange(len(new))
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)))
        self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(ids), "<u4")))
        self.words = pa.concat_arrays([self.words, new[: int((counts[unknown] > 1).sum())]])
        return self.at[place], self.at[place + 1]

    def encode_column(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Runs of texts (null: empty): first row, end row, the ids of all of them, and where each text's ids begin (and the last one's end)."""
        column = column.cast(pa.large_string()).fill_null("")
        for first, end, _, _ in slices(column, RUN_BYTES):
            texts = pc.ascii_split_whitespace(column.slice(first, end - first))
            words = texts.values.dictionary_encode()
            which = words.indices.to_numpy()
            begin, stop = self._ids(words.dictionary, np.bincount(which, minlength=len(words.dictionary)))
            n = (stop - begin)[which]
            upto = np.concatenate(([0], np.cumsum(n)))
            ids = self.ids[np.repeat(begin[which] - upto[:-1], n) + np.arange(upto[-1])]
            yield first, end, ids, upto[texts.offsets.to_numpy()]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [ids[a:b] for _, _, ids, at in self.encode_column(pa.array(texts, pa.string())) for a, b in zip(at[:-1], at[1:], strict=True)]


@lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    """The words of this process: Spark's Python workers run task after task, and the next one finds the words that those before it met."""
    return WordTokens(path)


def _cut(path: str, capacity: int):
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, end, ids, offsets in tokens.encode_column(batch.column(1)):
                rows: list[tuple] = []
                ids = np.insert(ids, offsets[1:], END).astype("<u4")
                offsets = offsets + np.arange(len(offsets))
                for doc_id, a, b in zip(names[first:end], offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    for piece, at in enumerate(range(a, b, capacity)):
                        own = ids[at : min(at + capacity, b)]
                        rows.append((doc_id, piece, at - a, len(own), zlib.crc32(own)))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return tokenise


_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins as ``(lengths, how many such bins)`` for so many pieces of each length (1 to ``capacity``).

    A bin takes the longest piece left, then again and again the longest that fits. Then its shortest piece
    (not its first) is replaced by the two pieces left that together fit the gap and that piece's place more
    tightly, if there are such. The next bins are equal for as long as no length runs short.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    bins = []
    while left.any():
        own: list[int] = []
        gap = capacity
        while gap and (fits := np.flatnonzero(left[: gap + 1])).size:
            length = int(fits[-1])
            many = int(min(left[length], gap // length)) if own else 1
            own += [length] * many
            left[length] -= many
            gap -= length * many
        need = np.bincount(own, minlength=capacity + 1)
        if gap and len(own) > 1:
            short = own[-1]
            two = _best_two(left, short, gap + short)
            if two:
                own[-1:] = two
                left[short] += 1
                left[two[0]] -= 1
                left[two[1]] -= 1
                need = np.maximum(need, np.bincount(own, minlength=capacity + 1))
        used = np.bincount(own, minlength=capacity + 1)
        # the next bin is the same if every length that was taken on the way is there again as often
        on = np.flatnonzero(need)
        more = np.where(used[on] > 0, (left[on] - need[on]) // np.maximum(used[on], 1) + 1, np.iinfo(np.int64).max)
        more = int(more.min()) if (left[on] >= need[on]).all() else 0
        left -= used * more
        bins.append((own, 1 + more))
    return bins


def _best_two(left: np.ndarray, more_than: int, room: int) -> list[int] | None:
    """The two lengths left whose sum is largest, over ``more_than`` and at most ``room``; of equal sums the pair with the longest piece."""
    lengths = np.flatnonzero(left[: room])
    lengths = lengths[::-1]
    if not lengths.size:
        return None
    # for each longer piece the longest partner that fits, not longer than itself
    ascending = lengths[::-1]
    partner = np.searchsorted(ascending, np.minimum(room - lengths, lengths), "right") - 1
    valid = partner >= 0
    other = np.where(valid, ascending[np.maximum(partner, 0)], 0)
    lone = valid & (other == lengths) & (left[lengths] < 2)
    down = np.where(lone, partner - 1, partner)
    valid &= down >= 0
    other = np.where(valid, ascending[np.maximum(down, 0)], 0)
    total = np.where(valid, lengths + other, -1)
    best = int(total.argmax())
    return [int(lengths[best]), int(other[best])] if total[best] > more_than else None


def plan_places(bins: list[tuple[list[int], int]]) -> pd.DataFrame:
    """For each length, runs of ranks with the sequences and offset they go to: ``(length, rank, rows, sequence, offset)``."""
    sequence, taken, rows = 0, {}, []
    for own, times in bins:
        offset = 0
        for length in own:
            rank = taken.get(length, 0)
            rows.append((length, rank, times, sequence, offset))
            taken[length] = rank + times
            offset += length
        sequence += times
    return pd.DataFrame(rows, columns=["length", "rank", "rows", "sequence", "offset"], dtype="int64")


def _place(plan: pd.DataFrame):
    by_length = {int(k): tuple(g[c].to_numpy() for c in ("rank", "sequence", "offset")) for k, g in plan.sort_values("rank").groupby("length")}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            lengths, ranks = rows["length"].to_numpy(), rows.pop("rank").to_numpy()
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                first, base, place = by_length[int(length)]
                run = np.searchsorted(first, ranks[at], "right") - 1
                sequence[at] = base[run] + ranks[at] - first[run]
                offset[at] = place[run]
            yield rows.assign(sequence_id=sequence, offset=offset)

    return place


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """``docs(doc_id, text, ...)`` to ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, a row for each piece.

    A document is the ids of its text (null: none) and then id 0. Longer ones than ``capacity`` are cut into
    pieces of that many ids, the last may be shorter. Each sequence holds pieces one after the other, without
    a gap from offset 0. Rows with null or repeated ids are documents like others; an empty table gives no
    rows; other columns are not looked at.
    """
    pieces = materialise(docs.select("doc_id", "text").mapInArrow(_cut(tokenizer, capacity), PIECES), "pieces")
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = plan_places(best_two_fit(lengths, capacity))
    # a length has as many blocks as its pieces ask for, so common lengths spread over tasks and rare ones are one block each
    blocks = docs.sparkSession.createDataFrame([(k, -(-n // BLOCK_ROWS)) for k, n in lengths.items()], "length long, blocks long")  # at most `capacity` rows
    pieces = pieces.join(F.broadcast(blocks), "length").withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("blocks"))).drop("blocks")
    starts = (
        pieces.groupBy("length", "block")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("length", "block", "before")
    )
    ranked = (
        pieces.withColumn("k", F.row_number().over(Window.partitionBy("block", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1)
        .join(bounded(materialise(starts, "starts")), ["length", "block"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("k")).alias("rank"))
    )
    return ranked.mapInPandas(_place(plan), PIECES + ", sequence_id long, offset long")


def word_tokenizer() -> str:
    """The place of the public vocabulary that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_best_two_fit(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` packed into sequences of 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_tokenizer())
