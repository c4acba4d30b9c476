"""Token ids in word-aligned binary files: Simple-8b words, an index of documents and one of blocks.

A file is its magic, 64-bit little-endian words, then its tables and a footer that tells where they are:

* A word has a selector in its upper 4 bits. Selectors 2 to 15 hold so many ids of equal width (``COUNTS``, ``WIDTHS``) in the lower 60 bits,
  the first id in the lowest. Selector 1 is a run: how often in bits 40 to 59, the id in the lower 40. Selector 0 is an escape: its lower bits
  number an id of over 60 bits in the table of escapes.
* A document begins a word, and no word has room left over: the last ids of a document take words of fewer ids. So words alone tell how many ids they hold.
* ``blocks`` has for every ``BLOCK_WORDS`` words the ids before them, so that any stretch of ids is found by a binary search and whole blocks
  are decoded at once, a selector at a time.
* ``documents`` has ids, counts of tokens and CRC-32 of each document's tokens, in the order of the words.

Tasks write files under names of their own attempt; the table of written files is the only list of what counts.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, scratch
from .packing import word_tokenizer, word_tokens
from .warc import _open

#: Fixed values of Simple-8b: ids of a word and bits of an id, by selector (0 and 1 are the escape and the run).
COUNTS = [1, 0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
WIDTHS = [0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]
ESCAPE, RUN = 0, 1
MOST_RUN, RUN_BITS = (1 << 20) - 1, 40
END = 1
#: Words of a block; a file is closed at so many bytes of words; ids that are coded at once, and blocks that are decoded at once.
BLOCK_WORDS, FILE_BYTES, AT_ONCE, BLOCKS_AT_ONCE = 1024, 64 << 20, 1 << 17, 64
MAGIC = b"RGS8B001"
#: Documents, words, ids, escapes and blocks of a file, before the last magic.
FOOTER = struct.Struct("<5Q")
WRITTEN = "part long, file int, path string, documents long, ids long, bytes long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def encode(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, their number up to each document's end, and escaped ids of documents that end at ``ends`` (ascending places in ``ids``).

    Each word takes as many ids as fit from where the last one stopped, or a run if that takes more.
    """
    n = len(ids)
    ids = ids.astype(np.uint64)
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)  # ids to the end of the document
    selector, count = np.full(n, 15, np.int8), np.ones(n, np.uint8)
    most = ids.max() if n else 0
    if most >= 1 << 60:
        selector[ids >= np.uint64(1 << 60)] = ESCAPE
    # what fits a selector of more and narrower ids also fits the one before, so that only those places are looked at again
    places = None
    for s in range(14, 1, -1):
        c, small = COUNTS[s], ids < np.uint64(1 << WIDTHS[s])
        if places is None:  # most places fit: all at once
            fits = left >= c
            for k in range(c if most >= 1 << WIDTHS[s] else 0):
                fits[: n - k] &= small[k:]
            found = np.flatnonzero(fits)
            places = found if c > 3 else None
        else:
            found = places[left[places] >= c]
            for k in range(c):
                found = found[small[found + k]]
            places = found
        if not len(found):
            break
        selector[found], count[found] = s, c
    runs: dict[int, int] = {}
    if n > 3:
        same = ids[1:] == ids[:-1]
        four = np.flatnonzero(same[2:] & same[1:-1] & same[:-2])
        if len(four):
            change = np.append(np.flatnonzero(~same), n - 1) + 1
            run = np.minimum(np.minimum(change[np.searchsorted(change, four, "right")] - four, left[four]), MOST_RUN)
            longer = (run > count[four]) & (ids[four] < np.uint64(1 << RUN_BITS))
            runs = dict(zip(four[longer].tolist(), run[longer].tolist(), strict=True))
            selector[four[longer]], count[four[longer]] = RUN, 0
    steps, starts, at = count.tobytes(), [], 0
    while at < n:
        starts.append(at)
        at += steps[at] or runs[at]
    starts = np.array(starts, np.int64)
    chosen = selector[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen).tolist():
        own = np.flatnonzero(chosen == s)
        at = starts[own]
        if s == ESCAPE:
            words[own] |= np.arange(len(own), dtype=np.uint64)
        elif s == RUN:
            words[own] |= (np.array([runs[k] for k in at.tolist()], np.uint64) << np.uint64(RUN_BITS)) | ids[at]
        else:
            for k in range(COUNTS[s]):
                words[own] |= ids[at + k] << np.uint64(k * WIDTHS[s])
    return words, np.searchsorted(starts, ends), ids[starts[chosen == ESCAPE]]


def counts_of(words: np.ndarray) -> np.ndarray:
    """Ids that each word holds."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    return np.where(selector == RUN, ((words >> np.uint64(RUN_BITS)) & np.uint64(MOST_RUN)).astype(np.int64), np.array(COUNTS)[selector])


def decode(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """All ids of these words, a selector at a time."""
    counts = counts_of(words)
    ends = np.cumsum(counts)
    begins = ends - counts
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    for s in np.unique(selector).tolist():
        own = np.flatnonzero(selector == s)
        low = words[own] & np.uint64((1 << 60) - 1)
        if s == ESCAPE:
            out[begins[own]] = escapes[low.astype(np.int64)]
        elif s == RUN:
            n = counts[own]
            out[np.repeat(begins[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = np.repeat(low & np.uint64((1 << RUN_BITS) - 1), n)
        else:
            for k in range(COUNTS[s]):
                out[begins[own] + k] = (low >> np.uint64(k * WIDTHS[s])) & np.uint64((1 << WIDTHS[s]) - 1)
    return out


@dataclass
class _File:
    """A file that is being written; words go out as they come, the tables at its end."""

    path: str
    ids: list[int | None] = field(default_factory=list)
    tokens: list[int] = field(default_factory=list)
    sums: list[int] = field(default_factory=list)
    escapes: list[bytes] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)
    words: int = 0
    total: int = 0

    def __post_init__(self):
        system, name = _open(self.path)
        system.create_dir(name.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(name, compression=None)
        self.out.write(MAGIC)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray) -> None:
        """Documents of these ids, which end at ``ends``."""
        words, _, escapes = encode(ids, ends)
        if len(escapes):
            words[words >> np.uint64(60) == ESCAPE] += np.uint64(sum(map(len, self.escapes)) // 8)
            self.escapes.append(escapes.astype("<u8").tobytes())
        self.out.write(words.astype("<u8").tobytes())
        counts = counts_of(words)
        before = self.total + np.cumsum(counts) - counts
        self.blocks += before[-self.words % BLOCK_WORDS :: BLOCK_WORDS].tolist()
        self.words += len(words)
        self.total += len(ids)
        lows = np.concatenate(([0], ends)).tolist()
        own = ids.astype("<u4")
        self.ids += doc_ids
        self.tokens += np.diff(lows).tolist()
        self.sums += [zlib.crc32(own[a:b]) for a, b in zip(lows[:-1], lows[1:], strict=True)]

    def close(self) -> tuple[int, int, int]:
        """Documents, ids and bytes."""
        tables = b"".join(
            [
                np.array([i or 0 for i in self.ids], "<i8").tobytes(),
                np.array([i is None for i in self.ids], "u1").tobytes(),
                np.array(self.tokens, "<u8").tobytes(),
                np.array(self.sums, "<u4").tobytes(),
                b"".join(self.escapes),
                np.array(self.blocks, "<u8").tobytes(),
            ]
        )
        self.out.write(tables + FOOTER.pack(len(self.ids), self.words, self.total, sum(map(len, self.escapes)) // 8, len(self.blocks)) + MAGIC)
        self.out.close()
        return len(self.ids), self.total, 2 * len(MAGIC) + 8 * self.words + len(tables) + FOOTER.size


def _writer(folder: str, tokenizer: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, tokens = TaskContext.get(), word_tokens(tokenizer)
        file, number = None, 0

        def close() -> pa.RecordBatch:
            nonlocal file, number
            values = [task.partitionId(), number, file.path, *file.close()]
            file, number = None, number + 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _WRITTEN.types, strict=True)], schema=_WRITTEN)

        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, _, ids, offsets in tokens.encode_column(batch.column(1)):
                ends = offsets[1:] + np.arange(1, len(offsets))
                ids = np.insert(ids, offsets[1:], END)
                at = 0
                while at < len(ends):  # some documents, of about AT_ONCE ids; a longer one by itself
                    begin = int(ends[at - 1]) if at else 0
                    stop = max(at + 1, int(np.searchsorted(ends, begin + AT_ONCE, "right")))
                    file = file or _File(f"{folder}/{task.partitionId():06d}-{number:05d}-{task.taskAttemptId()}.s8b")
                    file.add(names[first + at : first + stop], ids[begin : ends[stop - 1]], ends[at:stop] - begin)
                    at = stop
                    if file.words * 8 >= FILE_BYTES:
                        yield close()
        if file:
            yield close()

    return write


_WRITTEN = pa.schema([("part", pa.int64()), ("file", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])


class TokenFile:
    """A written file, opened to read ids from. Only its tables are held."""

    def __init__(self, path: str):
        system, name = _open(path)
        self.path, self.file = path, system.open_input_file(name)
        size = self.file.size()
        tail = self._at(size - FOOTER.size - len(MAGIC), FOOTER.size + len(MAGIC))
        if tail[FOOTER.size :] != MAGIC or self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{path}: not a file of token ids")
        documents, self.words, self.n_ids, escapes, blocks = FOOTER.unpack(tail[: FOOTER.size])
        at = len(MAGIC) + 8 * self.words
        tables = self._at(at, size - at - FOOTER.size - len(MAGIC))
        cuts = np.cumsum([0, 8 * documents, documents, 8 * documents, 4 * documents, 8 * escapes, 8 * blocks])
        if cuts[-1] != len(tables):
            raise ValueError(f"{path}: tables of {len(tables)} bytes, {cuts[-1]} expected")
        own = [np.frombuffer(tables[a:b], t) for a, b, t in zip(cuts[:-1], cuts[1:], ("<i8", "u1", "<u8", "<u4", "<u8", "<u8"), strict=True)]
        self.ids, self.nameless, self.tokens, self.sums, self.escapes, self.blocks = own
        self.nameless = self.nameless.astype(bool)
        self.tokens, self.blocks = self.tokens.astype(np.int64), self.blocks.astype(np.int64)
        self.starts = np.cumsum(self.tokens) - self.tokens

    def _at(self, offset: int, n: int) -> bytes:
        return self.file.read_at(n, offset)

    def block_ids(self, first: int, stop: int) -> np.ndarray:
        """All ids of blocks ``first`` to ``stop`` - 1."""
        low, high = first * BLOCK_WORDS, min(stop * BLOCK_WORDS, self.words)
        return decode(np.frombuffer(self._at(len(MAGIC) + 8 * low, 8 * (high - low)), "<u8"), self.escapes)

    def read_ids(self, first: int, n: int) -> np.ndarray:
        """``n`` ids of the file from the ``first`` on, by reading only the blocks that hold them."""
        if n <= 0:
            return np.zeros(0, np.uint64)
        a, b = np.searchsorted(self.blocks, [first, first + n - 1], "right") - 1
        return self.block_ids(int(a), int(b) + 1)[first - self.blocks[a] : first - self.blocks[a] + n]

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """Number and ids of each document, in order; some blocks are decoded at a time (as many as a longer document has)."""
        held, at = np.zeros(0, np.uint64), 0  # ids read, and the place of the first of them
        block, last = 0, len(self.blocks)
        for k, (start, n) in enumerate(zip(self.starts.tolist(), self.tokens.tolist(), strict=True)):
            parts = [held[start - at :]]
            have = len(parts[0])
            while have < n and block < last:
                more = self.block_ids(block, min(block + BLOCKS_AT_ONCE, last))
                block = min(block + BLOCKS_AT_ONCE, last)
                parts.append(more)
                have += len(more)
            if len(parts) > 1:
                held, at = np.concatenate(parts), start
            own = held[start - at : start - at + n]
            if len(own) < n:
                raise ValueError(f"{self.path}: ids end in document {k}")
            yield k, own


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            file = TokenFile(path)
            sums = np.zeros(len(file.ids), np.int64)
            for k, ids in file.documents():
                sums[k] = zlib.crc32(ids.astype("<u4"))
            if (sums != file.sums).any():
                raise ValueError(f"{path}: ids differ from their checksums")
            arrays = [pa.array(file.ids, pa.int64(), mask=file.nameless), pa.array(first + file.starts), pa.array(file.tokens), pa.array(sums)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """Write the ids of ``docs(doc_id, text, ...)`` in ascending order of doc_id (null first; of equal ids by the text's CRC-32 and length), END after each; returns the table of files, ``(part, file, path, documents, ids, bytes, first_id)``.

    A null text is empty, its document END alone. Rows that repeat are documents of their own; an empty table writes no file. Texts are
    sorted by range and each task tokenises and writes its own, so that nothing larger than the texts is shuffled or kept.
    """
    tables = Tables(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    ordered = docs.select("doc_id", "text").sort(F.col("doc_id").asc_nulls_first(), F.crc32(text), F.octet_length(text))
    files = tables.write(ordered.mapInArrow(_writer(folder, tokenizer), WRITTEN), "files")
    # tasks are few, files of a task too: first the ids before each task, then before each file of it
    tasks = files.groupBy("part").agg(F.sum("ids").alias("own"))
    tasks = tasks.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("before"))
    within = F.sum("ids").over(Window.partitionBy("part").orderBy("file")) - F.col("ids")
    return tables.write(files.withColumn("within", within).join(tasks, "part").withColumn("first_id", F.col("before") + F.col("within")).drop("before", "within"), "manifest")


#: Tasks of the reading job for each core.
TASKS_A_CORE = 16


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Every document of the files of ``manifest``: ``(doc_id, start, n_tokens, ids_crc32)``, from ids decoded and held against the files' checksums."""
    tasks = max(1, min(manifest.count(), TASKS_A_CORE * manifest.sparkSession.sparkContext.defaultParallelism))
    return manifest.select("path", "first_id").repartition(tasks).mapInArrow(_reader, READ)


def op13_simple8b(spark, sf_dir: str) -> DataFrame:
    """The token ids of all ``documents``, written to files in the shared folder and read back."""
    return read_tokens(write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_tokenizer(), scratch(spark, "tokens")))
