"""Passages of a benchmark in documents, by the q-gram lemma in bands of diagonals and banded alignment.

A passage of m characters that a document holds with at most k edits shares at least m + 1 - q (k + 1) of its
q-grams with the document, and the places of these matches lie on neighbouring diagonals (document place less
passage place), at most k apart. So matches are counted in bands of diagonals that overlap by more than k;
bands with enough of them are regions, and a region is verified by an alignment that stays in the band.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .textkit import _PLACE, code_points, mix

Q = 10
#: Edits that a passage may have, as a share of its characters.
EDIT_SHARE = 0.08
#: Longer items are cut into windows of so many characters that overlap by half; one found window tells the item.
WINDOW = 512
#: Items longer than this are also cut into windows of so many characters, so many apart: an excerpt of PASSAGE + STRIDE - 1
#: characters covers one, wherever it is taken from.
PASSAGE, STRIDE = 200, 40
#: The benchmark goes to tasks in blocks of at most so many characters, one pass over the documents for each.
BLOCK_CHARS = 4_000_000
#: ``kind`` is 0 for an item or a window of it, 1 for one of PASSAGE characters, _SHORT for an item shorter than a q-gram: of several places the least kind is told.
FOUND = "row_id long, item_id long, kind int, edits int, start long, stop long"
_SHORT = 2


def normalise(text: str) -> str:
    """Lower case, each run of white space one space."""
    return " ".join(text.lower().split())


def grams(points: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of each run of ``q`` code points."""
    n = max(0, len(points) - q + 1)
    h = np.zeros(n, np.uint64)
    for k in range(q):
        h += points[k : k + n] * _PLACE[k]
    return mix(h)


@dataclass
class Pattern:
    item: int
    source: int  # its place in ``sources`` and, in characters, there
    offset: int
    text: str
    edits: int
    needed: int
    band: int
    part: bool  # a window of PASSAGE characters: told only where no larger one of the item is found


@dataclass
class Benchmark:
    """Index of one block of the benchmark: each q-gram with the items and places that have it, and the passages of each item."""

    sources: list[str] = field(default_factory=list)
    patterns: list[Pattern] = field(default_factory=list)
    short: list[tuple[int, str]] = field(default_factory=list)  # shorter than a q-gram: found only as they are

    def build(self) -> Benchmark:
        keys, source, place = [], [], []
        for k, text in enumerate(self.sources):
            g = grams(code_points(text).astype(np.uint64))
            keys.append(g)
            source.append(np.full(len(g), k))
            place.append(np.arange(len(g)))
        keys = np.concatenate([np.zeros(0, np.uint64), *keys])
        order = np.argsort(keys, kind="stable")
        self.source = np.concatenate([np.zeros(0, np.int64), *source])[order]
        self.place = np.concatenate([np.zeros(0, np.int64), *place])[order]
        self.keys, self.first = np.unique(keys[order], return_index=True)
        self.first = np.append(self.first, len(keys))
        self.shift = np.uint64(64 - max(16, int(np.ceil(np.log2(len(keys) + 1))) + 4))
        self.filter = np.zeros(1 << int(64 - self.shift), bool)
        self.filter[(self.keys >> self.shift).astype(np.int64)] = True
        self.needed = np.array([p.needed for p in self.patterns], np.int64)
        self.step = np.array([p.band for p in self.patterns], np.int64)
        self.offset = np.array([p.offset for p in self.patterns], np.int64)
        self.length = np.array([len(p.text) for p in self.patterns], np.int64)
        # the patterns of a source follow one another; its bands are wide enough for all of them, and it needs what the least of them needs
        self.begin = np.searchsorted([p.source for p in self.patterns], np.arange(len(self.sources) + 1))
        self.source_needed = np.minimum.reduceat(self.needed, self.begin[:-1]) if self.sources else self.needed
        self.source_step = np.maximum.reduceat(self.step, self.begin[:-1]) if self.sources else self.step
        self.longest = max(map(len, self.sources), default=0)
        self.points = code_points("\n".join(self.sources)).astype(np.int32)
        starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in self.sources], dtype=np.int64)))
        self.at = np.array([starts[p.source] + p.offset for p in self.patterns], np.int64)
        self.edits = np.array([p.edits for p in self.patterns], np.int64)
        return self


def _starts(text: str, size: int, stride: int) -> list[int]:
    """Places of windows of ``size`` characters at every ``stride`` and at the end; a text that isn't longer is one."""
    return [0] if len(text) <= size else [*range(0, len(text) - size, stride), len(text) - size]


def _slices(many: np.ndarray, most: int = 2_000_000) -> Iterator[slice]:
    """Runs of rows that become about ``most`` rows when row k is there ``many[k]`` times."""
    total = np.cumsum(many)
    low = 0
    while low < len(many):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + most, "right")))
        yield slice(low, high)
        low = high


def _counted(parts: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of all parts, and how often each is there."""
    values, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in parts:
        own, n = np.unique(part, return_counts=True)
        both, place = np.unique(np.concatenate((values, own)), return_inverse=True)
        counts, values = np.bincount(place, np.concatenate((counts, n)), minlength=len(both)).astype(np.int64), both
    return values, counts


def _full(values: np.ndarray, counts: np.ndarray, needed: np.ndarray, per: int) -> np.ndarray:
    """Values that with the value after them have what is ``needed`` (by the value // ``per``)."""
    pair = counts.copy()
    has = values[1:] == values[:-1] + 1
    pair[:-1][has] += counts[1:][has]
    return values[pair >= needed[(values // per) % max(1, len(needed))]]


def _within(values: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_values, values), max(0, len(sorted_values) - 1))
    return sorted_values[at] == values if len(sorted_values) else np.zeros(len(values), bool)


def benchmark_index(rows: list[tuple[int, str | None]], edit_share: float = EDIT_SHARE) -> Benchmark:
    out = Benchmark()
    for item, text in rows:
        text = normalise(text or "")
        if not text or item is None:
            continue
        if len(text) < Q:
            out.short.append((item, text))
            continue
        windows = [(k, WINDOW, False) for k in _starts(text, WINDOW, WINDOW // 2)] + [(k, PASSAGE, True) for k in _starts(text, PASSAGE, STRIDE) if len(text) > PASSAGE]
        first = {(text[k : k + size], part): k for k, size, part in reversed(windows)}
        for (own, part), offset in reversed(first.items()):
            m = len(own)
            edits = min(int(edit_share * m), m // Q - 1)  # the lemma must ask for one q-gram at least
            edits = max(edits, 0)
            out.patterns.append(Pattern(item, len(out.sources), offset, own, edits, max(1, m + 1 - Q * (edits + 1)), max(8, edits + 1), part))
        out.sources.append(text)
    return out.build()


Candidates = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # text, pattern, lowest and highest diagonal of each


def align_all(index: Benchmark, points: np.ndarray, begins: np.ndarray, lengths: np.ndarray, candidates: Candidates) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edits, start and stop of the best place of each pattern in its text on its diagonals; edits are -1 where there is none within the pattern's bound.

    Most candidates fail, so starts are followed only for those whose edits are within the bound.
    """
    edits, start, stop = (np.full(len(candidates[0]), -1, np.int64) for _ in range(3))
    for follow in (False, True):
        todo = np.flatnonzero(edits >= 0) if follow else np.arange(len(edits))
        order = todo[np.argsort(index.length[candidates[1][todo]], kind="stable")]
        width = candidates[3] - candidates[2] + 1
        first = 0
        while first < len(order):
            rows = order[first : first + max(1, (1 << 18) // int(width[order[first:]].max()))]
            first += len(rows)
            edits[rows], start[rows], stop[rows] = _table(index, points, begins, lengths, tuple(c[rows] for c in candidates), follow)
    return edits, start, stop


def _table(index: Benchmark, points: np.ndarray, begins: np.ndarray, lengths: np.ndarray, candidates: Candidates, follow: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One table for candidates of about equal length, a row at a time; a column is a diagonal. Candidates leave as soon as all their diagonals are over the bound."""
    doc, pattern, low, high = candidates
    edits, start, stop = (np.full(len(doc), -1, np.int64) for _ in range(3))
    m, w, most = index.length[pattern], high - low + 1, index.edits[pattern]
    d, t = low[:, None], lengths[doc][:, None]
    steps = np.arange(int(w.max()), dtype=np.int16)
    place = d + np.arange(int(m.max()) + len(steps))
    text = np.where((place >= 0) & (place < t), points[np.clip(begins[doc][:, None] + place, 0, len(points) - 1)].astype(np.int32), -1)
    own = index.points[np.minimum(index.at[pattern][:, None] + np.arange(int(m.max())), len(index.points) - 1)]
    inside = steps < w[:, None]
    far = (m + w + 1).astype(np.int16)[:, None]
    cost = np.where(inside & (d + steps >= 0) & (d + steps <= t), 0, far).astype(np.int16)
    begin = np.broadcast_to(steps, cost.shape)
    edge = np.full((len(doc), 1), 1 << 14, np.int16)
    # columns whose place is in the text: between these in row 0, and one less of each in every row
    left, right = -d, t - d
    rows = np.arange(len(doc))
    for i in range(1, int(m.max()) + 1):
        through = cost + (text[:, i - 1 : i - 1 + len(steps)] != own[:, i - 1, None])
        skip = np.concatenate((cost[:, 1:], edge), axis=1) + np.int16(1)  # a character of the pattern that the text lacks
        valid = inside & (steps >= left - i) & (steps <= right - i)
        # characters of the text that the pattern lacks: from the left, one each
        level = np.where(valid, np.minimum(through, skip), far) - steps
        lowest = np.minimum.accumulate(level, axis=1)
        if follow:
            come = np.where(through <= skip, begin, np.concatenate((begin[:, 1:], edge), axis=1))
            begin = np.take_along_axis(come, np.maximum.accumulate(np.where(level <= lowest, steps, 0), axis=1), axis=1)
        cost = np.where(valid, np.minimum(lowest + steps, far), far)
        done = m == i
        if done.any():
            at = np.flatnonzero(done)
            k = cost[at].argmin(axis=1)
            good = cost[at, k] <= most[at]
            at, k = at[good], k[good]
            edits[rows[at]], start[rows[at]], stop[rows[at]] = cost[at, k], d[at, 0] + begin[at, k], i + d[at, 0] + k
        if i % 8 == 0 or done.any():
            alive = (cost.min(axis=1) <= most) & ~done
            if not alive.all():
                rows, m, d, far, text, own, inside, cost, begin, most, edge, left, right = (x[alive] for x in (rows, m, d, far, text, own, inside, cost, begin, most, edge, left, right))
            if not len(rows):
                break
    return edits, start, stop


def search(index: Benchmark, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
    """For each normalised text the best place of each item in it: ``(item, edits, start, stop)``."""
    return [[(item, *place) for item, _, *place in own] for own in _places(index, texts)]


def _places(index: Benchmark, texts: list[str]) -> list[list[tuple[int, int, int, int, int]]]:
    """As ``search``, with the kind of what was found: ``(item, kind, edits, start, stop)``."""
    found: list[dict[int, tuple[bool, int, int, int]]] = [{} for _ in texts]

    def told(d: int, p: Pattern, edits: int, start: int, stop: int) -> None:
        before = found[d].get(p.item)
        if before is None or (p.part, edits, start) < before[:3]:
            found[d][p.item] = (p.part, edits, start, stop)

    if index.patterns and texts:
        lengths = np.array([len(t) for t in texts])
        begins = np.concatenate(([0], np.cumsum(lengths + 1)))
        points = code_points("\n".join(texts))  # normalised texts hold no line break
        g = grams(points.astype(np.uint64))
        hits = np.flatnonzero(index.filter[(g >> index.shift).astype(np.int64)])
        at = np.searchsorted(index.keys, g[hits])
        good = at < len(index.keys)
        good[good] = index.keys[at[good]] == g[hits[good]]
        hits, at = hits[good], at[good]
        many = index.first[at + 1] - index.first[at]
        # bands are two steps wide and begin a step apart, so that step + 1 neighbouring diagonals share one
        shift = int(lengths.max()) + index.longest + 4
        span = 2 * shift

        def matches(own: slice) -> tuple[np.ndarray, ...]:
            row = np.repeat(np.arange(own.start, min(own.stop, len(hits))), many[own])
            entry = index.first[at][row] + np.arange(len(row)) - np.repeat(np.cumsum(many[own]) - many[own], many[own])
            source, doc, place = index.source[entry], np.searchsorted(begins, hits, "right")[row] - 1, index.place[entry]
            diagonal = hits[row] - begins[doc] - place
            return source, doc, place, diagonal, (doc * len(index.sources) + source) * span + np.floor_divide(diagonal, index.source_step[source]) + shift

        # first by items, to leave most matches behind, then by the passages of those items
        values, counts = _counted(matches(own)[4] for own in _slices(many))
        full = _full(values, counts, index.source_needed, span)
        near = np.union1d(full, full + 1)

        def by_pattern() -> Iterator[np.ndarray]:
            for own in _slices(many):
                source, doc, place, diagonal, band = matches(own)
                kept = _within(band, near)
                source, doc, place, diagonal = (x[kept] for x in (source, doc, place, diagonal))
                count = index.begin[source + 1] - index.begin[source]
                for few in _slices(count):
                    n = count[few]
                    row = np.repeat(np.arange(few.start, min(few.stop, len(count))), n)
                    pattern = index.begin[source][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    inside = place[row] - index.offset[pattern]
                    inside = (inside >= 0) & (inside <= index.length[pattern] - Q)
                    row, pattern = row[inside], pattern[inside]
                    yield (doc[row] * len(index.patterns) + pattern) * span + np.floor_divide(diagonal[row] + index.offset[pattern], index.step[pattern]) + shift

        if len(near):
            full = _full(*_counted(by_pattern()), index.needed, span)
            rest, band = np.divmod(full, span)
            doc, pattern = np.divmod(rest, len(index.patterns))
            step = index.step[pattern]
            low = (band - shift) * step - index.edits[pattern]
            high = low + 2 * step - 1 + 2 * index.edits[pattern]
            left = []
            for k, (d, p, a, b) in enumerate(zip(doc.tolist(), pattern.tolist(), low.tolist(), high.tolist(), strict=True)):
                own = index.patterns[p]
                exact = texts[d].find(own.text, max(0, a), max(0, b) + len(own.text))
                if exact >= 0:
                    told(d, own, 0, exact, exact + len(own.text))
                elif own.edits:
                    left.append(k)
            # what has its item there without an edit, by as large a passage, needs no alignment
            left = np.array([k for k in left if not ((before := found[doc[k]].get(index.patterns[pattern[k]].item)) and before[:2] <= (index.patterns[pattern[k]].part, 0))], np.int64)
            for k, edits, start, stop in zip(left.tolist(), *(x.tolist() for x in align_all(index, points, begins, lengths, (doc[left], pattern[left], low[left], high[left]))), strict=True):
                if edits >= 0:
                    told(int(doc[k]), index.patterns[pattern[k]], edits, start, stop)
    for item, text in index.short:
        for d, own in enumerate(texts):
            k = f" {own} ".find(f" {text} ")
            if k >= 0 and item not in found[d]:
                found[d][item] = (_SHORT, 0, k, k + len(text))
    return [[(item, *place) for item, place in f.items()] for f in found]


def original_places(text: str) -> np.ndarray:
    """For each character of the normalised text its place in ``text``, and the end of the last."""
    places, gap = [], True
    for k, c in enumerate(text):
        if c.isspace():
            if not gap:
                places.append(k)
            gap = True
        else:
            places += [k] * len(c.lower())
            gap = False
    if gap and places:
        places.pop()
    return np.array([*places, places[-1] + 1 if places else 0])


def _scan(index: Benchmark, most: int = 1_000_000):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            low = 0
            while low < len(texts):
                high, size = low, 0
                while high < len(texts) and (high == low or size + len(texts[high] or "") <= most):
                    size += len(texts[high] or "")
                    high += 1
                clean = [normalise(t or "") for t in texts[low:high]]
                for d, own in enumerate(_places(index, clean)):
                    if own:
                        places = original_places(texts[low + d])
                        rows += [(ids[low + d], item, int(kind), edits, int(places[start]), int(places[stop - 1]) + 1 if stop else 0) for item, kind, edits, start, stop in own]
                low = high
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["row_id", "item_id", "kind", "edits", "start", "stop"])

    return scan


def find_passages(docs: DataFrame, benchmark: DataFrame, edit_share: float = EDIT_SHARE) -> DataFrame:
    """``docs(doc_id, text, ...)`` against ``benchmark(item_id, text, ...)``: ``(doc_id, item_id, edits, start, stop)``.

    A row for each document and item of which the document holds a passage with at most ``edit_share`` times
    its length of edits (fewer for passages so short that the lemma asks for no q-gram), after lower-casing
    and taking white space as one space. A passage is the whole item, a window of ``WINDOW`` characters of a
    longer one, or, where no such is found, a window of ``PASSAGE`` characters, so that any excerpt of
    ``PASSAGE + STRIDE - 1`` characters is found. ``start`` and ``stop`` are characters of the whole text as it is. The
    place with the fewest edits is told, of equal ones the first. Null and empty texts and items hold and are
    found nowhere; items shorter than a q-gram are found only as whole words without edits; repeated rows are
    each searched. A null doc_id is searched too; a null item_id is not. Either table may be empty. Other
    columns are not looked at.

    Passes over the documents: one for each ``BLOCK_CHARS`` characters of the benchmark. For more than one, rows
    are written with a number each, by which the passes' results meet, so that the result is that of one pass.
    """
    items = benchmark.select("item_id", "text").filter("item_id is not null and text is not null")
    blocks = int(-(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS)) or 1

    def scanned(rows: DataFrame, own: DataFrame) -> DataFrame:
        return rows.mapInArrow(_scan(benchmark_index(own.orderBy("item_id", "text").collect(), edit_share)), FOUND)  # about BLOCK_CHARS characters

    if blocks == 1:
        return scanned(docs.select(F.col("doc_id").alias("row_id"), "text"), items).select(F.col("row_id").alias("doc_id"), "item_id", "edits", "start", "stop")
    rows = materialise(docs.select("doc_id", "text").withColumn("row_id", F.monotonically_increasing_id()), "rows")
    found = None
    for k in range(blocks):
        part = scanned(rows.select("row_id", "text"), items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k))
        found = part if found is None else found.unionByName(part)
    # the windows of an item are in one block; those of another text with its id may be in the next
    found = found.groupBy("row_id", "item_id").agg(F.min(F.struct("kind", "edits", "start", "stop")).alias("best"))
    return found.join(rows.select("row_id", "doc_id"), "row_id").select("doc_id", "item_id", "best.edits", "best.start", "best.stop")


def op1_qgram_lemma(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` against all of ``benchmark``."""
    return find_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
