"""Periodic runs of words: maximal stretches that repeat a shortest period at least three times.

Words become integers, texts one array with a different border after each. For a period p, every run of it covers a
point of a grid whose step is the least number of equal pairs (i, i + p) that a run has: harmonically fewer points for
longer periods. At a grid point whose two words agree, the longest common extensions to both sides (LCE) give the run.

An LCE compares words until both places lie on samples: positions whose residue is in a difference cover, of which
every distance finds a pair within ``COVER`` words. Only suffixes at samples are sorted, by names of blocks of
``COVER`` words and by doubling; from there on the LCE is a range minimum over the common prefixes of neighbours in
that order, by a sparse table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import byte_texts, small_batches

LEAST_LENGTH, LEAST_TIMES = 24, 3
#: A perfect difference set: every distance modulo COVER is a difference of two of its residues.
COVER, RESIDUES = 31, (0, 1, 3, 8, 12, 18)
BATCH_WORDS = 1 << 16
GRID_POINTS = 1 << 20  # grid points held at a time


def _synchronised() -> np.ndarray:
    """[residue of i, (j - i) mod COVER]: words until i and j both lie on samples."""
    sampled = np.isin(np.arange(COVER), RESIDUES)
    i, d, step = np.ogrid[:COVER, :COVER, :COVER]
    return (sampled[(i + step) % COVER] & sampled[(i + d + step) % COVER]).argmax(axis=2)


SYNC = _synchronised()


def compared(words: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Equal words from i and j on, up to ``most``."""
    same = np.zeros(len(i), np.int64)
    live, step = np.flatnonzero(most > 0), 0
    while len(live):
        live = live[words[i[live] + step] == words[j[live] + step]]
        step += 1
        same[live] = step
        live = live[most[live] > step]
    return same


class Extensions:
    """Common extensions to the right in an array whose last COVER words, and a border in it, occur once."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        n = len(words) - COVER
        places = np.arange(n)
        residues = np.isin(places % COVER, RESIDUES)
        places = places[residues]
        places = places[np.lexsort((places, places % COVER))]  # by residue, so that the next block's sample follows
        self.sample = np.full(n, -1, np.int64)
        self.sample[places] = np.arange(len(places))
        self.places = places
        self._sort()

    def _sort(self) -> None:
        places, m = self.places, len(self.places)
        blocks = np.lib.stride_tricks.sliding_window_view(self.words, COVER)[places].astype(">u4")
        names = np.unique(np.ascontiguousarray(blocks).view(f"V{4 * COVER}").ravel(), return_inverse=True)[1].ravel() + 1
        column = places % COVER
        levels, ahead = [names], 1
        while len(names) and names.max() < m:  # suffixes that still share their first ahead blocks
            after = np.zeros(m, np.int64)
            inside = np.flatnonzero(column[ahead:] == column[:-ahead]) if ahead < m else np.empty(0, np.int64)
            after[inside] = names[inside + ahead]
            names = np.unique(names * (m + 1) + after, return_inverse=True)[1].ravel() + 1
            levels.append(names)
            ahead *= 2
        self.rank = names - 1
        order = np.empty(m, np.int64)
        order[self.rank] = np.arange(m)
        self._minima(order, levels[:-1] if len(levels) > 1 else levels)

    def _minima(self, order: np.ndarray, levels: list[np.ndarray]) -> None:
        """Common prefixes of neighbours in the order, in words, and their minima over runs of 1, 2, 4 ... neighbours."""
        one, two = order[:-1].copy(), order[1:].copy()
        blocks = np.zeros(len(one), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            inside = (one < len(order)) & (two < len(order))
            equal = np.flatnonzero(inside)
            equal = equal[levels[k][one[equal]] == levels[k][two[equal]]]
            blocks[equal] += 1 << k
            one[equal] += 1 << k
            two[equal] += 1 << k
        i, j = self.places[order[:-1]] + blocks * COVER, self.places[order[1:]] + blocks * COVER
        rest = compared(self.words, i, j, np.full(len(i), COVER))
        self.table = [blocks * COVER + rest]
        while 2 << (len(self.table) - 1) <= len(one):
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def sampled(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """LCE of different samples i and j."""
        one, two = self.rank[self.sample[i]], self.rank[self.sample[j]]
        low, high = np.minimum(one, two), np.maximum(one, two)
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << int(k))])
        return out


class Sides:
    """LCEs in both directions over several texts; the samples are sorted when a pair first reaches them."""

    def __init__(self, texts: list[np.ndarray]) -> None:
        """``texts``: numbers of words from 0."""
        high = max((int(t.max()) + 1 for t in texts if len(t)), default=0)
        border = iter(range(high, high + 2 * COVER + len(texts)))
        parts: list[np.ndarray] = [np.fromiter(border, np.int64, COVER)]
        for t in texts:
            parts += [t, np.array([next(border)])]
        parts.append(np.fromiter(border, np.int64, COVER))
        self.words = np.concatenate(parts).astype(np.uint32)
        self.starts = COVER + np.cumsum([0] + [len(t) + 1 for t in texts[:-1]], dtype=np.int64)
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.back = self.words[::-1].copy()
        self.sorted: dict[bool, Extensions] = {}

    def _extend(self, words: np.ndarray, i: np.ndarray, j: np.ndarray, back: bool, samples: bool) -> tuple[np.ndarray, np.ndarray]:
        """(LCE, whether it went on past the words that were compared)."""
        until = SYNC[i % COVER, (j - i) % COVER]
        same = compared(words, i, j, until)
        on = np.flatnonzero((same == until) & (words[np.minimum(i + same, len(words) - 1)] == words[np.minimum(j + same, len(words) - 1)]))
        if samples and len(on):
            if back not in self.sorted:
                self.sorted[back] = Extensions(words)
            same[on] += self.sorted[back].sampled(i[on] + until[on], j[on] + until[on])
        more = np.zeros(len(i), bool)
        more[on] = True
        return same, more

    def around(self, i: np.ndarray, p: np.ndarray, samples: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, open): the stretch around i and i + p in which words p apart are equal."""
        right, more = self._extend(self.words, i, i + p, False, samples)
        n = len(self.words)
        left, less = self._extend(self.back, n - i - p, n - i, True, samples)  # from i + p - 1 and i - 1 leftwards
        return i - left, i + p + right, more | less

    def grid(self, texts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, i, p) of all grid points of the given texts whose words agree, some at a time."""
        most = np.where(self.lengths[texts] >= LEAST_LENGTH, self.lengths[texts] // LEAST_TIMES, 0)
        text = np.repeat(texts, most)
        p = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
        step = np.maximum((LEAST_TIMES - 1) * p, LEAST_LENGTH - p)
        points = -(-(self.lengths[text] - p) // step)
        total = np.cumsum(points)
        begin = 0
        while begin < len(p):
            base = int(total[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, base + GRID_POINTS, "right")))
            n = points[begin:end]
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            of, period = np.repeat(text[begin:end], n), np.repeat(p[begin:end], n)
            i = self.starts[of] + k * np.repeat(step[begin:end], n)
            hit = np.flatnonzero(self.words[i] == self.words[i + period])
            yield of[hit], i[hit], period[hit]
            begin = end


def find_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Per text (word numbers) its runs (start, length, period), by start and period."""
    found: list[dict[tuple[int, int], int]] = [{} for _ in texts]

    def note(sides: Sides, numbers: np.ndarray, samples: bool) -> np.ndarray:
        """Notes the runs of the texts; returns those with an LCE that needs the samples."""
        unsure = np.zeros(len(sides.lengths), bool)
        for text, i, p in sides.grid(np.arange(len(sides.lengths))):
            start, end, more = sides.around(i, p, samples)
            if not samples:
                unsure[text[more]] = True
            length = end - start
            runs = np.flatnonzero(length >= np.maximum(LEAST_LENGTH, LEAST_TIMES * p))
            rows = np.stack([text[runs], start[runs] - sides.starts[text[runs]], length[runs], p[runs]], axis=1)
            for t, s, n, q in np.unique(rows, axis=0).tolist():
                own = found[numbers[t]]
                own[s, n] = min(q, own.get((s, n), q))  # a multiple of the shortest period ends at the same words
        return np.flatnonzero(unsure)

    if not texts:
        return []
    open_ = note(Sides(texts), np.arange(len(texts)), False)
    for t in open_:
        found[t].clear()
    if len(open_):
        note(Sides([texts[t] for t in open_]), open_, True)
    return [sorted((s, n, q) for (s, n), q in own.items()) for own in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, less those that a run has after its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join(words[k] for k in np.flatnonzero(kept))


_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        found = find_runs([np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words in texts])
        runs = [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in found]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        whole = pa.array([collapsed(w, r) for w, r in zip(texts, found)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(runs, kind), whole], names=["doc_id", "runs", "collapsed"])

    ids, texts, held = [], [], 0
    for batch in small_batches(batches):
        for doc, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
            words = (text or b"").split()  # bytes: the six ASCII white space characters
            ids.append(doc)
            texts.append(words)
            held += len(words)
            if held >= BATCH_WORDS:
                yield done(ids, texts)
                ids, texts, held = [], [], 0
    if ids:
        yield done(ids, texts)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs array of (start, length, period), collapsed string) for every row of ``docs``.

    A run is a stretch of words, split at ASCII white space and numbered from 0, with a shortest period q and at least
    max(24, 3 * q) words that no word beside it extends with the same period. Runs ascend by start, then period.
    collapsed: the words less those that any run has after its first q, joined by a space. Null and empty texts have
    no words and no runs; repeated rows each get a row; an empty table gives an empty result. A task holds one batch of
    about 65,000 words, or one longer text, at a time: some 400 bytes for each of its words at most.
    """
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(_search, f"doc_id bigint, runs {_RUNS}, collapsed string")


def greatest(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equal ones the smallest start, then period. Null without runs."""
    def order(a: Column, b: Column) -> Column:
        more = b["length"] * a["period"] - a["length"] * b["period"]
        first = F.when(more != 0, more).when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"])
        return F.signum(first).cast("int")

    return F.get(F.array_sort(runs, order), F.lit(0))
