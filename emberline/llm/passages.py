"""Repeated passages across documents by MinHash banding of paragraphs.

Paragraphs are all runs of 50 words, since a repeated passage can start and end inside a line. Each band is one
MinHash of a paragraph's five-word shingles; neighbouring paragraphs mostly share their minimum, so a document has one
entry for each different minimum. Entries that collide across documents get their surrounding words and are sorted by
them; neighbours in that order share the longest continuation. Where more entries collide than a row is compared with,
all pairs of their different surroundings that can match are compared, too. Pairs are verified by exact Jaccard similarity
of aligned paragraphs, and clustered by components; the first occurrence of each component stays.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import byte_texts, row_numbers, small_batches, stored
from emberline.llm.minhash_forest import mixed
from emberline.operators.spanning import contract
from emberline.session import spread

PARAGRAPH, SHINGLE = 50, 5
WINDOW = PARAGRAPH - SHINGLE + 1
#: Two bands of one row: a pair of paragraphs at Jaccard 0.75 collides with 0.94, at 0.9 with 0.99, equal ones always.
BANDS = 2
#: Shingles that two aligned paragraphs share at Jaccard 0.75: m / (2 WINDOW - m) >= 0.75.
SHARED = -(-6 * WINDOW // 7)
NEAR = 4  # rows before in the sorted order that are compared
PAIRED = 512  # surroundings of one minimum whose pairs are looked at one by one
MEMO_WORDS = 1 << 19
_SEEDS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


class WordHashes:
    def __init__(self) -> None:
        self.memo: dict[bytes, int] = {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()  # bytes: A-Z only, and the six ASCII white space characters
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in set(words):
            if w not in memo:
                memo[w] = xxhash.xxh64_intdigest(w)
        return np.array([memo[w] for w in words], np.uint64)


def minima(words: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, values) of the different minima of all paragraphs of a document; a run of equal shingles counts once."""
    n = len(words) - SHINGLE + 1
    if n < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    hashed = np.full(n, _SEEDS[band], np.uint64)
    for k in range(SHINGLE):
        hashed = mixed(hashed * _SEEDS[0] + words[k : k + n])
    least, place, width = hashed, np.arange(n), 1
    while width < WINDOW:  # leftmost minima of windows of twice the width, then of the whole one
        ahead = min(width, WINDOW - width)
        later = least[ahead:] < least[:-ahead]
        least, place = np.where(later, least[ahead:], least[:-ahead]), np.where(later, place[ahead:], place[:-ahead])
        width += ahead
    places = np.unique(place)
    values = hashed[places]
    again = np.zeros(len(places), bool)
    again[1:] = (np.diff(places) == 1) & (values[1:] == values[:-1])
    return places[~again], values[~again]


_MIN_DDL = "row bigint, doc_id bigint, text binary, entries array<struct<entry:bigint,h:bigint,pos:int>>"


def _mins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, rows, entries = WordHashes(), 0, 0
    for batch in small_batches(batches):
        texts = byte_texts(batch.column(1))
        found = [[minima(words, band) for band in range(BANDS)] for words in map(hashes, texts)]
        ends = np.cumsum([0] + [sum(len(places) for places, _ in own) for own in found], dtype=np.int32)
        places = np.concatenate([np.empty(0, np.int64)] + [p for own in found for p, _ in own])
        values = np.concatenate([np.empty(0, np.uint64)] + [v for own in found for _, v in own])
        items = pa.StructArray.from_arrays(
            [pa.array(row_numbers(entries, len(places))), pa.array(values.view(np.int64)), pa.array(places.astype(np.int32))], ["entry", "h", "pos"]
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array(row_numbers(rows, len(texts))), batch.column(0), pa.array(texts, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), items)],
            names=["row", "doc_id", "text", "entries"],
        )
        rows += len(texts)
        entries += len(places)


_AFTER, _BEFORE = PARAGRAPH, PARAGRAPH - SHINGLE
_CONTEXT_DDL = "entry bigint, row bigint, pos int, key binary, before binary, many boolean, again int"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each wanted entry of a document: h and the words from it on as the key, and the words before it, nearest first.

    Words are 16-bit hashes, 0 beyond the ends of the text. ``again`` counts the equal entries before it in its row.
    """
    hashes = WordHashes()
    for batch in small_batches(batches, 64):
        out = {k: [] for k in ("entry", "row", "pos", "key", "before", "many", "again")}
        for row, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
            words = (hashes(text) >> np.uint64(48)).astype(">u2")
            words = np.maximum(words, 1).astype(">u2")
            padded = np.concatenate([np.zeros(_BEFORE, ">u2"), words, np.zeros(_AFTER, ">u2")])
            seen = Counter()
            for e in wanted:
                at = e["pos"] + _BEFORE
                out["entry"].append(e["entry"])
                out["row"].append(row)
                out["pos"].append(e["pos"])
                out["key"].append((e["h"] + (1 << 63)).to_bytes(8, "big") + padded[at : at + _AFTER].tobytes())
                out["before"].append(padded[at - _BEFORE : at][::-1].tobytes())
                out["many"].append(e["many"])
                out["again"].append(seen[out["key"][-1] + out["before"][-1]])
                seen[out["key"][-1] + out["before"][-1]] += 1
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.bool_(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))


def repeated_ranges(words_a: np.ndarray, words_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(any, first, last + 1): per pair of rows whether aligned paragraphs reach Jaccard 0.75, and the words they span.

    Words count from the entry that both rows are aligned at.
    """
    equal = (words_a == words_b) & (words_a != 0)
    n = equal.shape[1] - SHINGLE + 1
    run = np.logical_and.reduce([equal[:, k : k + n] for k in range(SHINGLE)])
    total = np.zeros((len(run), n + 1), np.int16)
    np.cumsum(run, axis=1, out=total[:, 1:])
    fits = total[:, WINDOW:] - total[:, :-WINDOW] >= SHARED
    last = fits.shape[1] - 1 - fits[:, ::-1].argmax(axis=1)
    return fits.any(axis=1), fits.argmax(axis=1) - _BEFORE, last + PARAGRAPH - _BEFORE


_LINKED = pa.schema([
    ("entry", pa.int64()), ("row", pa.int64()), ("pos", pa.int32()), ("key", pa.binary()), ("before", pa.binary()), ("label", pa.int64()),
    ("other", pa.int64()), ("first", pa.int32()), ("last", pa.int32()),
])
_LINKED_DDL = "entry bigint, row bigint, pos int, key binary, before binary, label bigint, other bigint, first int, last int"


def _linked(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _LINKED], schema=_LINKED)


def _words_around(ahead: np.ndarray, before: list[bytes]) -> np.ndarray:
    """Rows of word hashes in text order, from the bytes of the words from an entry on and of those before it."""
    return np.concatenate([np.frombuffer(b"".join(before), np.uint16).reshape(len(before), -1)[:, ::-1], ahead.copy().view(np.uint16)], axis=1)


def _linker(borders: bool):
    """Links each row with the NEAR rows before it in the sorted order.

    Rows that follow each other as links share the label of the first; other links give pairs (label, other). Output:
    linked rows with their label and range, pairs of labels, and with ``borders`` the first and last rows of the task.
    Without, rows come with a label, and only pairs and ranges are added.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = None, 0

        def rows_of(x, part):
            return {k: v[part] for k, v in x.items()}

        def out(x, part):
            part = part[x["last"][part] > x["first"][part]]
            return _linked(len(part), **{k: x[k][part] for k in ("entry", "row", "pos", "label", "first", "last")})

        def border(x):
            return _linked(len(x["entry"]), **{k: x[k] for k in ("entry", "row", "pos", "label")}, key=x["key"].tolist(), before=x["before"].tolist())

        for batch in small_batches(batches, 4096):
            n = batch.num_rows
            if not n:
                continue
            key, before = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            ahead = np.frombuffer(b"".join(key), np.uint8).reshape(n, -1)
            x = {
                "entry": batch.column(0).to_numpy(), "row": batch.column(1).to_numpy(), "pos": batch.column(2).to_numpy(),
                "key": np.array(key, object), "before": np.array(before, object), "h": ahead[:, :8].copy().view(np.uint64)[:, 0],
                "words": _words_around(ahead[:, 8:], before),
                "label": (batch.column(0) if borders else batch.column(5)).to_numpy().copy(),
                "first": np.zeros(n, np.int32), "last": np.zeros(n, np.int32), "chained": np.zeros(n, bool),
            }
            old = len(held["entry"]) if held else 0
            if held:
                x = {k: np.concatenate([held[k], v]) for k, v in x.items()}
            pairs = []
            for lag in range(1, NEAR + 1):
                i = np.arange(max(old, lag), old + n)
                i = i[(x["h"][i] == x["h"][i - lag]) & (x["row"][i] != x["row"][i - lag])]
                fits, first, last = repeated_ranges(x["words"][i], x["words"][i - lag])
                i, first, last = i[fits], first[fits], last[fits]
                for k in (i, i - lag):
                    x["first"][k] = np.minimum(x["first"][k], first)
                    x["last"][k] = np.maximum(x["last"][k], last)
                if lag == 1 and borders:
                    x["chained"][i] = True
                    at = np.arange(old + n)
                    start = np.maximum.accumulate(np.where(~x["chained"] & (at >= old), at, old - 1))
                    x["label"][old:] = np.where(start >= old, x["entry"][np.maximum(start, 0)], x["label"][old - 1] if old else 0)[old:]
                else:
                    pairs.append((i, i - lag))
            for i, j in pairs:
                one, two = x["label"][i], x["label"][j]
                if (apart := one != two).any():
                    yield _linked(int(apart.sum()), label=np.minimum(one, two)[apart], other=np.maximum(one, two)[apart])
            if borders and seen < NEAR:
                yield border(rows_of(x, slice(old, old + NEAR - seen)))
            seen += n
            done = max(0, old + n - NEAR)
            yield out(x, np.arange(done))
            held = rows_of(x, slice(done, None))
        if held:
            yield out(held, np.arange(len(held["entry"])))
            if borders and seen > NEAR:
                yield border(held)

    return link


# Aligned paragraphs at Jaccard 0.75 differ in at most 6 shingles: in one place of one or two words, or at their ends. Of the
# five blocks of 8 words that lie in every paragraph, three are then equal.
_BLOCK, _FIRST = 8, _BEFORE % 8
_BLOCKS = (_BEFORE + _AFTER - _FIRST) // _BLOCK
EQUAL_BLOCKS = 3
#: Words of a paragraph whose difference costs at most as many shingles; any words that do lie in one of these sets.
_LOST = WINDOW - SHARED
OPEN_WORDS = [
    *([*range(a), *range(PARAGRAPH - _LOST + a, PARAGRAPH)] for a in range(_LOST + 1)),
    *([p, end] for p in range(SHINGLE, PARAGRAPH - SHINGLE) for end in (0, PARAGRAPH - 1)),
    *([p, p + 1] for p in range(SHINGLE, PARAGRAPH - SHINGLE - 1)),
]


def blocks_of(words: np.ndarray) -> np.ndarray:
    """A hash for each block of 8 words around the entries; 0 where the text does not fill it."""
    found = np.zeros((len(words), _BLOCKS), np.uint64)
    for k in range(_BLOCKS):
        part = words[:, _FIRST + k * _BLOCK : _FIRST + (k + 1) * _BLOCK]
        hashed = np.full(len(words), _SEEDS[2], np.uint64)
        for w in range(_BLOCK):
            hashed = mixed(hashed * _SEEDS[0] + part[:, w])
        found[:, k] = np.where((part != 0).all(axis=1), np.maximum(hashed, 1), 0)
    return found


def _around(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(h, words) of the key and before columns of a batch."""
    ahead = np.frombuffer(b"".join(batch.column("key").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    return ahead[:, :8].copy().view(np.uint64)[:, 0], _words_around(ahead[:, 8:], batch.column("before").to_pylist())


def _joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number that each of ``n`` is linked to by the links i, j, over others, too."""
    low = np.arange(n)
    while True:
        least, new = np.minimum(low[i], low[j]), low.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == low).all():
            return low
        low = new


_PAIRED_DDL = "rep bigint, other bigint, first int, last int"


_CLASS = ["rep", "lo", "hi", "pos"]
_PAIRED = pa.schema([(k, pa.int64()) for k in ("rep", "other", "row")] + [(k, pa.int32()) for k in ("pos", "first", "last")])
_PAIRED_DDL = "rep bigint, other bigint, row bigint, pos int, first int, last int"


def _paired(x: dict[str, np.ndarray], low: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    out = np.flatnonzero(last > first)
    columns = (x["rep"], x["rep"][low], x["lo"], x["pos"], first, last)
    return pa.RecordBatch.from_arrays([pa.array(v[out], f.type) for v, f in zip(columns, _PAIRED)], schema=_PAIRED)


def _matches(x: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Of one bucket, the surroundings that match another or, if they are in several rows, themselves; with a linked one."""
    n = len(x["rep"])
    shared = np.zeros((n, n), np.int8)
    for column in x["blocks"].T:
        shared += (column[:, None] == column[None, :]) & (column != 0)
    i, j = np.nonzero(np.triu(shared >= EQUAL_BLOCKS))
    here = (x["h"][i] == x["h"][j]) & ((x["lo"][i] != x["lo"][j]) | (x["lo"][i] != x["hi"][i]) | (x["lo"][j] != x["hi"][j]))
    i, j = i[here], j[here]
    first, last, linked = np.full(n, PARAGRAPH, np.int32), np.full(n, -_BEFORE, np.int32), np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 14):
        part = slice(at, at + (1 << 14))
        fits, one, end = repeated_ranges(x["words"][i[part]], x["words"][j[part]])
        linked[part] = fits
        for k in (i[part][fits], j[part][fits]):
            np.minimum.at(first, k, one[fits])
            np.maximum.at(last, k, end[fits])
    return _paired(x, _joined(n, i[linked], j[linked]), first, last)


def _pair_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of buckets that follow one another as sorted rows; a bucket holds few times ``PAIRED`` rows."""
    held = None
    for batch in small_batches(batches, 4096):
        if not batch.num_rows:
            continue
        h, words = _around(batch)
        x = {"h": h, "words": words, "blocks": blocks_of(words)} | {k: batch.column(k).to_numpy() for k in ("bucket", *_CLASS)}
        if held:
            x = {k: np.concatenate([held[k], v]) for k, v in x.items()}
        cuts = [0, *(np.flatnonzero(np.diff(x["bucket"])) + 1)]
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1 or x["lo"][a] != x["hi"][a]:
                yield _matches({k: v[a:b] for k, v in x.items()})
        held = {k: v[cuts[-1] :] for k, v in x.items()}
    if held:
        yield _matches(held)


_STARTS = 8  # paragraphs of a part: it has the words of so many that start one after the other
_PART_WORDS = PARAGRAPH + _STARTS - 1
_PARTS_DDL = "bucket bigint, part int, rep bigint, lo bigint, hi bigint, pos int, words binary"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each surroundings' words in parts, for the paragraphs that start in ``_STARTS`` places each."""
    for batch in small_batches(batches, 4096):
        n = batch.num_rows
        if not n:
            continue
        h, words = _around(batch)
        words = np.concatenate([words, np.zeros((n, _PART_WORDS), np.uint16)], axis=1)
        for part in range(-(-(_BEFORE + 1) // _STARTS)):
            own = words[:, part * _STARTS : part * _STARTS + _PART_WORDS].copy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(mixed(h + np.uint64(part)).view(np.int64)), pa.array(np.full(n, part, np.int32)), *(batch.column(k) for k in _CLASS),
                 pa.array([w.tobytes() for w in own], pa.binary())],
                names=["bucket", "part", *_CLASS, "words"],
            )


def _cliques(x: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Like ``_matches`` for one part of all surroundings of a minimum, in time that grows with their number.

    Paragraphs that are equal but for one set of ``OPEN_WORDS`` match each other, and no others do.
    """
    n, words = len(x["rep"]), x["words"]
    first, last, low = np.full(n, PARAGRAPH, np.int32), np.full(n, -_BEFORE, np.int32), np.arange(n)
    value = mixed(mixed(words.astype(np.uint64) + _SEEDS[1]) * _SEEDS[0] + np.arange(words.shape[1], dtype=np.uint64))
    blank = (words == 0).astype(np.int64)
    for at in range(_STARTS):
        start = int(x["part"][0]) * _STARTS + at
        if start > _BEFORE:
            break
        paragraph, blanks = value[:, at : at + PARAGRAPH], blank[:, at : at + PARAGRAPH]
        whole, holes = paragraph.sum(axis=1), blanks.sum(axis=1)
        for free in OPEN_WORDS:
            full = np.flatnonzero(holes == blanks[:, free].sum(axis=1))
            if not len(full):
                continue
            key = whole[full] - paragraph[:, free][full].sum(axis=1)
            order = np.argsort(key)
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
            rows, sizes = full[order], np.diff(np.concatenate([cuts, [len(order)]]))
            several = np.repeat(np.minimum.reduceat(x["lo"][rows], cuts) != np.maximum.reduceat(x["hi"][rows], cuts), sizes)
            i, j = rows[several], np.repeat(rows[cuts], sizes)[several]
            first[i] = np.minimum(first[i], start - _BEFORE)
            last[i] = np.maximum(last[i], start + PARAGRAPH - _BEFORE)
            if (apart := low[i] != low[j]).any():
                low = _joined(n, np.concatenate([np.arange(n), i[apart]]), np.concatenate([low, j[apart]]))
    return _paired(x, low, first, last)


def _clique_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of parts whose rows follow one another; one part of one minimum is held at a time."""
    held: list[dict[str, np.ndarray]] = []

    def whole() -> pa.RecordBatch:
        return _cliques({k: np.concatenate([x[k] for x in held]) for k in held[0]})

    for batch in batches:
        if not batch.num_rows:
            continue
        x = {k: batch.column(k).to_numpy() for k in ("bucket", "part", *_CLASS)}
        x["words"] = np.frombuffer(b"".join(batch.column("words").to_pylist()), np.uint16).reshape(batch.num_rows, -1)
        cuts = [0, *(np.flatnonzero(np.diff(x["bucket"])) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[0]["bucket"][0] != x["bucket"][a]:
                yield whole()
                held = []
            held.append({k: v[a:b] for k, v in x.items()})
    if held:
        yield whole()


def _beyond_neighbours(contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ranges, pairs) of the entries of h that have more entries than a row is compared with in the sorted order.

    Equal surroundings are one class, known by its first entry: the others are linked with it in the sorted order, where
    a row has at most ``NEAR`` of them. Classes of one h are compared pair by pair, and where they are more than ``PAIRED``,
    by what matching paragraphs have in common.
    """
    many = contexts.filter("many").withColumn("c1", F.xxhash64("key", "before")).withColumn("c2", F.xxhash64("before", "key", F.lit(1)))
    classes = stored(
        many.groupBy("c1", "c2").agg(
            F.min("entry").alias("rep"), F.min("row").alias("lo"), F.max("row").alias("hi"), F.min_by("pos", "entry").alias("pos"),
            F.any_value("key").alias("key"), F.any_value("before").alias("before"), F.max("again").alias("most"), F.count("*").alias("n"),
        ),
        "classes",
    )
    keyed = classes.withColumn("bucket", F.xxhash64(F.substring("key", 1, 8)))
    large = stored(keyed.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > PAIRED).select("bucket"), "large")
    few = spread(keyed.join(large, "bucket", "left_anti").select("bucket", *_CLASS, "key", "before"), "bucket")
    parts = keyed.join(large, "bucket", "left_semi").select(*_CLASS, "key", "before").mapInArrow(_parts, _PARTS_DDL)
    found = stored(
        few.sortWithinPartitions("bucket").mapInArrow(_pair_buckets, _PAIRED_DDL).unionByName(
            spread(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_clique_buckets, _PAIRED_DDL)
        ),
        "paired",
    )
    reach = stored(found.groupBy("rep", "row", "pos").agg(F.min("first").alias("first"), F.max("last").alias("last")), "reach")
    span = [(F.col("pos") + F.col("first")).alias("first_word"), (F.col("pos") + F.col("last")).alias("last_word"), F.col("rep").alias("label")]
    apart = classes.filter(f"n > 1 AND (lo = hi OR most >= {NEAR})").select("c1", "c2", "rep").join(reach.select("rep", "first", "last"), "rep")
    rest = many.select("entry", "row", "pos", "c1", "c2").join(apart, ["c1", "c2"]).select("entry", "row", *span)
    ranges = reach.select(F.col("rep").alias("entry"), "row", *span).unionByName(rest)
    return ranges, found.filter("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b"), F.lit(0.0).alias("w"))


def _overlaps(ranges: DataFrame) -> DataFrame:
    """Pairs (a, b, w) of labels whose ranges share a paragraph in one row: entries of one passage, found in different rows each.

    One of the entries can lie so near the passage's end that it is an entry only where the text goes on alike.
    """
    before = Window.partitionBy("row").orderBy("first_word", "last_word", "entry")
    reach = F.struct("last_word", "label")
    seen = ranges.withColumn("far", F.max(reach).over(before.rowsBetween(Window.unboundedPreceding, -1)))
    shared = F.least("last_word", "far.last_word") - F.col("first_word")
    return seen.filter((shared >= PARAGRAPH) & (F.col("label") != F.col("far.label"))).select(
        F.col("label").alias("a"), F.col("far.label").alias("b"), F.lit(0.0).alias("w")
    )


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id, first_word, last_word, n_docs, removed): one row per occurrence of a repeated passage.

    Words are counted from 0, split at ASCII white space, A-Z lower-cased; last_word is excluded. An occurrence is an
    entry whose surrounding paragraphs repeat in another row; entries whose ranges share a whole paragraph in one row
    are of one passage. component_id is the smallest doc_id of its component, and the occurrence in the smallest
    (doc_id, row) stays. Texts of fewer than 50 words, null and empty ones have no
    passages. Repeated rows are different rows, so their passages repeat. A null doc_id counts as larger than any
    other when the one that stays is chosen. An empty table gives an empty result.
    """
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    mins = stored(chosen.mapInArrow(_mins, _MIN_DDL), "mins")
    entries = mins.select("row", F.explode("entries").alias("e")).select("row", "e.entry", "e.h", "e.pos")
    several = stored(
        entries.groupBy("h").agg(F.min("row").alias("one"), F.max("row").alias("two"), (F.count("*") > NEAR + 1).alias("many"))
        .filter("one <> two").select("h", "many"),
        "several",
    )
    wanted = entries.join(several, "h").groupBy("row").agg(F.collect_list(F.struct("entry", "h", "pos", "many")).alias("wanted"))
    contexts = stored(
        mins.select("row", "text").join(stored(wanted, "wanted"), "row").select("row", "text", "wanted").mapInArrow(_contexts, _CONTEXT_DDL),
        "contexts",
    )
    columns = ["entry", "row", "pos", "key", "before"]
    ordered = contexts.select(*columns).repartitionByRange("key", "before", "entry").sortWithinPartitions("key", "before", "entry")
    linked = stored(ordered.mapInArrow(_linker(True), _LINKED_DDL), "linked")
    # A few rows of each task: neighbours that lie in different tasks meet here.
    border = linked.filter("key IS NOT NULL").select(*columns, "label").dropDuplicates(["entry"]).coalesce(1)
    met = stored(border.sortWithinPartitions("key", "before", "entry").mapInArrow(_linker(False), _LINKED_DDL), "border")
    every = linked.filter("key IS NULL").unionByName(met)
    pairs = every.filter("other IS NOT NULL").select(F.col("label").alias("a"), F.col("other").alias("b"), F.lit(0.0).alias("w"))
    further, far_pairs = _beyond_neighbours(contexts)
    near = every.filter("entry IS NOT NULL").select(
        "entry", "row", (F.col("pos") + F.col("first")).alias("first_word"), (F.col("pos") + F.col("last")).alias("last_word"), "label"
    )
    ranges = stored(
        near.unionByName(further).groupBy("entry", "row").agg(
            F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.min("label").alias("label"),
            F.max("label").alias("second"),
        ),
        "ranges",
    )
    same = ranges.filter("label <> second").select(F.col("label").alias("a"), F.col("second").alias("b"), F.lit(0.0).alias("w"))
    _, roots = contract(pairs.unionByName(far_pairs).unionByName(same).unionByName(_overlaps(ranges)))
    named = stored(
        ranges.join(stored(roots, "roots").withColumnRenamed("node", "label"), "label", "left").withColumn("root", F.coalesce("root", "label"))
        .join(mins.select("row", "doc_id"), "row"),
        "named",
    )
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "entry")
    parts = named.groupBy("root", "row").agg(F.min(rank).alias("least"))
    sums = stored(parts.groupBy("root").agg(F.min("least").alias("least"), F.count("*").alias("n_docs")), "sums")
    return named.join(sums, "root").select(
        "doc_id", F.col("least.doc_id").alias("component_id"), "first_word", "last_word", "n_docs", (F.col("row") != F.col("least.row")).alias("removed")
    )


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): per document the removed word ranges, overlapping ones merged. Rows are told apart by doc_id."""
    spans = repeated_passages(docs).filter("removed").select("doc_id", F.struct("first_word", "last_word").alias("s"))
    merged = F.aggregate(
        F.sort_array(F.collect_set("s")), F.array().cast("array<struct<first_word:int,last_word:int>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["last_word"] >= s["first_word"]),
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(done, -1)["first_word"].alias("first_word"), F.greatest(F.element_at(done, -1)["last_word"], s["last_word"]).alias("last_word"))),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    return spans.groupBy("doc_id").agg(merged.alias("spans"))
