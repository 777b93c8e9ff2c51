"""Near duplicates by an LSH forest over MinHash signatures.

A signature is cut into several keys of ``DEPTH`` minima. Each key order is sorted as a whole; neighbours in it
that share a longest common prefix are candidates. The prefix that a pair must share grows with the density of
its region: where many rows share a prefix, a longer one is asked for. There each row is also paired with the rows
whose sketches are nearest among up to ``CROWD`` of them, and with hubs, the rows that most others are near to. Candidates
whose signatures rule out the wanted similarity are dropped, a spanning forest of the rest is confirmed on the full shingle sets, and so is
every candidate that still lies between two components afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import BLOCK_BITS, byte_texts, row_numbers, rows_of_blocks, small_batches, stored, stored_by_block
from emberline.operators.spanning import contract

WORDS = 5
SIMILARITY = (75, 100)
TREES, DEPTH = 16, 8
HASHES = TREES * DEPTH
DENSE = 32  # rows ahead that must not share the prefix that is asked for; all rows that do share it are paired
NEAR = 4  # rows ahead that are paired where over DENSE rows share a whole key: they lie sorted by their sketches
SHARED = 4  # minima of a key; over DENSE rows that share them are a crowd
CROWD = 1024  # rows of a crowd whose sketches are all compared with each other
HELD = 1 << 18  # rows of a crowd that a task holds at once, 40 bytes each
HUBS = 4  # rows that all others of a crowd are paired with
LIKELY = 0.7  # estimate from which on a hub covers a row
FLOOR = 0.54  # estimate of 0.75 less 4.5 standard deviations of HASHES two-bit comparisons
KEY = 4 * DEPTH + 1
MEMO_WORDS = 1 << 19

_rng = np.random.default_rng(20)
_MULTIPLY = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Shingles:
    """Sorted distinct 64-bit shingle hashes of a text; equal word sequences always give equal hashes."""

    def __init__(self, words: int = WORDS) -> None:
        self.words, self.memo = words, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint64)
        words = text.lower().split()  # bytes: A-Z only, and the six ASCII white space characters
        if not words:
            return np.empty(0, np.uint64)
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in set(words):
            if w not in memo:
                memo[w] = xxhash.xxh64_intdigest(w)
        hashed = np.array([memo[w] for w in words], np.uint64)
        size = min(self.words, len(words))
        n = len(words) - size + 1
        out = np.full(n, size, np.uint64)
        for k in range(size):
            out = mixed(out * _STEP + hashed[k : k + n])
        return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES 32-bit minima."""
    low = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(shingles), 256):
        part = shingles[at : at + 256, None] * _MULTIPLY[None, :]
        low = np.minimum(low, (part >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return low


_SIGNED = pa.schema([
    ("block", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("keys", pa.binary()),
    ("sketch", pa.binary()), ("text", pa.binary()),
])
_SIGNED_DDL = "block bigint, row bigint, doc_id bigint, n bigint, digest binary, keys binary, sketch binary, text binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles, rows = Shingles(), 0
    for batch in small_batches(batches):
        texts = byte_texts(batch.column(1))
        sizes, digests, keys, sketches = [], [], [], []
        for text in texts:
            own = shingles(text)
            sizes.append(len(own))
            if not len(own):
                digests.append(None), keys.append(None), sketches.append(None)
                continue
            digests.append(hashlib.sha256(own.tobytes()).digest())
            low = signature(own)
            grid = np.empty((TREES, KEY), np.uint8)
            grid[:, 0] = np.arange(TREES)
            grid[:, 1:] = low.astype(">u4").view(np.uint8).reshape(TREES, 4 * DEPTH)
            keys.append(grid.tobytes())
            two = (low & np.uint32(3)).astype(np.uint8)
            sketches.append((two[0::4] | two[1::4] << 2 | two[2::4] << 4 | two[3::4] << 6).tobytes())
        binary = lambda v: pa.array(v, pa.binary())
        own_rows = row_numbers(rows, len(texts))
        yield pa.RecordBatch.from_arrays(
            [pa.array(own_rows >> BLOCK_BITS), pa.array(own_rows), batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), binary(digests),
             binary(keys), binary(sketches), binary(texts)],
            schema=_SIGNED,
        )
        rows += len(texts)


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("w", pa.float64())])
_PAIR_DDL = "a bigint, b bigint, w double"


def _prefix(keys: np.ndarray, at: np.ndarray, ahead: int) -> np.ndarray:
    """Shared leading minima of the rows at i and i + ahead; -1 across trees."""
    one, two = keys[at], keys[at + ahead]
    same = (one[:, 1:] == two[:, 1:]).reshape(len(at), DEPTH, 4).all(axis=2)
    shared = np.cumprod(same, axis=1, dtype=np.int8).sum(axis=1)
    return np.where(one[:, 0] == two[:, 0], shared, -1)


def _unequal(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Unequal minima of the sketches of every row of ``one`` and every row of ``two``, or of rows side by side."""
    x = one ^ two
    return np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(axis=-1, dtype=np.int16)


def _estimate(unequal: np.ndarray) -> np.ndarray:
    return (1 - unequal / HASHES - 0.25) / 0.75


def _around(sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(one, two, hubs) of at most ``CROWD`` rows: each row with the ``NEAR`` nearest, and the rows that cover most others."""
    n = len(sketch)
    unequal = np.concatenate([_unequal(sketch[at : at + 64, None], sketch[None]) for at in range(0, n, 64)])
    np.fill_diagonal(unequal, HASHES)
    near = np.argpartition(unequal, min(NEAR, n) - 1, axis=1)[:, :NEAR]
    covers = (_estimate(unequal) >= LIKELY).astype(np.float32)
    open_, hubs = np.ones(n, np.float32), []
    while len(hubs) < HUBS:
        covered = covers @ open_
        best = int(covered.argmax())
        if not covered[best]:
            break
        hubs.append(best)
        open_[covers[best] > 0] = 0
        open_[best] = 0
    return np.repeat(np.arange(n), near.shape[1]), near.ravel(), hubs


def _crowd(sketch: np.ndarray, top: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rows to be paired, of a crowd: each with its nearest, and with the hubs of its part and of the whole.

    The hubs of the parts are a crowd themselves, until one part holds them; ``top`` gets the last ones. So pairs grow in
    proportion to the rows, and a row that many others are near to is paired with all of them.
    """
    every = places = np.arange(len(sketch))
    while len(places):
        parts, found = np.array_split(places, -(-len(places) // CROWD)), []
        for part in parts:
            one, two, own = _around(sketch[part])
            yield part[one], part[two]
            found.append(part[own])
            rows = every if len(parts) == 1 else part
            for hub in found[-1]:
                yield rows, np.full(len(rows), hub)
        places = np.concatenate(found)
        if len(parts) == 1:
            top.append(places)
            return


def _likely(rows: np.ndarray, sketch: np.ndarray, one: np.ndarray, two: np.ndarray) -> pa.RecordBatch:
    """The pairs of places whose sketches do not rule out the wanted similarity."""
    estimate = _estimate(_unequal(sketch[one], sketch[two]))
    likely = (estimate >= FLOOR) & (rows[one] != rows[two])
    one, two = rows[one[likely]], rows[two[likely]]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), pa.array(np.round(1 - estimate[likely], 6))], schema=_PAIR
    )


class _Crowds:
    """The crowds of a sorted run of rows, which come batch by batch; only the last one is held for the next batch."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.head = None

    def take(self, rows: np.ndarray, keys: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        heads = keys[:, : 1 + 4 * SHARED]
        new = np.flatnonzero((heads[1:] != heads[:-1]).any(axis=1)) + 1
        starts, ends = np.append(0, new), np.append(new, len(rows))
        if self.head is None or (heads[0] != self.head).any():
            yield from self.end()
        self.head = heads[-1].copy()
        large = (ends - starts > DENSE) | (starts == 0) | (ends == len(rows))
        for at, end in zip(starts[large], ends[large]):
            if at:
                yield from self.end()
            self.held.append((rows[at:end], sketch[at:end]))
            if sum(len(r) for r, _ in self.held) >= HELD:
                yield from self.end(going_on=True)

    def end(self, going_on: bool = False) -> Iterator[pa.RecordBatch]:
        """Pair what is held; of a crowd that goes on, its hubs stay."""
        if not self.held:
            return
        rows, sketch = (np.concatenate(x) for x in zip(*self.held))
        self.held, top = [], []
        if len(rows) > DENSE:
            for one, two in _crowd(sketch, top):
                yield _likely(rows, sketch, one, two)
        if going_on and top:
            self.held.append((rows[top[0]], sketch[top[0]]))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of a run of one sorted order; the last rows of a batch are kept for the next one."""

    def pairs(rows, keys, sketch, n):
        """For the first n rows, which look ahead as far as rows reach."""
        dense = np.zeros(n, np.int64)
        known = min(n, len(rows) - DENSE)
        if known > 0:
            dense[:known] = np.maximum(_prefix(keys, np.arange(known), DENSE), 0)
        asked = np.minimum(dense + 1, DEPTH)
        close = np.arange(n)
        for ahead in range(1, DENSE):  # what a row shares with the one i rows ahead only shrinks with i
            close = close[close < len(rows) - ahead]
            if ahead == NEAR + 1:
                close = close[dense[close] < DEPTH]
            close = close[_prefix(keys, close, ahead) >= asked[close]]
            if not len(close):
                break
            yield _likely(rows, sketch, close, close + ahead)

    held, crowds = None, _Crowds()
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.column(0).to_numpy()
        keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, KEY)
        sketch = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, HASHES // 32)
        yield from crowds.take(rows, keys, sketch)
        if held:
            rows, keys, sketch = (np.concatenate(x) for x in zip(held, (rows, keys, sketch)))
        ready = max(0, len(rows) - DENSE)
        yield from pairs(rows, keys, sketch, ready)
        held = rows[ready:], keys[ready:], sketch[ready:]
    if held:
        yield from pairs(*held, len(held[0]))
    yield from crowds.end()


_LINK_DDL = "a bigint, b bigint, linked boolean"


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles = Shingles()
    for batch in small_batches(batches):
        linked = []
        for one, two in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            one, two = shingles(one), shingles(two)
            both = len(np.intersect1d(one, two, assume_unique=True))
            linked.append(SIMILARITY[1] * both >= SIMILARITY[0] * (len(one) + len(two) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])


def _confirmed(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs that hold on the full shingle sets of both texts.

    Wanted texts are picked in the files of the tasks that signed them; a text that no pair names is never moved.
    The joins are merge joins at every size, so that large and small inputs run the same plan.
    """
    ends = pairs.select(F.col("a").alias("row")).union(pairs.select("b"))
    texts = stored(rows_of_blocks(signed.select("block", "row", "text"), ends).drop("block"), "texts")
    one, two = texts.toDF("a", "text_a").hint("merge"), texts.toDF("b", "text_b").hint("merge")
    both = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    return stored(both.mapInArrow(_confirm, _LINK_DDL).filter("linked").select("a", "b"), "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``: see the module for the method.

    A document's set: its distinct five-word shingles, A-Z lower-cased, words split at ASCII white space; with
    fewer words the whole sequence. Texts without words, and null ones, have an empty set and no links. Repeated
    rows each get a row. component_id is the smallest doc_id that links reach; null doc_ids do not count in it,
    and a component of null doc_ids only has a null component_id. An empty table gives an empty result.
    """
    chosen = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    signed = stored_by_block(chosen.mapInArrow(_sign, _SIGNED_DDL), "signed")
    sets = stored(
        signed.filter("digest IS NOT NULL").groupBy("digest").agg(
            F.min("row").alias("rep"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")
        ),
        "sets",
    )
    orders = sets.select(
        "rep", F.explode(F.expr(f"transform(sequence(0, {TREES - 1}), i -> substring(keys, i * {KEY} + 1, {KEY}))")).alias("key"), "sketch"
    )
    sorted_orders = orders.repartitionByRange("key", "sketch", "rep").sortWithinPartitions("key", "sketch", "rep")
    found = sorted_orders.mapInArrow(_neighbours, _PAIR_DDL)
    candidates = stored(found.groupBy("a", "b").agg(F.min("w").alias("w")), "candidates")

    forest, _ = contract(candidates)
    links = _confirmed(stored(forest, "forest"), signed)
    _, roots = contract(links.withColumn("w", F.lit(0.0)))
    roots = stored(roots, "roots")
    left, right = roots.toDF("a", "root_a"), roots.toDF("b", "root_b")
    apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    untried = candidates.join(forest.select("a", "b"), ["a", "b"], "left_anti")
    rest = stored(untried.join(left, "a", "left").join(right, "b", "left").filter(apart).select("a", "b"), "rest")
    links = links.unionByName(_confirmed(rest, signed))
    _, roots = contract(links.withColumn("w", F.lit(0.0)))
    roots = stored(roots, "roots")

    reps = stored(sets.select("digest", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
                  .select("digest", F.coalesce("root", "rep").alias("root")), "reps")
    rows = stored(signed.select("row", "doc_id", "n", "digest").join(reps, "digest", "left")
                  .select("doc_id", "n", F.coalesce("root", F.col("row")).alias("root")), "rows")
    smallest = stored(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")
    return rows.join(smallest, "root").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each near-duplicate component; all columns stay as they are."""
    kept = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")), "left_semi")
