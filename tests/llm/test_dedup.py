from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from emberline.llm import minhash_forest
from emberline.llm.block_names import drop_exact_duplicates, exact_duplicates, name_texts
from emberline.llm.minhash_forest import Shingles, keep_one_of_each, near_duplicates

UPPER = bytes(range(65, 91))


def low(text):
    return bytes(b + 32 if b in UPPER else b for b in (text or "").encode())


def odd_rows():
    rng = random.Random(3)
    parts = ["aaaa", "bbbb", "aaab", "É", "é", "x"]
    rows = [(k, "".join(rng.choices(parts, k=rng.randint(0, 9)))) for k in range(150)]
    long = "".join(rng.choices(parts, k=6000))
    rows += [(200, long), (201, long), (202, long.upper()), (203, long[:-1]), (204, long + long), (None, "aaaa"), (None, None), (None, None)]
    rows += [(300, ""), (301, None), (302, "aaaaAAAA"), (303, "aaaaaaaa"), (303, "aaaaaaaa")]
    return rows


@pytest.mark.parametrize("block_bytes", [4, 7, 4096])
def test_exact_duplicates(spark, block_bytes):
    rows = odd_rows()
    docs = spark.createDataFrame([(d, t, "n", 1) for d, t in rows], "doc_id long, text string, name string, level int")
    got = exact_duplicates(docs, block_bytes).collect()
    groups = defaultdict(list)
    for d, t in rows:
        groups[low(t)].append(d)
    want = []
    for text, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        want += [(d, keep, len(ids), hashlib.sha256(text).hexdigest()) for d in ids]
    order = lambda v: sorted(v, key=repr)
    assert order((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == order(want)
    kept = [r for r in got if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept)
    assert sorted(r.text_sha256 for r in kept) == sorted(hashlib.sha256(t).hexdigest() for t in groups)


def test_names_do_not_rely_on_a_hash(spark):
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string")
    named = defaultdict(set)
    for r in name_texts(docs, 3).collect():
        named[r.level, r.name].add(r.sha)
    assert all(len(v) == 1 for v in named.values())
    assert len(named) == len({low(t) for _, t in odd_rows()})


def test_exact_duplicates_empty(spark):
    assert exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_drop_exact_duplicates_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "A", "x"), (2, "a", "y"), (2, "a", "y"), (None, None, None), (2, "b", "z")], "doc_id long, text string, sha string")
    got = drop_exact_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, [docs.collect()[i] for i in (1, 3, 4)]))


def components(rows):
    shingles = Shingles()
    sets = [frozenset(shingles((t or "").encode()).tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(rows):
        now = least[root(i)]
        least[root(i)] = d if now is None else now if d is None else min(now, d)
    return [(d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows)]


def near_rows():
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(400)]
    shared = rng.choices(vocabulary, k=60)
    rows = []
    for k in range(40):
        base = rng.choices(vocabulary, k=rng.choice([3, 5, 12, 60, 200]))
        if k % 4 == 0:
            base = base[:20] + shared + base[20:]
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    hot = rng.choices(vocabulary, k=150)
    for _ in range(60):
        copy = list(hot)
        copy[rng.randrange(150)] = "other"
        rows.append((len(rows) + 1000, " ".join(copy)))
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "One two"), (2004, "one TWO"), (2005, "one"), (None, "one two"), (None, None), (2003, "One two")]
    rows += [(2010, "long " * 30000), (2011, "LONG\t" * 20)]
    return rows


def test_near_duplicates(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, rep int")
    got = [tuple(r) for r in near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted(components(rows), key=repr)


def test_near_duplicates_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_one_of_each(spark):
    rows = [r for r in near_rows() if r[0] is not None]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, kept int")
    got = keep_one_of_each(docs)
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == {d for d, _, _, kept in components(rows) if kept}


def test_copies_of_one_text_that_are_no_copies_of_each_other(spark):
    """600 copies near to their origin and to little else: more than any window of rows that share a prefix holds."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(5000)]
    origin = rng.choices(vocabulary, k=160)
    rows = [(0, " ".join(origin))]
    for k in range(1, 601):
        copy = list(origin)
        for at in rng.sample(range(160 // 6), 4):
            copy[6 * at + rng.randrange(2)] = rng.choice(vocabulary)
        rows.append((k, " ".join(copy)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(components(rows))


def test_crowds_over_batches(monkeypatch):
    """A crowd is the same however the rows come, and its hubs outlast what a task holds of it."""
    monkeypatch.setattr(minhash_forest, "CROWD", 64)
    rng = np.random.default_rng(2)
    n = 700
    keys = np.zeros((n, minhash_forest.KEY), np.uint8)
    keys[:100, 1] = np.arange(100)
    center = rng.integers(0, 1 << 62, 4, dtype=np.uint64)
    sketch = np.tile(center, (n, 1))
    sketch[101:] ^= np.bitwise_and.reduce(rng.integers(0, 1 << 62, (4, n - 101, 4), dtype=np.uint64))

    def found(cuts):
        crowds, out = minhash_forest._Crowds(), set()
        for at, end in zip([0, *cuts], [*cuts, n]):
            for batch in crowds.take(np.arange(at, end), keys[at:end], sketch[at:end]):
                out |= set(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for batch in crowds.end():
            out |= set(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        return out

    whole = found([])
    assert whole == found([1, 60, 100, 333, 650]) == found([100])
    near = {b for a, b in whole if a == 100}
    likely = minhash_forest._estimate(minhash_forest._unequal(sketch[100], sketch[101:])) >= minhash_forest.FLOOR
    assert near == set((np.flatnonzero(likely) + 101).tolist()) and len(near) > 500
    assert all(a >= 100 for a, _ in whole)
    monkeypatch.setattr(minhash_forest, "HELD", 256)
    assert {b for a, b in found([150, 300, 450, 600]) if a == 100} == near
