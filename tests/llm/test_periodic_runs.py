"""Periodic runs against a version that looks at every period and place."""

from __future__ import annotations

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from emberline.llm import periodic_runs as pr
from emberline.llm import queries

SF = "/root/testdata/sf0.001"


def _brute(words):
    n, out = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i < n - p:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i < n - p and words[i] == words[i + p]:
                i += 1
            if i + p - start >= max(24, 3 * p):
                out[start, i + p - start] = min(p, out.get((start, i + p - start), p))
    return sorted((s, n, q) for (s, n), q in out.items())


def test_cover_meets_every_distance():
    sampled = np.isin(np.arange(pr.COVER), pr.RESIDUES)
    for i in range(pr.COVER):
        for d in range(pr.COVER):
            assert sampled[(i + pr.SYNC[i, d]) % pr.COVER] and sampled[(i + d + pr.SYNC[i, d]) % pr.COVER]


@pytest.mark.parametrize("seed", range(8))
def test_runs(seed):
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(12):
        n = int(rng.integers(0, 500))
        words = rng.integers(0, [1, 2, 3, 50, 1000][rng.integers(5)], n)
        for _ in range(int(rng.integers(0, 4)) if n else 0):
            a = int(rng.integers(0, n))
            p, end = 1 + int(rng.integers(0, max(1, (n - a) // 3))), int(rng.integers(a, n + 1))
            for i in range(a + p, end):
                words[i] = words[i - p]
        texts.append(words.astype(np.int64))
    assert pr.find_runs(texts) == [_brute(t.tolist()) for t in texts]


@pytest.mark.parametrize("seed", range(3))
def test_extensions_are_exact(seed):
    rng = np.random.default_rng(seed)
    text = np.tile(rng.integers(0, 3, 90), 6)
    text[300] = 7
    sides = pr.Sides([text, text[:200]])
    found = pr.Extensions(sides.words)
    places = found.places
    i, j = (rng.choice(places, 400) for _ in range(2))
    i, j = i[i != j], j[i != j]
    words = sides.words
    for a, b, got in zip(i, j, found.sampled(i, j)):
        n = 0
        while max(a, b) + n < len(words) and words[a + n] == words[b + n]:
            n += 1
        assert got == n


def test_long_text_in_small_grids(monkeypatch):
    monkeypatch.setattr(pr, "GRID_POINTS", 500)
    words = np.concatenate([np.arange(1000), np.tile(np.arange(2000, 2300), 5), np.arange(3000, 5000), np.zeros(40, np.int64)])
    assert pr.find_runs([words]) == [[(1000, 1500, 300), (4500, 40, 1)]]


def _row(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = _brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_query_on_edge_rows(spark, tmp_path):
    planted = [d for d in range(400) if zlib.crc32(str(d).encode()) % 10 == 0][:12]
    rng = np.random.default_rng(1)
    texts = [" \t".join(f"w{x}" for x in rng.integers(0, 40, rng.integers(1, 300))) for _ in planted]
    rows = [*zip(planted, texts), (1, None), (2, ""), (3, " \n\x0b "), (4, "a " * 24), (4, "a " * 24), (5, "a " * 23), (None, "b\u00a0c " * 30), (6, "é\u2003x y " * 40)]
    rows += [(7, "x " * 30 + "p q r s " * 10 + "y"), (8, "A a " * 20)]
    docs = spark.createDataFrame([(d, t, 0, "z") for d, t in rows], "doc_id bigint, text string, runs int, h string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.catalogue()["op13_periodic_runs"][0](spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(_row(d, t)) for d, t in rows)
    assert pr.periodic_runs(docs.limit(0)).count() == 0


def test_query_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.catalogue()["op13_periodic_runs"][0](spark, SF).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(_row(*d)) for d in docs)
