"""Passage dedup on planted repeats, near repeats and edge rows."""

from __future__ import annotations

import numpy as np
import pytest

from emberline.llm import passages


def _words(seed: int, n: int) -> list[str]:
    return [f"w{x}" for x in np.random.default_rng(seed).integers(0, 1 << 40, n)]


@pytest.mark.parametrize("values", [2, 5, 1 << 60])
def test_minima_are_leftmost(values):
    words = np.random.default_rng(values % 97).integers(1, values, 400).astype(np.uint64)
    for n in (0, passages.PARAGRAPH - 1, passages.PARAGRAPH, 400):
        part = words[:n]
        places, found = passages.minima(part, 0)
        hashed = np.full(max(n - passages.SHINGLE + 1, 0), passages._SEEDS[0], np.uint64)
        for k in range(passages.SHINGLE):
            hashed = passages.mixed(hashed * passages._SEEDS[0] + part[k : k + len(hashed)])
        every = sorted({i + int(np.argmin(hashed[i : i + passages.WINDOW])) for i in range(len(hashed) - passages.WINDOW + 1)})
        want = [p for at, p in enumerate(every) if not (at and every[at - 1] == p - 1 and hashed[p] == hashed[p - 1])]
        assert places.tolist() == want and found.tolist() == [hashed[p] for p in want]


def test_repeats(spark):
    shared, near = _words(1, 80), _words(2, 120)
    edited = near[:60] + ["other"] + near[61:]
    rows = [
        (7, " ".join(_words(3, 30) + shared + _words(4, 30))),
        (3, " ".join(shared).upper()),
        (9, "\t".join(_words(5, 200) + shared)),
        (4, " ".join(near)), (5, " ".join(edited)),
        (6, " ".join(_words(6, 300))),
        (8, " ".join(_words(7, 49))), (10, " ".join(_words(7, 49))),
        (11, None), (12, ""), (13, " \n "),
    ]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id bigint, text string, row int, label int")
    found = passages.repeated_passages(docs).collect()
    assert {r["doc_id"] for r in found} == {3, 4, 5, 7, 9}
    groups = {d: {r["component_id"] for r in found if r["doc_id"] == d} for d in (3, 4, 5, 7, 9)}
    assert groups == {3: {3}, 7: {3}, 9: {3}, 4: {4}, 5: {4}}
    assert {(r["doc_id"], r["removed"]) for r in found} == {(3, False), (4, False), (5, True), (7, True), (9, True)}
    spans = {d: (min(r["first_word"] for r in found if r["doc_id"] == d), max(r["last_word"] for r in found if r["doc_id"] == d)) for d in (3, 7, 9)}
    for doc, (start, end) in {3: (0, 80), 7: (30, 110), 9: (200, 280)}.items():
        assert spans[doc][0] <= start + 10 and spans[doc][1] >= end - 10
    empty = passages.repeated_passages(docs.limit(0))
    assert empty.count() == 0


def _lowest_shingle() -> list[str]:
    """Five words whose shingle is less than almost all others in every band."""
    words = _words(50, 200_000)
    hashed = np.full(len(words) - 4, 0, np.uint64)
    values = passages.WordHashes()(" ".join(words).encode())
    for band in range(passages.BANDS):
        own = np.full(len(hashed), passages._SEEDS[band], np.uint64)
        for k in range(passages.SHINGLE):
            own = passages.mixed(own * passages._SEEDS[0] + values[k : k + len(own)])
        hashed = np.maximum(hashed, own)
    at = int(hashed.argmin())
    return words[at : at + 5]


@pytest.mark.parametrize("most", [4, 1024])
def test_repeats_among_many_entries_of_one_shingle(spark, monkeypatch, most):
    monkeypatch.setattr(passages, "PAIRED", most, raising=False)
    low, before = _lowest_shingle(), _words(51, 45)
    texts = [_words(100 + i, 60) + low + _words(200 + i, 60) for i in range(80)]
    texts += [before + low + _words(300 + i, 60) for i in range(4)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    found = passages.repeated_passages(docs).collect()
    assert {r["doc_id"] for r in found} == {80, 81, 82, 83}
    assert {(r["component_id"], r["n_docs"], r["first_word"]) for r in found} == {(80, 4, 0)}


def test_matches_and_cliques_agree_with_all_pairs():
    rng, n, span = np.random.default_rng(5), 90, passages._BEFORE + passages._AFTER
    words = np.tile(rng.integers(1, 1 << 16, span), (n, 1)).astype(np.uint16)
    for row in words:  # an equal stretch around the entry, with up to two words changed in it
        a, b = rng.integers(0, 20), rng.integers(62, span + 1)
        row[:a], row[b:] = rng.integers(1, 1 << 16, a), rng.integers(1, 1 << 16, span - b)
        gap = rng.integers(a, b)
        row[gap : gap + rng.integers(0, 3)] = rng.integers(1, 1 << 16)
        row[: rng.integers(0, 12)] = 0
    row_of = rng.integers(0, 60, n)
    first, last, linked = np.full(n, passages.PARAGRAPH), np.full(n, -passages._BEFORE), np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            fits, one, end = passages.repeated_ranges(words[i : i + 1], words[j : j + 1])
            if row_of[i] != row_of[j] and fits[0]:
                first[i], last[i], linked[i, j] = min(first[i], one[0]), max(last[i], end[0]), True
    low = passages._joined(n, *np.nonzero(linked))
    want = {i: (low[i], first[i], last[i]) for i in range(n) if last[i] > first[i]}
    x = {"h": np.zeros(n, np.uint64), "rep": np.arange(n), "lo": row_of, "hi": row_of, "pos": row_of, "words": words, "blocks": passages.blocks_of(words)}

    def told(batch):
        return [(r["rep"], r["other"], r["first"], r["last"]) for r in batch.to_pylist()]

    assert 20 < len(want) < n and {r: (o, a, b) for r, o, a, b in told(passages._matches(x))} == want
    parts, padded = [], np.concatenate([words, np.zeros((n, passages._PART_WORDS), np.uint16)], axis=1)
    for part in range(6):
        own = padded[:, part * passages._STARTS :][:, : passages._PART_WORDS]
        parts += told(passages._cliques({"rep": np.arange(n), "lo": row_of, "hi": row_of, "pos": row_of, "part": np.full(n, part), "words": own}))
    links = np.array([(r, o) for r, o, _, _ in parts]).T
    low = passages._joined(n, *links)
    got = {r: (low[r], min(p[2] for p in parts if p[0] == r), max(p[3] for p in parts if p[0] == r)) for r, *_ in parts}
    assert got == want


def test_equal_entries_of_one_row(spark):
    """A text that repeats itself has more equal entries than a row is compared with."""
    turn = _words(60, 60)
    docs = spark.createDataFrame([(1, " ".join(turn * 12)), (2, " ".join(turn * 12))], "doc_id bigint, text string")
    found = passages.repeated_passages(docs).collect()
    assert {r["component_id"] for r in found} == {1}
    for doc in (1, 2):
        spans = sorted((r["first_word"], r["last_word"]) for r in found if r["doc_id"] == doc)
        assert spans[0][0] <= 10 and spans[-1][1] >= 710 and all(b[0] <= a[1] for a, b in zip(spans, spans[1:]))
