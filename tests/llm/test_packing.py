from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from emberline.llm.packing import OpenBins, best_fit_plan, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def bins_one_by_one(lengths, capacity):
    """Best fit decreasing, piece by piece; the remaining capacities of all bins."""
    open_bins = []
    for length in sorted(lengths, reverse=True):
        at = bisect_left(open_bins, length)
        remaining = open_bins.pop(at) if at < len(open_bins) else capacity
        insort(open_bins, remaining - length)
    return open_bins


@pytest.mark.parametrize("seed", range(30))
def test_plan_equals_best_fit_piece_by_piece(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 64, 100])
    counts = Counter(rng.randint(1, capacity) if rng.random() < 0.7 else rng.choice([1, capacity // 2 + 1, capacity]) for _ in range(rng.randint(0, 400)))
    used, taken = {}, Counter()
    for length, rank, pieces, start, base, each in best_fit_plan(dict(counts), capacity):
        assert rank == taken[length]
        taken[length] += pieces
        for k in range(pieces):
            used.setdefault(start + k // each, []).append((base + k % each * length, length))
    assert taken == counts
    for places in used.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    rest = sorted(capacity - sum(n for _, n in places) for places in used.values())
    assert rest == bins_one_by_one(list(counts.elements()), capacity)


def test_tightest_open_bin():
    bins = OpenBins(100)
    for r in (3, 17, 100):
        bins.mark(r, True)
    bins.mark(17, False)
    assert [bins.tightest(n) for n in (1, 3, 4, 17, 100)] == [3, 3, 100, 100, 100]
    bins.mark(100, False)
    assert bins.tightest(4) is None


def check(spark, rows, sequence=16):
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, part string")
    got = pack(docs, PATH, sequence).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), sequence)):
            part = ids[at : at + sequence]
            want[doc_id, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= sequence
    assert len(places) == len(bins_one_by_one([k[3] for k in want.elements()], sequence))


def test_pack_odd_rows(spark):
    rng = random.Random(4)
    words = ["and", "Thentor", "ÉÈ", "éa", "<|endoftext|>", " x", "it's", "12 3", "中文", "a\tb", "\r\n", "İI", "\U0001f600", "x<|startoftext|>y"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 60))), "x", None) for k in range(60)]
    rows += [(None, None, None, "p"), (7, "", "", ""), (7, "", "", ""), (8, "same same", None, None), (8, "same same", None, None), (9, " \n ", "", "")]
    rows += [(10, "word " * 5000, "", "")]
    check(spark, rows)


def test_pack_empty_table(spark):
    check(spark, [])
