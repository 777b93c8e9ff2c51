from __future__ import annotations

import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from emberline.llm import mixing as M


def shared(budget, children):
    """Exact water filling: children {name: (capacity, weight)} -> shares as fractions."""
    got, live, left = {}, dict(children), Fraction(budget)
    while live:
        total = sum(w for _, w in live.values())
        full = {n for n, (c, w) in live.items() if c <= left * w / total}
        if not full:
            got |= {n: left * w / total for n, (c, w) in live.items()}
            break
        for n in full:
            got[n] = Fraction(live.pop(n)[0])
            left -= got[n]
    return got


@pytest.mark.parametrize("seed", range(4))
def test_budgets_equal_water_filling(spark, seed):
    rng = random.Random(seed)
    leaves = {(d, lang, f"src{s}"): rng.choice([0, 1, 7, 100, 5000]) for d in ("domain0", "domain1", "other") for lang in ("en", "de", None) for s in range(rng.randint(1, 4))}
    rows = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, lang string, source string, tokens long")
    total = sum(leaves.values())
    for part in (0.2, 0.9, 3.5):
        got = {(r.domain, r.lang, r.source): r.budget for r in M.leaf_budgets(rows, F.lit(int(total * part)), epochs=2).collect()}
        assert got.keys() == leaves.keys()
        assert sum(got.values()) == min(int(total * part), 2 * total)
        assert all(0 <= got[k] <= 2 * leaves[k] for k in leaves)
        weights = {"domain0": 4, "domain1": 3, "other": 1, "en": 3, "de": 2, None: 1}
        level = {(): Fraction(min(int(total * part), 2 * total))}
        for depth in range(3):
            below = {}
            for parent in {k[:depth] for k in leaves}:
                children = defaultdict(int)
                for k, v in leaves.items():
                    if k[:depth] == parent:
                        children[k[: depth + 1]] += 2 * v
                below |= shared(level[parent], {n: (c, weights.get(n[-1], 1)) for n, c in children.items()})
            level = below
        assert all(abs(got[k] - level[k]) <= 3 for k in leaves)  # whole tokens at each of three levels


def brute_prefix(rows, budgets, epochs):
    import hashlib

    leaves = defaultdict(list)
    for doc_id, n, leaf in rows:
        leaves[leaf].append((doc_id, n))
    want = defaultdict(list)
    for leaf, own in leaves.items():
        tokens = sum(n for _, n in own)
        whole, part = divmod(budgets[leaf], tokens) if tokens else (0, 0)
        place = lambda d: int(hashlib.md5(f"{M.SEED}:{whole}:{'' if d is None else d}".encode()).hexdigest()[:15], 16)
        run, over = 0, False
        for doc_id, n in sorted(own, key=lambda x: (place(x[0]), x[0] is not None, x[0] or 0)):
            run += n
            over = over or run > part
            want[doc_id].append(whole + (part > 0 and not over))
    return {k: sorted(v) for k, v in want.items()}


def test_mixture_takes_epochs_and_prefixes(spark):
    rng = random.Random(5)
    rows = [(k, "w " * rng.randint(0, 40), rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src1", "blog", None]), "x") for k in range(300)]
    rows += [(None, None, None, None, None), (3, "a b c", "en", "src0", "x"), (500, "long " * 30000, "en", "src2", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, domain string")
    for part in ("all_tokens div 3", "all_tokens * 2"):
        got = M.mixture(docs, F.expr(part), epochs=3).collect()
        assert len(got) == len(rows)
        leaf = lambda r: (r.domain, r.lang, r.source)
        budgets = {leaf(r): r.budget for r in got}
        want = brute_prefix([(r.doc_id, r.n_tokens, leaf(r)) for r in got], budgets, 3)
        have = defaultdict(list)
        for r in got:
            have[r.doc_id].append(r.copies)
        assert {k: sorted(v) for k, v in have.items()} == want
        taken = defaultdict(int)
        for r in got:
            taken[leaf(r)] += r.copies * r.n_tokens
        assert all(taken[k] <= b for k, b in budgets.items())


def test_mixed_documents(spark):
    docs = spark.createDataFrame([(k, "one two three", "en", f"src{k % 3}", 9) for k in range(30)], "doc_id long, text string, lang string, source string, copies int")
    got = M.mixed_documents(docs, F.expr("all_tokens div 2"))
    assert got.columns == docs.columns and 10 <= got.count() <= 15 and got.distinct().count() == got.count()
    twice = M.mixed_documents(docs, F.expr("all_tokens * 2"), epochs=2)
    assert twice.count() == 60
    assert M.mixed_documents(docs.limit(0), F.lit(5)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "src1")], "doc_id long, text string, lang string, source string")
    plan = M.mixture(docs, F.lit(1))._jdf.queryExecution().executedPlan().toString()
    assert not any(p in plan for p in ("Python", "Pandas", "Arrow"))
