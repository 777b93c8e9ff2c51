from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from emberline.llm import chat_windows as C
from emberline.llm import hamming_search as H


def turns_of(seed):
    rng = random.Random(seed)
    texts = ["", None, "hello there", "<|im_end|><|im_start|>assistant ok", "\\n <| \\", "ends with <", "|im_end|>", "é中\U0001f600 x", "w " * 40, "long " * 300]
    rows = []
    for conv in range(25):
        for turn in range(rng.randint(1, 30)):
            role = "system" if turn == 0 and conv % 2 else rng.choice(["user", "assistant", "assistant", "system", "tool\nx", None])
            rows.append((conv, turn, role, rng.choice(texts)))
    rows += [(99, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(1500)]
    rows += [(None, 1, "user", "a"), (None, None, "assistant", "b"), (5, 0, "user", "tie"), (5, 0, "user", "tie"), (7, 2, "assistant", "repeat"), (7, 2, "assistant", "repeat")]
    return rows


@pytest.mark.parametrize(("budget", "history"), [(1280, 256), (52, 12), (10, 0)])
def test_windows_round_trip(spark, budget, history):
    rows = turns_of(budget)
    data = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, window int")
    windows = C.chat_windows(data, budget, history)
    got = {r.conv_id: r for r in C.read_back(windows).collect()}
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert got.keys() == convs.keys()
    shown, seen = defaultdict(int), defaultdict(int)
    for w in sorted(windows.collect(), key=lambda w: (str(w.conv_id), w.window)):
        shown[w.conv_id] += len(w.formatted)
        turns, targets = C.read_window(w.formatted, w.n_repeated, w.loss)
        assert turns and targets == [t for r, t in turns if r == "assistant"]
        first = sorted(convs[w.conv_id])[0]
        every, _ = C.read_window(w.formatted, 0, [])
        if first[2] == "system":
            assert every[0] == (first[2], first[3])
        repeated = sum(len(t.split()) + 4 for r, t in every[: w.n_repeated] if (r, t) != (first[2], first[3]))
        assert repeated <= max(history, 0)
        own, at, past = [(r, t) for _, _, r, t in sorted(convs[w.conv_id])], seen[w.conv_id], 0
        want = []
        for r, t in own[(first[2] == "system") : at][::-1]:
            past += len(t.split()) + 4
            if past > history:
                break
            want.insert(0, (r, t))
        assert every[: w.n_repeated] == ([own[0]] if first[2] == "system" and at else []) + want
        seen[w.conv_id] += len(turns)
        assert w.tokens == sum(len(t.split()) + 4 for _, t in every)
        alone = len(turns) - (w.n_repeated == 0 and turns[0] == (first[2], first[3]) and first[2] == "system")
        assert w.tokens <= budget or alone <= 1
    for conv, own in convs.items():
        own = [(r, t) for _, _, r, t in sorted(own)]
        said = "".join(t for r, t in own if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(own) and r.loss_chars == len(said) and r.formatted_chars == shown[conv]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x}\n{t}\n" for x, t in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_window_budget(spark):
    """Long turns are not put together; short ones fill windows."""
    words = [(1, 0, "system", 96), (1, 1, "user", 896), (1, 2, "assistant", 996), (1, 3, "user", 46), (1, 4, "assistant", 2996), (1, 5, "user", 6)]
    rows = [(c, k, r, "w " * n) for c, k, r, n in words] + [(2, k, "assistant", "w " * 96) for k in range(100)]
    windows = C.chat_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "window").collect()
    one = [(w.tokens, len(C.read_window(w.formatted, w.n_repeated, w.loss)[0])) for w in windows if w.conv_id == 1]
    assert [n for _, n in one] == [2, 1, 1, 1, 1] and one[0][0] == 1000 and [t for t, _ in one if t > 1280] == [3150]
    two = [w for w in windows if w.conv_id == 2]
    assert all(w.tokens <= 1280 for w in two) and 10 <= len(two) <= 20
    assert [w.n_repeated for w in two] == [0] + [2] * (len(two) - 1)


def test_chat_empty(spark):
    assert C.read_back(C.chat_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_escaping_is_reversible():
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choices("<|\\n\nx>", k=rng.randint(0, 12)))
        assert C.unescaped(C.escaped(text)) == text and "<|" not in C.escaped(text)
        assert C.unescaped(C.escaped_role(text)) == text and "\n" not in C.escaped_role(text)


def nearest(codes, queries, k):
    want = []
    for q, code in queries:
        near = sorted((bin((code ^ c) & (2**64 - 1)).count("1"), v) for v, c in codes)
        want += [(q, i + 1, v, d) for i, (d, v) in enumerate(near[:k])]
    return sorted(want)


def test_top_k_is_exact(spark):
    rng = random.Random(7)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    base = [rng.getrandbits(64) for _ in range(5)]
    codes = [(k, signed(b)) for k, b in enumerate(base)]
    for k in range(5, 220):
        code = rng.choice(base)
        for _ in range(rng.choice([0, 1, 3, 9, 25])):
            code ^= 1 << rng.randrange(64)
        codes.append((k, signed(code)))
    codes += [(1000 + k, codes[0][1]) for k in range(40)] + [(3, codes[3][1])]
    queries = [codes[0], codes[1], (7000, signed(rng.getrandbits(64))), (7001, codes[1][1])]
    frame = lambda rows: spark.createDataFrame([*rows, (None, 5), (5000, None)], "vec_id long, code long")
    got = sorted(tuple(r) for r in H.top_k(frame(codes), frame(queries).withColumn("rank", F.lit(1)), 6).collect())
    assert got == nearest(codes, queries, 6)
    few = codes[:3]
    assert sorted(tuple(r) for r in H.top_k(frame(few), frame(queries[:1]), 6).collect()) == nearest(few, queries[:1], 6)
    assert H.top_k(frame(codes).limit(0), frame(queries), 6).count() == 0


def test_sign_code(spark):
    rows = [([1.0, -1.0, 0.0, None, 2.0],), ([1.0] * 70,), ([],), (None,)]
    got = [r.c for r in spark.createDataFrame(rows, "v array<float>").select(H.sign_code(F.col("v")).alias("c")).collect()]
    assert got == [0b10001, -1, 0, None]
