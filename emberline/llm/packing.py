"""Best-fit-decreasing packing of token pieces into sequences.

Best fit only looks at lengths, and there are no more of them than a sequence has tokens. The plan is therefore made
on the counts of each length: pieces of one length, and open bins of one remaining capacity, move together. A segment
tree over the remaining capacities finds the tightest open bin in logarithmic time. The plan, whose size depends on the
sequence length alone, says for each run of ranks within a length which sequences and offsets they get.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from emberline.llm.common import row_numbers, small_batches, stored

SEQUENCE = 4096
END_ID = 1
MEMO_WORDS = 1 << 20


class OpenBins:
    """Segment tree over remaining capacities: which of them have open bins, and the tightest that fits."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)

    def mark(self, remaining: int, is_open: bool) -> None:
        at = remaining + self.size
        self.open[at] = is_open
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        """Smallest open remaining capacity of at least ``length``."""
        at = length + self.size
        if self.open[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, pieces, first sequence, offset, pieces per sequence) of best-fit decreasing over all pieces.

    Pieces of a length are taken in rank order. A bin that is the tightest for one stays the tightest until the next
    doesn't fit, so it takes as many as fit in a row.
    """
    tree, bins, plan, made = OpenBins(capacity), {}, [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, each = capacity, capacity // length
                start, n = made, -(-left // each)
                made += n
            else:
                start, n = bins[remaining].pop()
                each = remaining // length
            used = min(n, -(-left // each))
            pieces = min(left, used * each)
            plan.append((length, rank, pieces, start, capacity - remaining, each))
            rank, left = rank + pieces, left - pieces
            full = used if pieces == used * each else used - 1
            changed = [(remaining, start + used, n - used), (remaining - each * length, start, full)]
            if full < used:
                changed.append((remaining - (pieces - full * each) * length, start + full, 1))
            for r, at, k in changed:
                if k and r:
                    bins.setdefault(r, []).append((at, k))
            for r in {remaining, *(r for r, _, _ in changed)}:
                tree.mark(r, bool(bins.get(r)))
    return plan


class WordIds:
    """Token ids of a text, by encoding each distinct run between spaces and line feeds once.

    Holds for tokenizers of the CLIP kind, and only for those: they drop white space, lower-case A-Z, split letters
    from other signs, and end each word in a token of its own kind. Texts that could hold a special token's string
    are encoded whole.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        #: For ASCII letters, which normalising and splitting leave as they are.
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer, self.letters.pre_tokenizer = None, WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.memo: dict[str, bytes] = {}
        self.signs = {c: self._ids(self.tokenizer, [c])[0] for c in ".,"}

    @staticmethod
    def _ids(tokenizer: Tokenizer, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, tokenizer: Tokenizer, words: list[str]) -> list[bytes]:
        """Ids of runs of letters, encoded in one go and parted at word ends."""
        ids = np.array(tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):  # a letter that falls apart when it is normalised
            return self._ids(self.tokenizer, words)
        data, cuts = ids.tobytes(), [0, *(4 * cuts).tolist()]
        return [data[s:e] for s, e in zip(cuts, cuts[1:])]

    def _learn(self, runs: list[str]) -> None:
        plain, other, rest = {}, {}, []
        for run in runs:
            core = run[:-1] if run[-1:] in self.signs else run
            if core.isalpha():
                (plain if core.isascii() else other)[core] = b""
            else:
                rest.append(run)
        for tokenizer, words in ((self.letters, plain), (self.tokenizer, other)):
            if words:
                words.update(zip(list(words), self._words(tokenizer, list(words))))
        memo = self.memo
        for run in runs:
            core = run[:-1] if run[-1:] in self.signs else run
            known = plain.get(core) or other.get(core)
            if known:
                memo[run] = known if core is run else known + self.signs[run[-1]]
        memo.update(zip(rest, self._ids(self.tokenizer, rest)))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit numbers, with the end id last."""
        runs = [[] if t is None or "<|" in t else t.encode().lower().decode().replace("\n", " ").split(" ") for t in texts]
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo = self.memo
        new = set().union(*runs).difference(memo)
        if new:
            self._learn(list(new))
        end = np.array([END_ID], "<u4").tobytes()
        whole = {k: t for k, t in enumerate(texts) if t is not None and "<|" in t}
        own = dict(zip(whole, self._ids(self.tokenizer, list(whole.values()))))
        return [own.get(k) + end if k in own else b"".join([memo[w] for w in r]) + end for k, r in enumerate(runs)]


#: One per tokenizer in each Python worker, kept from task to task.
_known: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _known:
        _known[path] = WordIds(path)
    return _known[path]


_PIECES_DDL = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, slot bigint"


def _piecer(path: str, sequence: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of every document; slot counts the pieces of the same length in this task."""
        ids, seen = word_ids(path), {}
        part = int(row_numbers(0, 1)[0] >> 40)
        for batch in small_batches(batches, 256):
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "part", "slot")}
            for doc_id, own in zip(batch.column(0).to_pylist(), ids(batch.column(1).to_pylist())):
                for piece, at in enumerate(range(0, len(own), 4 * sequence)):
                    chunk = own[at : at + 4 * sequence]
                    length = len(chunk) // 4
                    seen[length] = seen.get(length, -1) + 1
                    for k, v in zip(out, (doc_id, piece, at // 4, length, zlib.crc32(chunk), part, seen[length])):
                        out[k].append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    return cut


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, slot), stored: every document's ids cut at ``sequence`` tokens."""
    chosen = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return stored(chosen.mapInArrow(_piecer(tokenizer, sequence), _PIECES_DDL), "pieces")


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece of every row of ``docs``.

    ``tokenizer`` is a file of the tokenizers library that every worker can open. A null or empty text is one piece
    that holds the end id only. Repeated rows and null doc_ids are packed like any other row; an empty table gives an
    empty result. Offsets of a sequence follow each other without gaps from 0.
    """
    cut = pieces(docs, tokenizer, sequence)
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(counts.select("length", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "lengths")
    # At most ``sequence`` rows, whatever the input.
    lengths = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = docs.sparkSession.createDataFrame(
        best_fit_plan(lengths, sequence) or [(0, 0, 0, 0, 0, 1)], "_length bigint, rank bigint, pieces bigint, sequence bigint, base bigint, each bigint"
    )
    ranked = cut.join(parts.select("length", "part", "before").hint("merge"), ["length", "part"]).withColumn("_r", F.col("before") + F.col("slot"))
    # The plan's size is bounded by the sequence length: it is broadcast at any size of the input.
    within = (F.col("length") == F.col("_length")) & (F.col("_r") >= F.col("rank")) & (F.col("_r") < F.col("rank") + F.col("pieces"))
    step = F.col("_r") - F.col("rank")
    return ranked.join(F.broadcast(plan), within).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.expr("(_r - rank) div each")).alias("sequence_id"),
        (F.col("base") + (step % F.col("each")) * F.col("length")).alias("offset"),
    )
