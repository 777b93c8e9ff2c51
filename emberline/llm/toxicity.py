"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over its words, and over their first and last
letters, which catches inflected forms; the document's score is their noisy-or, 1 - prod(1 - p). Only document
labels are known; the weights are fitted by gradient descent on the noisy-or likelihood, so the sentences that
explain a label are found on the way.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import small_batches

SLOTS = 1 << 18
#: Labelled documents used for fitting, at most this many, chosen by a hash of the text, so that labels keep their shares.
FIT_DOCS = 6000
STEPS, RATE, SHRINK, STEADY = 150, 0.1, 0.08, 0.05
LEAK = 0.02  # noisy-or leak: a toxic label that no sentence explains; used in fitting only
LEAST_USES = 4  # pairs of a word with the feature and a fitting document; a rarer feature only learns documents by heart
BIAS = -7.0  # of a sentence without known words; noisy-or needs a low one, as long documents have many sentences
MEMO_WORDS = 1 << 18

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W_]+")


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) in code points of the runs between sentence ends and line feeds; blank runs are left out."""
    return [m.span() for m in _SENTENCE.finditer(text or "") if not m[0].isspace()]


def words(sentence: str) -> set[str]:
    return set(_WORD.findall(sentence.lower()))


def slots(word: str) -> set[int]:
    """Hashed features of a word: itself, its heads of 3 to 8 letters and its tails of 3 to 5."""
    parts = [f"={word}", *(f"<{word[:k]}" for k in range(3, 9) if k <= len(word)), *(f">{word[-k:]}" for k in range(3, 6) if k <= len(word))]
    return {xxhash.xxh32_intdigest(p) % SLOTS for p in parts}


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[str], labels: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Feature weights, with the bias last. The two labels weigh as they occur."""
    number: dict[str, int] = {}
    word_of, sentence_of, doc_of = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        for start, end in sentences(text):
            own = [number.setdefault(w, len(number)) for w in words(text[start:end])]
            word_of.extend(own)
            sentence_of.extend([len(doc_of)] * len(own))
            doc_of.append(d)
    weights = np.zeros(SLOTS + 1)
    weights[-1] = BIAS
    if not number:
        return weights
    word_of, sentence_of, doc_of = (np.frombuffer(x, np.int32) for x in (word_of, sentence_of, doc_of))
    owner, feature = array("i"), array("i")
    for w, k in number.items():
        own = slots(w)
        owner.extend([k] * len(own))
        feature.extend(own)
    owner, feature = np.frombuffer(owner, np.int32), np.frombuffer(feature, np.int32)
    in_docs = np.bincount(np.unique(word_of.astype(np.int64) * len(texts) + doc_of[sentence_of]) // len(texts), minlength=len(number))
    keep = np.bincount(feature, in_docs[owner], SLOTS)[feature] >= LEAST_USES
    owner, (used, feature) = owner[keep], np.unique(feature[keep], return_inverse=True)
    theta, bias, n = np.zeros(len(used)), BIAS, len(labels)
    first, second = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    leak = math.log1p(-LEAK)
    for step in range(1, steps + 1):
        value = np.bincount(owner, theta[feature], len(number))
        p = _probability(np.bincount(sentence_of, value[word_of], len(doc_of)) + bias)
        clean = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-9)), n) + leak  # log of (1 - leak) prod(1 - p)
        score = -np.expm1(clean)
        # d loss / d z of a sentence: p for a clean document, -p (1 - score) / score for a toxic one
        pull = np.where(labels > 0, -(1 - score) / score, 1.0)[doc_of] * p
        by_word = np.bincount(word_of, pull[sentence_of], len(number))
        grad = np.append(np.bincount(feature, by_word[owner], len(used)), pull.sum())
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + STEADY)
        theta = theta - move[:-1]
        theta = np.sign(theta) * np.maximum(np.abs(theta) - RATE * SHRINK, 0)  # L1, as a proximal step
        bias = min(bias - move[-1], BIAS + 1)
    weights[used], weights[-1] = theta, bias
    return weights


def _fitter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, marks = [], []
    for batch in batches:
        texts += batch.column(0).to_pylist()
        marks += batch.column(1).to_pylist()
    yield pa.RecordBatch.from_arrays([pa.array([fit(texts, np.array(marks, np.int64))], pa.list_(pa.float64()))], names=["weights"])


def train(docs: DataFrame, labels: DataFrame, use: F.Column, most: int = FIT_DOCS) -> np.ndarray:
    """Weights fitted in one task on at most ``most`` labelled documents among the rows where ``use`` holds.

    Rows with a null doc_id, text or label are not used, and repeated rows count once; a doc_id with several labels
    counts as toxic if any is.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.filter(use & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).withColumn("place", F.xxhash64("text"))
    # The choice moves numbers alone; the texts of the chosen are fetched by a broadcast of at most ``most`` rows.
    chosen = own.select("doc_id", "place").join(known, "doc_id").distinct().orderBy("place", "doc_id").limit(most)
    texts = own.join(F.broadcast(chosen), ["doc_id", "place"]).groupBy("doc_id", "place", "toxic").agg(F.first("text").alias("text"))
    fitted = texts.repartition(1).sortWithinPartitions("place", "doc_id").select("text", "toxic").mapInArrow(_fitter, "weights array<double>").collect()
    return np.array(fitted[0]["weights"]) if fitted else fit([], np.zeros(0, np.int64))


def _scorer(weights: np.ndarray):
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for batch in small_batches(batches):
            scores, worst = [], []
            for text in batch.column(1).to_pylist():
                spans, z = sentences(text), []
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                for start, end in spans:
                    total = weights[-1]
                    for w in words(text[start:end]):
                        value = memo.get(w)
                        if value is None:
                            memo[w] = value = float(sum(weights[k] for k in slots(w)))
                        total += value
                    z.append(total)
                p = _probability(np.array(z, np.float64))
                scores.append(float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-9)).sum())))
                worst.append([{"start": s, "end": e, "score": float(x)} for (s, e), x in zip(spans, p) if x >= 0.5])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(worst, kinds)], names=["doc_id", "score", "sentences"]
            )

    return score


def toxicity(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score, sentences) for every row: the noisy-or score, and the spans of sentences that score 0.5 or more.

    Spans count code points. A null, empty or blank text has no sentences and scores 0. Repeated rows and null
    doc_ids are kept; an empty table gives an empty result. The weights are one array of fixed size.
    """
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(_scorer(weights), "doc_id bigint, score double, sentences array<struct<start:bigint,end:bigint,score:double>>")


def held_out(doc_id: F.Column) -> F.Column:
    """Whether a document is kept from fitting; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, sentences) with weights fitted on the labelled rows that are not held out."""
    weights = train(docs, labels, ~held_out(F.col("doc_id")))
    scored = toxicity(docs, weights)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows of documents that score 0.5 or more; all columns stay as they are.

    The score depends on the text alone, so it is joined by doc_id; a doc_id with several texts goes if one is toxic.
    """
    rejected = toxicity_scores(docs, labels).filter("predicted = 1").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(rejected, F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")), "left_anti")
