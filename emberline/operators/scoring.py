"""Scoring of texts: native hash and keyword scorers, pluggable scorers, and the result cache."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import vectors as vx
from emberline.functions.text import cache_key
from emberline.schema import BATCH_TEXTS, CLASS_TOP_K
from emberline.session import cut_lineage


class Scorer(Protocol):
    """What a pluggable model offers; one instance is made per Python worker task."""

    model_id: str
    ready: bool
    supports_classification: bool
    class_labels: list[str]

    def embed(self, texts: list[str], pooling: str, normalise: bool) -> list[list[float]]: ...

    def classify(self, texts: list[str], top_k: int) -> list[list[tuple[str, float]]]: ...


ScorerFactory = Callable[[], Scorer]
EmbedTexts = Callable[[DataFrame], DataFrame]
BATCH_CHARS = 262_144  # padded characters of one call


def hash_embedding(text: Column, dims: int = 384, normalise: bool = True) -> Column:
    """Deterministic vector: the SHA-256 bytes over 255, repeated to ``dims`` values."""
    digest = F.sha2(text, 256)
    byte_of = lambda d, i: F.conv(F.substring(d, i * 2 + 1, 2), 16, 10).cast("double") / 255.0
    octets = F.transform(F.array(digest), lambda d: F.array(*[byte_of(d, i) for i in range(min(dims, 32))]))[0]
    repeats = -(-dims // 32)
    tiled = F.slice(F.flatten(F.array_repeat(octets, repeats)), 1, dims)
    if not normalise:
        return tiled
    return F.transform(F.array(tiled), vx.l2_normalise)[0]


def hash_class_scores(text: Column, n_labels: int) -> Column:
    """Score array with weight 0.9 on the class picked by the first two digest bytes, 0.1 elsewhere, summing to 1."""
    picked = F.conv(F.substring(F.sha2(text, 256), 1, 4), 16, 10).cast("bigint") % n_labels
    total = 0.9 + 0.1 * (n_labels - 1)
    return F.transform(
        F.array(picked),
        lambda p: F.transform(
            F.sequence(F.lit(0), F.lit(n_labels - 1)), lambda i: F.when(i == p, 0.9 / total).otherwise(0.1 / total)
        ),
    )[0]


def hash_classify(df: DataFrame, text: str, labels: Sequence[str], top_k: int = CLASS_TOP_K) -> DataFrame:
    """Add label, score and top_k from the deterministic hash classifier."""
    ranked = df.withColumn("top_k", vx.top_labels(hash_class_scores(F.col(text), len(labels)), top_k, labels))
    return ranked.withColumn("label", F.col("top_k")[0]["label"]).withColumn("score", F.col("top_k")[0]["score"])


KeywordRule = tuple[Sequence[str], str, float]


def keyword_class(text: Column, rules: Sequence[KeywordRule], default: tuple[str, float]) -> Column:
    """(label, score) of the first rule with a keyword in the text, compared in lower case."""
    lowered = F.lower(text)
    chosen: Column | None = None
    for keywords, label, score in rules:
        hit = lowered.contains(keywords[0].lower())
        for word in keywords[1:]:
            hit = hit | lowered.contains(word.lower())
        result = F.struct(F.lit(label).alias("label"), F.lit(float(score)).alias("score"))
        chosen = F.when(hit, result) if chosen is None else chosen.when(hit, result)
    fallback = F.struct(F.lit(default[0]).alias("label"), F.lit(float(default[1])).alias("score"))
    return fallback if chosen is None else chosen.otherwise(fallback)


WORD = re.compile(r"(?:[^\W_]|\.)+")


def lexical_embedding(text: Column, dims: int = 256) -> Column:
    """Unit vector of hashed word counts: each lower-cased word adds one to the slot its MD5 names.

    A feature-hashed bag of words keeps relevance search a fixed-width vector problem; joining on single
    words instead would pair every two texts that share a common word.
    """

    class Slots(dict):
        def __missing__(self, word: str) -> int:
            found = int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % dims
            if len(self) < 200_000:
                self[word] = found
            return found

    @F.arrow_udf("array<double>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        slot = Slots().__getitem__
        for texts in batches:
            found = [list(map(slot, WORD.findall((value or "").lower()))) for value in texts.to_pylist()]
            rows = np.repeat(np.arange(len(found)), [len(hits) for hits in found])
            slots = np.fromiter(chain.from_iterable(found), np.int64, len(rows))
            counts = np.bincount(rows * dims + slots, minlength=len(found) * dims).reshape(-1, dims)
            norms = np.sqrt(np.einsum("ij,ij->i", counts, counts))  # sums of whole numbers, so exact
            vecs = counts / np.where(norms > 0, norms, 1.0)[:, None]
            yield pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * dims, vecs.ravel())

    return embed(text)


def score_distinct(df: DataFrame, text: str, key: Column) -> DataFrame:
    """Distinct (cache_key, text) pairs, so that repeated texts are scored once."""
    return df.select(key.alias("cache_key"), F.col(text).alias("text")).groupBy("cache_key").agg(
        F.first("text").alias("text")
    )


def cache_split(keys: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): semi and anti join on ``cache_key``."""
    known = cache.select("cache_key")
    return keys.join(known, "cache_key", "left_semi"), keys.join(known, "cache_key", "left_anti")


def cache_stats(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Hits and misses counted per input row, and the hit rate (0 on empty input)."""
    marked = rows.join(cache.select("cache_key", F.lit(True).alias("hit")), "cache_key", "left")
    return marked.agg(
        F.count_if(F.col("hit")).alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses")
    ).withColumn(
        "hit_rate", F.coalesce(F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")), F.lit(0.0))
    )


def _calls(texts: list[str], most: int, chars: int) -> Iterator[list[int]]:
    """Places of the texts of each call, shortest texts first: at most ``most``, and ``chars`` as a model pads them.

    A text longer than that alone is a call by itself.
    """
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    call: list[int] = []
    for i in order:
        if call and (len(call) == most or (len(call) + 1) * len(texts[i]) > chars):
            yield call
            call = []
        call.append(i)
    if call:
        yield call


def _scored(texts: list[str], score: Callable[[list[str]], list], what: str, most: int, chars: int, tries: int) -> list:
    """Scores in the order of ``texts``; a call that fails is repeated by itself, up to ``tries`` times in all."""
    out: list = [None] * len(texts)
    for call in _calls(texts, most, chars):
        for left in range(tries - 1, -1, -1):
            try:
                found = score([texts[i] for i in call])
                break
            except Exception:
                if not left:
                    raise
        if len(found) != len(call):
            raise ValueError(f"scorer returned {len(found)} {what} for {len(call)} texts")
        for i, value in zip(call, found):
            out[i] = value
    return out


def _made(factory: ScorerFactory) -> Scorer:
    scorer = factory()
    if not scorer.ready:
        raise RuntimeError(f"scorer {scorer.model_id} is not ready")
    return scorer


def model_embed(
    texts: DataFrame, factory: ScorerFactory, pooling: str = "mean", normalise: bool = True, *,
    most: int = BATCH_TEXTS, chars: int = BATCH_CHARS, tries: int = 3,
) -> DataFrame:
    """(cache_key, vec) of (cache_key, text) rows from a pluggable scorer, in calls of bounded size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _made(factory)
        for pdf in batches:
            vecs = _scored(pdf["text"].tolist(), lambda some: scorer.embed(some, pooling, normalise), "vectors", most, chars, tries)
            yield pd.DataFrame({"cache_key": pdf["cache_key"], "vec": [list(map(float, v)) for v in vecs]})

    return texts.mapInPandas(run, "cache_key string, vec array<float>")


def model_classify(
    texts: DataFrame, factory: ScorerFactory, top_k: int = CLASS_TOP_K, *, most: int = BATCH_TEXTS, chars: int = BATCH_CHARS, tries: int = 3
) -> DataFrame:
    """(cache_key, label, score, top_k), in calls of bounded size; a scorer without a class head yields no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _made(factory)
        for pdf in batches:
            if not scorer.supports_classification or not len(pdf):
                continue
            ranked = _scored(pdf["text"].tolist(), lambda some: scorer.classify(some, top_k), "predictions", most, chars, tries)
            yield pd.DataFrame(
                {
                    "cache_key": pdf["cache_key"],
                    "label": [r[0][0] for r in ranked],
                    "score": [float(r[0][1]) for r in ranked],
                    "top_k": [[{"label": n, "score": float(s)} for n, s in r] for r in ranked],
                }
            )

    return texts.mapInPandas(
        run, "cache_key string, label string, score double, top_k array<struct<label:string,score:double>>"
    )


def model_embedder(factory: ScorerFactory, pooling: str = "mean", normalise: bool = True, **how) -> EmbedTexts:
    """A pluggable scorer as the ``embed`` step of the analysis."""
    return lambda texts: model_embed(texts, factory, pooling, normalise, **how)


def model_classifier(factory: ScorerFactory, text: str = "description", top_k: int = CLASS_TOP_K, **how) -> Callable[[DataFrame], DataFrame]:
    """A pluggable scorer as the ``classify`` step of the analysis: every different text is scored once."""
    return lambda rows: classify_rows(rows, text, lambda texts: model_classify(texts, factory, top_k, **how))


def classify_rows(rows: DataFrame, text: str, classify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with the columns that ``classify`` gives for their text by cache_key; null where it gives none."""
    keyed = rows.withColumn("cache_key", cache_key(F.col(text)))
    scored = cut_lineage(classify(score_distinct(keyed, text, F.col("cache_key"))), "classes")
    return keyed.join(scored, "cache_key", "left").drop("cache_key")


@dataclass
class NativeEmbed:
    """A (cache_key, text) -> (cache_key, vec) step; ``column`` gives the vector of a text in its own row."""

    column: Callable[[Column], Column]

    def __call__(self, texts: DataFrame) -> DataFrame:
        return texts.select("cache_key", self.column(F.col("text")).alias("vec"))


def native_embed(embedding: Callable[[Column], Column]) -> EmbedTexts:
    """Wrap an embedding column function as a (cache_key, text) -> (cache_key, vec) step."""
    return NativeEmbed(embedding)


def embed_rows(
    rows: DataFrame, text: str, embed: EmbedTexts, cache: DataFrame | None = None, *,
    pooling: str = "mean", normalise: bool = True, model_id: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Vectors for every row, the fresh (cache_key, vec) rows to append to the cache, and cache stats.

    Distinct texts are scored once and stored, as two tables read them; row identity is carried by the rows themselves, so nothing depends on order.
    """
    keyed = rows.withColumn("cache_key", cache_key(F.col(text), pooling, normalise, model_id))
    wanted = score_distinct(keyed, text, F.col("cache_key"))
    if cache is None:
        fresh = cut_lineage(embed(wanted), "fresh")
        return keyed.join(fresh, "cache_key"), fresh, None
    _, missing = cache_split(wanted, cache)
    fresh = cut_lineage(embed(missing), "fresh")
    vectors = cache.select("cache_key", "vec").unionByName(fresh)
    return keyed.join(vectors, "cache_key"), fresh, cache_stats(keyed, cache)


def batch_numbers(df: DataFrame, ordinal: str, size: int) -> DataFrame:
    """Number fixed-size batches over a 0-based ordinal column."""
    if size < 1:
        raise ValueError(f"batch size must be positive, got {size}")
    return df.withColumn("batch_no", F.floor(F.col(ordinal) / size).cast("bigint"))
