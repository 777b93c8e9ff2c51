"""Array-of-number column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_ZERO = lambda: F.lit(0.0)


def array_sum(c: Column) -> Column:
    return F.aggregate(c, _ZERO(), lambda acc, x: acc + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), _ZERO(), lambda acc, x: acc + x
    )


def norm(c: Column) -> Column:
    return F.sqrt(F.aggregate(c, _ZERO(), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalise(c: Column) -> Column:
    """Unit vector; a zero vector stays as it is.

    The norm rides along as a one-element array, so it is computed once per row and not per element.
    """
    scale = F.array(norm(c))
    return F.flatten(
        F.transform(
            scale,
            lambda n: F.transform(c, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(F.lit(1.0))),
        )
    )


def cosine_similarity(a: Column, b: Column) -> Column:
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def softmax(c: Column) -> Column:
    peak = F.array_max(c).cast("double")
    exps = F.transform(c, lambda x: F.exp(x.cast("double") - peak))
    return F.flatten(
        F.transform(
            F.array(exps), lambda e: F.transform(F.array(array_sum(e)), lambda s: F.transform(e, lambda x: x / s))[0]
        )
    )


def masked_mean(tokens: Column, mask: Column, dims: int) -> Column:
    """Mean of the token vectors whose mask is set; the mask sum is clamped at 1e-9."""
    weight = F.greatest(array_sum(mask), F.lit(1e-9))
    zeros = F.array_repeat(_ZERO(), dims)
    kept = F.zip_with(tokens, mask, lambda t, m: F.struct(t.alias("t"), m.cast("double").alias("m")))
    total = F.aggregate(
        kept, zeros, lambda acc, tm: F.zip_with(acc, tm["t"], lambda s, x: s + x.cast("double") * tm["m"])
    )
    return F.transform(total, lambda x: x / weight)


def first_token(tokens: Column) -> Column:
    return F.transform(F.element_at(tokens, 1), lambda x: x.cast("double"))


def label_of(index: Column, labels: Sequence[str] | None = None) -> Column:
    """Label by class id; ids without a given label read ``LABEL_<id>``."""
    default = F.concat(F.lit("LABEL_"), index.cast("string"))
    if not labels:
        return default
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in labels]), index), default)


def top_labels(scores: Column, k: int, labels: Sequence[str] | None = None) -> Column:
    """The k best (label, score) pairs, best first, lower class id first on ties."""
    if not 1 <= k <= 55:
        raise ValueError(f"top_k must be within 1..55, got {k}")
    ranked = F.array_sort(
        F.transform(scores, lambda s, i: F.struct((-s.cast("double")).alias("neg"), i.alias("id")))
    )
    return F.transform(
        F.slice(ranked, 1, k),
        lambda r: F.struct(label_of(r["id"], labels).alias("label"), (-r["neg"]).alias("score")),
    )
