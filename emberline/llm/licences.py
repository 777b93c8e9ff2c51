"""Licence scans with a trained paragraph classifier.

Sparse logistic regression over word n-grams tells which licence family a paragraph names, or none. It is trained on
variations of known notices and on a bounded sample of the corpus as the unknown class, calibrated by a temperature on
examples kept from fitting, and a prediction only counts if the paragraph also resembles a notice of that family.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import small_batches

#: Usual notices of each family.
NOTICES = {
    "agpl": ["licensed under the gnu affero general public license version 3", "under the terms of the gnu affero general public license as published by the free software foundation"],
    "apache": ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted", "released under the bsd 3 clause license"],
    "cc-by": ["licensed under a creative commons attribution 4 0 international license", "licensed under cc by 4 0"],
    "cc-by-nc": ["licensed under a creative commons attribution noncommercial 4 0 international license", "licensed under cc by nc 4 0"],
    "cc-by-sa": ["licensed under a creative commons attribution sharealike 4 0 international license", "licensed under cc by sa 4 0"],
    "cc0": ["dedicated to the public domain under the cc0 1 0 universal waiver", "released under cc0 1 0"],
    "epl": ["made available under the terms of the eclipse public license 2 0"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "under the terms of the gnu general public license as published by the free software foundation"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "released under the isc license"],
    "lgpl": ["licensed under the gnu lesser general public license version 3", "under the terms of the gnu lesser general public license as published by the free software foundation"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software"],
    "mpl": ["subject to the terms of the mozilla public license v 2 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}
FAMILIES = ["unknown", *NOTICES]
#: Corpus paragraphs for the unknown class, at most this many, by a hash of the text.
FIT_DOCS = 400
VARIATIONS, STEPS, RATE, SHRINK = 60, 300, 0.3, 1e-4
WINDOW, STRIDE = 40, 20  # words of a paragraph; a longer line is read in overlapping windows
ALIKE = 0.6  # share of a notice's word pairs that a paragraph must have

_WORD = re.compile(r"[^\W_]+")


def paragraphs(text: str | None) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) of every line; lines of more than WINDOW words come in windows that overlap by half."""
    at = 0
    for line in (text or "").split("\n"):
        spans = [m.span() for m in _WORD.finditer(line)]
        for k in range(0, max(1, len(spans) - STRIDE), STRIDE) if len(spans) > WINDOW else (0,):
            part = spans[k : k + WINDOW]
            if part:
                yield at + part[0][0], at + part[-1][1], [line[s:e].lower() for s, e in part]
        at += len(line) + 1


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def _pairs(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


_NOTICE_PAIRS = {f: [_pairs(n.split()) for n in v] for f, v in NOTICES.items()}


def resembles(words: list[str], family: str) -> float:
    """Largest share of a notice's word pairs that the words contain; digits of versions do not count."""
    own = _pairs(words)
    share = lambda n: len({p for p in n if not (p[0].isdigit() or p[1].isdigit())} & own) / max(1, sum(not (p[0].isdigit() or p[1].isdigit()) for p in n))
    return max(share(n) for n in _NOTICE_PAIRS[family])


class Model:
    """Softmax regression over the n-grams of the notices; other n-grams weigh nothing."""

    def __init__(self, features: dict[str, int], weights: np.ndarray, temperature: float) -> None:
        self.features, self.weights, self.temperature = features, weights, temperature
        self.first = {f.split(" ")[0] for f in features}

    def probabilities(self, words: list[str]) -> np.ndarray:
        used = [self.features[g] for g in grams(words) if g in self.features]
        z = (self.weights[-1] + self.weights[used].sum(axis=0)) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()

    def family(self, words: list[str]) -> tuple[str, float]:
        """(family, probability); 'unknown' also where the likeliest family is unlikely or no notice of it is alike."""
        if sum(w in self.first for w in words) < 3:
            return "unknown", 1.0
        p = self.probabilities(words)
        best = int(p.argmax())
        if best == 0 or p[best] < 0.5 or resembles(words, FAMILIES[best]) < ALIKE:
            return "unknown", float(p[0])
        return FAMILIES[best], float(p[best])


def _examples(unknown: list[list[str]], rng: random.Random) -> list[tuple[list[str], int]]:
    """Notices with words dropped or corpus words around them, corpus paragraphs, and loose words of notices as unknown."""
    fill = [w for p in unknown for w in p] or ["text"]
    out = [(p, 0) for p in unknown]
    every = [w for v in NOTICES.values() for n in v for w in n.split()]
    for label, family in enumerate(NOTICES, 1):
        for notice in NOTICES[family]:
            for _ in range(VARIATIONS):
                words = [w if not w.isdigit() else rng.choice([w, str(rng.randint(0, 9))]) for w in notice.split()]
                words = [w for w in words if rng.random() > 0.05]
                before, after = (rng.choices(fill, k=rng.choice([0, 0, 3, 15])) for _ in range(2))
                out.append((before + words + after, label))
    for _ in range(VARIATIONS * len(NOTICES)):
        out.append((rng.choices(fill, k=rng.randint(0, 20)) + rng.sample(every, rng.randint(1, 6)), 0))
    return out


def fit(unknown: list[list[str]], seed: int = 5) -> Model:
    rng = random.Random(seed)
    unknown = [p for p in unknown if max(resembles(p, f) for f in NOTICES) < ALIKE / 2]
    examples = _examples(unknown, rng)
    rng.shuffle(examples)
    features = {g: i for i, g in enumerate(sorted({g for v in NOTICES.values() for n in v for g in grams(n.split())}))}
    rows = [np.array([features[g] for g in grams(w) if g in features], np.int64) for w, _ in examples]
    labels = np.array([y for _, y in examples])
    x = np.zeros((len(rows), len(features) + 1), np.float32)
    for i, r in enumerate(rows):
        x[i, r] = 1
    x[:, -1] = 1
    kept = np.arange(len(rows)) % 5 == 0  # not used for the weights
    weights, sums = np.zeros((x.shape[1], len(FAMILIES)), np.float32), None
    goal = np.eye(len(FAMILIES), dtype=np.float32)[labels]
    for _ in range(STEPS):
        z = x[~kept] @ weights
        p = np.exp(z - z.max(axis=1, keepdims=True))
        grad = x[~kept].T @ (p / p.sum(axis=1, keepdims=True) - goal[~kept]) / (~kept).sum()
        sums = grad**2 if sums is None else sums + grad**2
        weights -= RATE * grad / (np.sqrt(sums) + 1e-6)
        weights = np.sign(weights) * np.maximum(np.abs(weights) - SHRINK, 0)

    def loss(t):
        z = x[kept] @ weights / t
        z -= z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(kept.sum()), labels[kept]]).mean())

    return Model(features, weights, min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss))


def train(docs: DataFrame, sample: int = FIT_DOCS) -> Model:
    """The model, with paragraphs of at most ``sample`` documents, chosen by a hash of the text, as the unknown class."""
    texts = docs.select(F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").orderBy(F.xxhash64("text"), "text").limit(sample)
    unknown = [words for r in texts.toLocalIterator() for _, _, words in list(paragraphs(r["text"]))[:20]]
    return fit(unknown)


def _scan(model: Model):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()), ("probability", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out = []
            for text in batch.column(1).to_pylist():
                found: list[dict] = []
                for start, end, words in paragraphs(text):
                    family, p = model.family(words)
                    if family == "unknown":
                        continue
                    if found and found[-1]["family"] == family and start < found[-1]["end"]:  # overlapping windows of a line
                        found[-1].update(end=end, probability=max(p, found[-1]["probability"]))
                    else:
                        found.append({"start": start, "end": end, "family": family, "probability": p})
                out.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "found"])

    return scan


def licences(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, found) for every row of ``docs``: (start, end, family, probability) of paragraphs that name a licence.

    Spans count code points, the end excluded. Null and empty texts have none; repeated rows and null doc_ids are
    kept; an empty table gives an empty result. The model's size is bounded by the notices.
    """
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(_scan(model), "doc_id bigint, found array<struct<start:bigint,end:bigint,family:string,probability:double>>")


def licence_families(docs: DataFrame) -> DataFrame:
    """(doc_id, families, n_found, found): families sorted and joined by commas."""
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"]))), ",")
    return licences(docs, train(docs)).select("doc_id", names.alias("families"), F.size("found").cast("bigint").alias("n_found"), "found")
