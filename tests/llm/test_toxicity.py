from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def test_sentences_cover_the_text():
    text = "One. Two!\nThree? \n\n four"
    assert [text[s:e].strip() for s, e in T.sentences(text)] == ["One", "Two", "Three", "four"]
    assert T.sentences(None) == T.sentences("") == T.sentences(" .\n") == []


def toy(n=400):
    rng = np.random.default_rng(2)
    texts, labels = [], []
    for k in range(n):
        parts = [" ".join(f"w{x}" for x in rng.integers(0, 60, 8)) for _ in range(rng.integers(1, 9))]
        if k % 4 == 0:
            parts[rng.integers(0, len(parts))] += rng.choice([" vile", " awfully rude", " viler"])
        texts.append(". ".join(parts))
        labels.append(int(k % 4 == 0))
    return texts, np.array(labels)


def score(weights, text):
    z = [weights[-1] + sum(weights[k] for w in T.words(text[s:e]) for k in T.slots(w)) for s, e in T.sentences(text)]
    return 1 - np.prod(1 - 1 / (1 + np.exp(-np.array(z))))


def test_sentence_weights_from_document_labels(spark):
    texts, labels = toy()
    weights = T.fit(texts[:300], labels[:300])
    rows = [(k, t, 0.5) for k, t in enumerate(texts)] + [(None, texts[0], 0.5), (7, "", None), (7, None, None), (8, " \n", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = T.toxicity(docs, weights).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got[:400]}
    right = sum((by_id[k].score >= 0.5) == labels[k] for k in range(300, 400))
    assert right >= 95
    for k in range(0, 400, 4):
        assert by_id[k].score == pytest.approx(score(weights, texts[k]))
        for s in by_id[k].sentences:
            assert any(w in texts[k][s.start : s.end] for w in ("vile", "rude"))
    assert [r.score for r in got[401:]] == [0.0, 0.0, 0.0]
    assert T.toxicity(docs.limit(0), weights).count() == 0


def test_held_out_rows_are_not_used(spark):
    ids = spark.range(200).withColumn("h", T.held_out(F.col("id")))
    assert {r.id for r in ids.filter("h").collect()} == {k for k in range(200) if zlib.crc32(str(k).encode()) % 5 == 0}
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(50)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, None) for k in range(50)], "doc_id long, toxic int")
    assert {r.score < 0.5 for r in T.toxicity_scores(docs, labels).collect()} == {True}  # nothing to learn from


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables absent")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.01', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    rows = T.toxicity_scores(docs, labels).join(labels.select("doc_id", "toxic").filter("toxic IS NOT NULL"), "doc_id").filter("held_out").collect()
    wrong = sum(r.predicted != r.toxic for r in rows)
    assert wrong <= 0.02 * len(rows)
    found = [r.predicted for r in rows if r.toxic == 1]
    assert sum(found) >= 0.85 * len(found)


def test_drop_toxic_keeps_columns(spark):
    texts, labels = toy(200)
    docs = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)] + [(None, "fine words", "s")], "doc_id long, text string, score string")
    marks = spark.createDataFrame([(k, int(y)) for k, y in enumerate(labels)], "doc_id long, toxic int")
    kept = T.drop_toxic(docs, marks)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert None in ids and len(ids & {k for k in range(200) if labels[k] == 0}) >= 145
