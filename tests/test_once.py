"""Chunks are made once, parts of an index when they are read, and batches of vectors give what single rows gave."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from emberline.functions import vectors as vx
from emberline.operators import chunking as ck
from emberline.operators import lexical as lx
from emberline.operators import nearest as nr
from emberline.operators import scoring as sc


def _filters(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Filter " in line]


def test_chunks_are_made_once(spark):
    docs = spark.createDataFrame([("a.md", "# A\nx\n\n## B\ny"), ("b.md", " \n"), ("c.md", None), (None, "# D\nz")], "source_file string, content string")
    chunks = ck.chunk_documents(docs)
    assert not any("aggregate(" in line for line in _filters(chunks))
    found = sorted((str(r["source_file"]), r["chunk_no"], r["section"], r["content"]) for r in chunks.collect())
    assert found == [("None", 0, "D", "# D\nz"), ("a.md", 0, "A", "# A\nx"), ("a.md", 1, "B", "## B\ny")]


def test_parts_of_the_index_for_searches_only(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "id bigint, text string")
    index = lx.lexical_index(docs)
    assert index.terms.count() == 3 and not {"postings", "best"} & set(vars(index))
    assert lx.lexical_search(docs, index, 1).count() == 2 and {"postings", "best"} <= set(vars(index))


def test_embedding_by_batches(spark):
    texts = ["Alpha beta alpha", "", None, "?!", "T1059.001 beta"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").coalesce(1)
    found = {r["id"]: r["vec"] for r in df.select("id", sc.lexical_embedding(F.col("text"), 16).alias("vec")).collect()}
    for i, text in enumerate(texts):
        slots = [0.0] * 16
        for w in (text or "").lower().split():
            if w != "?!":
                slots[int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 16] += 1
        norm = math.sqrt(sum(x * x for x in slots)) or 1.0
        assert found[i] == [x / norm for x in slots]


def test_cosine_scan_lifts_vectors_itself(spark):
    rng = np.random.default_rng(5)
    vecs = [*rng.normal(size=(40, 7)).tolist(), [0.0] * 7]
    df = spark.createDataFrame(list(enumerate(vecs)), "id bigint, vec array<double>")
    native = {r["id"]: r["vec"] for r in df.select("id", vx.l2_normalise(F.col("vec")).alias("vec")).collect()}
    lifted = nr._lifted(1)(np.array(vecs))
    assert lifted[:, :7].tolist() == [native[i] for i in range(41)] and lifted[:, 7:].tolist() == [[0.0, 0.0]] * 40 + [[0.0, 1.0]]
    asked = df.filter("id < 9")
    scanned = sorted(map(tuple, nr.nearest_by_cosine(asked, df, 4).select("qid", "id", "dist", "rank").collect()))
    tree = sorted(map(tuple, nr.nearest_by_cosine(asked, df, 4, scan_limit=0).select("qid", "id", "dist", "rank").collect()))
    assert scanned == tree and len(scanned) == 36
    assert nr.nearest_by_cosine(asked, df, 0).count() == 0
