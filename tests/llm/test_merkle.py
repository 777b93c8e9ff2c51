"""Merkle manifest against a plain recursive version, and against its SQL."""

from __future__ import annotations

import hashlib

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from emberline.llm import merkle, queries

SF = "/root/testdata/sf0.001"


def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _grow(nodes, fan):
    """(root, for each node its siblings on the way up as (before, after))."""
    ways, row, under = [[] for _ in nodes], list(nodes), [[k] for k in range(len(nodes))]
    while len(row) > 1:
        up, members = [], []
        for k in range(0, len(row), fan):
            run = row[k : k + fan]
            for j in range(len(run)):
                for leaf in under[k + j]:
                    ways[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(_h(*run))
            members.append(sum(under[k : k + fan], []))
        row, under = up, members
    return row[0], ways


def _plain(leaves, fan):
    trees = {}
    for row in leaves:
        trees.setdefault(row[0], []).append(row)
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    grown = {}
    for t in names:
        rows = sorted(trees[t], key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        grown[t] = rows, *_grow([r[2] for r in rows], fan)
    root, tops = _grow([grown[t][1] for t in names], fan)
    out = []
    for t, top in zip(names, tops):
        rows, sub, ways = grown[t]
        out += [(r[0], r[1], r[2], sub, root, tuple(way + top)) for r, way in zip(rows, ways)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("fan, band", [(2, 2), (3, 2), (2, merkle.BAND)])
def test_manifest(spark, fan, band):
    sizes = {"en": 70, "": 1, None: 9, "de": 8, "é": 17, "z": 2, "fr": 3}
    leaves = [(t, k // 2 if k % 5 else None, _h(str(t), str(k // 2))) for t, n in sizes.items() for k in range(n)]
    table = spark.createDataFrame([(*r, "x", 1) for r in leaves], "lang string, doc_id bigint, leaf string, path string, n int")
    found = merkle.manifest(table, "lang", ["doc_id"], "leaf", fan, band)
    folded = found.withColumn("up", merkle.fold(F.col("row.leaf"), F.col("path"))).collect()
    assert all(r["up"] == r["root"] for r in folded)
    got = sorted(((r["row"]["lang"], r["row"]["doc_id"], r["row"]["leaf"], r["subroot"], r["root"], tuple((s["before"], s["after"]) for s in r["path"])) for r in folded), key=repr)
    assert got == _plain(leaves, fan)


@pytest.mark.parametrize("rows", [[], [("en", 1)], [(None, None)], [("en", 4), ("en", 4)]])
def test_few_leaves(spark, rows):
    leaves = [(t, d, _h(str(d))) for t, d in rows]
    table = spark.createDataFrame(leaves, "lang string, doc_id bigint, leaf string")
    got = [(r["row"]["leaf"], r["subroot"], r["root"]) for r in merkle.manifest(table, "lang", ["doc_id"], "leaf").collect()]
    assert sorted(got) == sorted((r[2], r[3], r[4]) for r in (_plain(leaves, 2) if leaves else []))


def test_fields(spark):
    row = spark.createDataFrame([(None, "", "é", 12)], "a string, b string, c string, d int")
    assert row.select(merkle.fields_digest(*(F.col(c) for c in "abcd"))).first()[0] == _h("-", "0:", "2:é", "2:12")


def test_query(spark):
    query, sql = queries.catalogue()["op12_merkle_manifest"]
    got = query(spark, SF)
    assert differences(got, connect(SF), sql) == []
