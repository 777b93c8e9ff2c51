"""Minimum spanning forests and connected components over edge tables.

Edges are contracted in rounds: a coin per node makes hooks form stars, so a round is one grouped minimum
and two joins, without pointer chains. Once the remaining edges fit a fixed bound they are finished in one
bounded task. Edges are ordered by (w, a, b), so equal weights cannot form a cycle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.session import cut_lineage

FINISH_EDGES = 200_000


class Groups:
    """Union-find over the nodes of one bounded task."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Kruskal over the last edges: tree edges, and the root of every node still named by an edge."""
    parts = list(batches)
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True).sort_values(["w", "a", "b"])
    groups, kept = Groups(), []
    for u, v, w, a, b in rows[["u", "v", "w", "a", "b"]].itertuples(index=False):
        if groups.join(u, v):
            kept.append((a, b, w, None, None))
    nodes = list(groups.parent)
    kept += [(None, None, None, n, groups.root(n)) for n in nodes]
    out = pd.DataFrame(kept, columns=["a", "b", "w", "node", "root"])
    yield out.astype({"a": "Int64", "b": "Int64", "w": "float64", "node": "Int64", "root": "Int64"})


def contract(edges: DataFrame, finish_edges: int = FINISH_EDGES) -> tuple[DataFrame, DataFrame]:
    """(tree edges (a, b, w), components (node, root)) of an undirected (a, b, w) edge table.

    Only nodes named by an edge appear in the components.
    """
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").filter("a <> b")
    live = cut_lineage(
        ordered.groupBy("a", "b").agg(F.min("w").alias("w")).selectExpr("a AS u", "b AS v", "w", "a", "b"), "edges"
    )
    nodes: DataFrame | None = None
    trees: list[DataFrame] = []
    turn = 0
    while live.count() > finish_edges:
        turn += 1
        if nodes is None:
            ends = live.selectExpr("u AS node").union(live.selectExpr("v AS node")).distinct()
            nodes = ends.selectExpr("node", "node AS root")
        both = live.select("u", "v", "w", "a", "b").union(live.selectExpr("v", "u", "w", "a", "b"))
        lightest = both.groupBy("u").agg(F.min_by(F.struct("v", "w", "a", "b"), F.struct("w", "a", "b")).alias("e"))
        coin = lambda c: F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(2))
        hooks = cut_lineage(
            lightest.filter((coin(F.col("u")) == 0) & (coin(F.col("e.v")) == 1)).select(
                "u", F.col("e.v").alias("to"), F.col("e.w").alias("w"), F.col("e.a").alias("a"), F.col("e.b").alias("b")
            ),
            "hooks",
        )
        trees.append(hooks.select("a", "b", "w"))
        moved = hooks.select("u", "to")
        left, right = moved.toDF("u", "u_to"), moved.toDF("v", "v_to")
        renamed = (
            live.join(left, "u", "left").join(right, "v", "left")
            .selectExpr("coalesce(u_to, u) AS u", "coalesce(v_to, v) AS v", "w", "a", "b")
            .filter("u <> v")
            .selectExpr("least(u, v) AS u", "greatest(u, v) AS v", "w", "a", "b")
        )
        fewest = renamed.groupBy("u", "v").agg(F.min(F.struct("w", "a", "b")).alias("e"))
        live = cut_lineage(fewest.select("u", "v", "e.w", "e.a", "e.b"), "edges")
        nodes = cut_lineage(
            nodes.join(moved.toDF("root", "to"), "root", "left").selectExpr("node", "coalesce(to, root) AS root"), "nodes"
        )
    last = cut_lineage(
        live.coalesce(1).mapInPandas(_finish, "a bigint, b bigint, w double, node bigint, root bigint"), "finish"
    )
    tree = last.filter("a IS NOT NULL").select("a", "b", "w")
    for part in trees:
        tree = tree.unionByName(part)
    roots = last.filter("node IS NOT NULL").select("node", "root")
    if nodes is not None:
        final = roots.toDF("root", "top")
        roots = nodes.join(final, "root", "left").selectExpr("node", "coalesce(top, root) AS root")
    return tree, roots
