"""Merkle manifest of a dataset by nested-interval labels.

The leaves of a tree have ranks 0 to n - 1. A node of level L covers the leaf ranks [lo, hi) of one run of
``FAN ** L`` ranks, so the ancestor of a leaf on a level is the one node of that level's bucket whose interval contains
the rank. Nodes carry the digests of their children, in order; a child's siblings are what its interval leaves of
the parent's. Levels are worked on in bands of ``BAND``: a band's nodes are hashed in groups of at most
``FAN ** BAND`` members, and its ancestors are attached to the nodes that begin the band; every leaf then takes the
path of the node of the next band that contains it. So nothing grows with a tree but the number of bands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import small_batches, stored

FAN = 2
BAND = 6


def fields_digest(*fields: Column) -> Column:
    """Digest of fields, each `-` if null, else its count of UTF-8 bytes, a colon and its text."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def ranked(leaves: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``leaves`` with ``_rank``, from 0 within its tree in ascending order, and ``_n``, the tree's leaves.

    Rows are sorted by range, so a tree that holds most rows is dealt to many tasks; only the counts of each tree in
    each task are summed up.
    """
    keys = [tree, *order]
    part = F.spark_partition_id()
    placed = stored(
        leaves.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_part", part).withColumn("_at", F.monotonically_increasing_id()), "ranked",
    )
    counts = placed.groupBy(tree, "_part").agg(F.count("*").alias("_here"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(tree)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col(tree).alias("_tree"), F.col("_part").alias("_of"), "_first",
        F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_before"), F.sum("_here").over(whole).alias("_n"),
    )
    same = (F.col("_part") == F.col("_of")) & F.col(tree).eqNullSafe(F.col("_tree"))
    return placed.join(starts.hint("merge"), same).withColumn("_rank", F.col("_at") - F.col("_first") + F.col("_before")).drop(
        "_part", "_at", "_of", "_first", "_before", "_tree"
    )


_NODES = ("tree", "n", "level", "lo", "hi", "kids", "digest")
_NODE_TYPES = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string())
_NODE_DDL = "tree string, n bigint, level int, lo bigint, hi bigint, kids array<string>, digest string"
_PATH = "array<struct<level:int,before:string,after:string>>"


def _hash_band(fan: int, band: int, base: int):
    """The inner nodes of a band above groups of consecutive nodes of level ``base``, up to the root of a smaller tree."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 64):
            found = []
            for tree, n, group, members in zip(*(c.to_pylist() for c in batch.columns)):
                row, start = [m["digest"] for m in members], group * fan ** (base + band)
                for level in range(base + 1, base + band + 1):
                    if fan ** (level - 1) >= n:
                        break
                    runs = [row[k : k + fan] for k in range(0, len(row), fan)]
                    row = [hashlib.sha256("".join(kids).encode()).hexdigest() for kids in runs]
                    for k, (kids, digest) in enumerate(zip(runs, row)):
                        lo = start + k * fan**level
                        found.append((tree, n, level, lo, min(lo + fan**level, n), kids, digest))
            columns = zip(*found) if found else [[]] * len(_NODES)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, _NODE_TYPES)], names=list(_NODES))

    return nodes


def _height(n: Column, fan: int, most: int) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves, none of which has more than ``most``."""
    levels, width = F.lit(0), 1
    while width < most:
        levels, width = levels + F.when(n > width, 1).otherwise(0), width * fan
    return levels


class Forest:
    """Trees over leaves (tree string, rank bigint, n bigint, digest string, row): no two have the same tree and rank."""

    def __init__(self, leaves: DataFrame, fan: int = FAN, band: int = BAND) -> None:
        self.leaves, self.fan, self.band = leaves, fan, band
        self.most = leaves.agg(F.max("n").alias("n")).first()["n"] or 0
        self.height = _height(F.col("n"), fan, self.most)
        self.bands: list[tuple[int, DataFrame, DataFrame]] = []
        begin, base = leaves.select("tree", "n", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", "row"), 0
        while base == 0 or fan**base < self.most:
            group = F.expr(f"lo div {fan ** (base + band)}").alias("group")
            grouped = begin.filter(F.col("n") > fan**base).groupBy("tree", "n", group).agg(
                F.sort_array(F.collect_list(F.struct("lo", "digest"))).alias("members")
            )
            nodes = stored(grouped.mapInArrow(_hash_band(fan, band, base), _NODE_DDL), "nodes")
            self.bands.append((base, begin, nodes))
            base += band
            begin = nodes.filter(F.col("level") == base).select("tree", "n", "lo", "hi", "digest", F.lit(None).cast("string").alias("row"))

    def roots(self) -> DataFrame:
        """(tree, n, digest): the root of every tree; a lone leaf is its own."""
        found = self.leaves.filter("n = 1").select("tree", "n", "digest")
        for _, _, nodes in self.bands:
            found = found.unionByName(nodes.filter(F.col("level") == self.height).select("tree", "n", "digest"))
        return found

    def paths(self, above: DataFrame) -> DataFrame:
        """(row, path, subroot, root) for every leaf; ``above`` has tree, n, path, subroot and root for every tree.

        path: for each level from below, the siblings' digests, concatenated, left and right of the way up; then the
        tree's own path of ``above``.
        """
        ends: DataFrame | None = None
        for base, begin, nodes in reversed(self.bands):
            own = self._climb(base, begin, nodes)
            far = self.fan ** (base + self.band)
            tops = above.filter((self.height > base) & (self.height <= base + self.band))
            over = tops.select("tree", F.lit(0).cast("bigint").alias("up"), F.col("path").alias("rest"), "subroot", "root")
            if ends is not None:
                over = over.unionByName(ends.select("tree", F.col("lo").alias("up"), F.col("path").alias("rest"), "subroot", "root"))
            ends = own.withColumn("up", F.expr(f"lo div {far} * {far}")).join(over.hint("merge"), ["tree", "up"]).select(
                "tree", "lo", "row", F.concat("path", "rest").alias("path"), "subroot", "root"
            )
            if base:
                ends = stored(ends, "paths")
        lone = self.leaves.filter("n = 1").select("tree", "row").join(above.select("tree", "path", "subroot", "root").hint("merge"), "tree")
        columns = ["row", "path", "subroot", "root"]
        return ends.select(*columns).unionByName(lone.select(*columns))

    def _climb(self, base: int, begin: DataFrame, nodes: DataFrame) -> DataFrame:
        """(tree, lo, row, path) of a band: nodes that begin it, with the siblings on their way through the band.

        The join is by tree, level and the level's bucket of ranks; in it, containment names the ancestor. What the
        child's interval leaves of the ancestor's are the siblings'.
        """
        width = F.pow(F.lit(float(self.fan)), "level").cast("bigint").alias("width")
        first = F.col("level") == base + 1
        wide = begin.filter(self.height > base).select(
            "tree", "lo", "hi", "row", F.explode(F.sequence(F.lit(base + 1), F.least(self.height, F.lit(base + self.band)))).alias("level")
        )
        spread = wide.select("tree", "lo", "hi", "level", width, F.when(first, F.col("row")).alias("row")).withColumn("bucket", F.expr("lo div width"))
        above = nodes.select("tree", "level", F.col("lo").alias("up_lo"), F.col("hi").alias("up_hi"), "kids", width).select(
            "tree", "level", F.expr("up_lo div width").alias("bucket"), "up_lo", "up_hi", "kids"
        )
        met = spread.join(above.hint("merge"), ["tree", "level", "bucket"]).filter("up_lo <= lo AND hi <= up_hi")
        child = F.expr(f"cast((lo - up_lo) div (width div {self.fan}) AS int)")
        step = F.struct(
            "level", F.array_join(F.slice("kids", 1, child), "").alias("before"), F.array_join(F.slice("kids", child + 2, F.lit(self.fan)), "").alias("after")
        )
        return met.select("tree", "lo", "row", step.alias("step")).groupBy("tree", "lo").agg(
            F.first("row", ignorenulls=True).alias("row"), F.sort_array(F.collect_list("step")).alias("path")
        )


def manifest(leaves: DataFrame, tree: str, order: list[str], digest: str, fan: int = FAN, band: int = BAND) -> DataFrame:
    """The columns of ``leaves`` in a struct ``row``, with path (array of level, before, after), subroot and root.

    Leaves of one value of ``tree`` (null is a value) ascend by ``order``, nulls first, and then by ``digest``, so that
    repeated rows have defined places; runs of ``fan`` nodes, the last one perhaps shorter, become one node until one is
    left, the subroot. Subroots, ascending by ``tree`` with null first, become the root in the same way. A lone leaf is
    its own subroot, a lone subroot the root. ``fold`` goes up a path. An empty table gives an empty result.
    """
    own = leaves.select(
        F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("")).alias("tree"), *(F.col(c).alias(f"_by{k}") for k, c in enumerate(order)),
        F.col(digest).alias("digest"), F.struct(*leaves.columns).alias("row"),
    )
    places = ranked(own, "tree", [*(f"_by{k}" for k in range(len(order))), "digest"])
    columns = ["tree", F.col("_rank").alias("rank"), F.col("_n").alias("n"), "digest", "row"]
    trees = Forest(stored(places.select(*columns), "leaves"), fan, band)
    subroots = stored(trees.roots().select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("n").alias("size"), "digest"), "subroots")
    tops = ranked(subroots, "tree", ["of"]).withColumn("row", F.struct("of", "size", "digest"))
    crown = Forest(stored(tops.select(*columns), "tops"), fan, band)
    none = F.array().cast(_PATH)
    over = crown.paths(crown.roots().select("tree", "n", none.alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root")))
    above = stored(over.select(F.col("row.of").alias("tree"), F.col("row.size").alias("n"), "path", F.col("row.digest").alias("subroot"), "root"), "above")
    return trees.paths(above)


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to along its path."""
    return F.aggregate(path, digest, lambda at, step: F.sha2(F.concat(step["before"], at, step["after"]), 256))


def siblings(path: Column) -> Column:
    """All siblings' digests on a path, concatenated from below, left to right within a level."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")
