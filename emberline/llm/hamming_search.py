"""Exact top-k search for binary codes by incremental multi-index hashing.

A 64-bit code is cut into segments, each with an index of its own. If every segment is searched within radius r, all
codes within distance segments * (r + 1) - 1 have been met. The radius grows until k verified neighbours of a query
lie within that distance, which proves that no other row can be closer.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import stored

BITS, SEGMENTS, K = 64, 4, 10
WIDTH = BITS // SEGMENTS
#: Beyond this radius a segment's flips are a fifth of its values; one segment is then searched over all of them.
FLIPS = 5


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """Bit i is set where component i is above 0; a null vector has a null code, absent and null components count as 0."""
    terms = F.transform(
        F.slice(vector, 1, bits), lambda x, i: F.when(F.coalesce(x, F.lit(0.0)) > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))
    )
    return F.aggregate(terms, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))


def _segment(code: Column, at: int) -> Column:
    return F.shiftrightunsigned(code, at * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")


def flips(radius: int, width: int = WIDTH) -> list[int]:
    """Masks with exactly ``radius`` of ``width`` bits set."""
    return [sum(1 << b for b in c) for c in combinations(range(width), radius)]


def top_k(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k rows nearest to each query row, by (distance, vec_id).

    ``codes`` and ``queries`` have (vec_id bigint, code bigint); a query row finds itself if it is among the codes. Rows
    with a null code or vec_id take no part. Repeated rows count once each. With fewer than k rows all are returned;
    an empty side gives an empty result. The result is exact: there is no cap on candidates.
    """
    known = codes.filter("code IS NOT NULL AND vec_id IS NOT NULL").select("vec_id", "code")
    # Of rows with one code only the k smallest ids can be among the k nearest: a hot code is cut before its shuffle.
    own = Window.partitionBy("code").orderBy("vec_id")
    members = stored(known.withColumn("_n", F.row_number().over(own)).filter(F.col("_n") <= k).select("vec_id", "code"), "members")
    distinct = members.select("code").distinct()
    index = stored(
        distinct.select(F.explode(F.array(*[F.struct(F.lit(s).alias("segment"), _segment(F.col("code"), s).alias("value")) for s in range(SEGMENTS)])).alias("e"), "code")
        .select("e.segment", "e.value", "code"),
        "index",
    )
    # Queries with one code have one answer.
    asked = queries.filter("code IS NOT NULL AND vec_id IS NOT NULL").select(F.col("vec_id").alias("query_id"), F.col("code").alias("q"))
    asked = stored(asked, "asked")
    live = stored(asked.select("q").distinct(), "live")
    sizes = stored(members.groupBy("code").agg(F.count("*").alias("n")), "sizes")
    found = []
    for radius in range(FLIPS + 2):
        last = radius > FLIPS
        covered = BITS if last else SEGMENTS * (radius + 1) - 1
        segments = range(1 if last else SEGMENTS)
        values = F.sequence(F.lit(0), F.lit((1 << WIDTH) - 1)) if last else F.array(*[F.lit(m) for r in range(radius + 1) for m in flips(r)])
        probes = live.select(
            "q", F.explode(F.array(*[F.struct(F.lit(s).alias("segment"), _segment(F.col("q"), s).alias("own")) for s in segments])).alias("e")
        ).select("q", "e.segment", F.explode(F.transform(values, lambda m: F.col("e.own").bitwiseXOR(m))).alias("value"))
        distance = F.bit_count(F.col("q").bitwiseXOR(F.col("code")))
        # What lies beyond the covered distance may be incomplete; the next radius meets it again.
        # The probes are many more than their estimated size says: no broadcast.
        hits = probes.hint("merge").join(index, ["segment", "value"]).filter(distance <= covered).select("q", "code", distance.alias("distance")).distinct()
        met = stored(hits, "met")
        counts = met.join(sizes, "code").groupBy("q").agg(F.sum("n").alias("n"))
        ready = stored(live.join(counts, "q", "left").select("q", (F.coalesce("n", F.lit(0)) >= (0 if last else k)).alias("done")), "ready")
        found.append(met.join(ready.filter("done"), "q", "left_semi"))
        live = ready.filter("NOT done").select("q")
        if live.isEmpty():
            break
    near = found[0]
    for more in found[1:]:
        near = near.unionByName(more)
    best = Window.partitionBy("q").orderBy("distance", "vec_id")
    answers = near.join(members, "code").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return asked.join(answers, "q").select("query_id", "rank", "vec_id", F.col("distance").cast("int").alias("distance"))
