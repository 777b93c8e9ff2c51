"""Exact duplicates by deterministic block naming.

A text is cut into fixed-size byte blocks. Equal blocks get one integer name by sorting the blocks themselves,
then adjacent names are paired and the pairs are named again until one name is left: equal (level, name) means
equal text, without trusting any hash. A map task first names its own blocks, so a block that a third of all
documents share reaches the sort once per task, not once per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import byte_texts, row_numbers, small_batches, stored

BLOCK_BYTES = 4096
MEMO_BYTES = 64 << 20
_ALONE = -1  # partner of an odd last block; no block or pair has this name

_CUT = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("sha", pa.string()), ("first", pa.int64()), ("blocks", pa.list_(pa.int64())),
    ("block_id", pa.int64()), ("block", pa.binary()),
])
_CUT_DDL = "row bigint, doc_id bigint, sha string, first bigint, blocks array<bigint>, block_id bigint, block binary"


def _cutter(block_bytes: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per document with its task-local block numbers, and one row per block new to this task."""
        rows, places, ids, known, known_bytes = 0, 0, 0, {}, 0
        for batch in small_batches(batches):
            n = batch.num_rows
            shas, firsts, lists, new_ids, new_blocks = [], [], [], [], []
            for text in byte_texts(batch.column(1)):
                text = (text or b"").lower()  # bytes.lower() changes A-Z only
                shas.append(hashlib.sha256(text).hexdigest())
                own = []
                for at in range(0, max(len(text), 1), block_bytes):
                    block = text[at : at + block_bytes]
                    name = known.get(block)
                    if name is None:
                        if known_bytes > MEMO_BYTES:  # a forgotten block only gets a second number
                            known, known_bytes = {}, 0
                        known[block] = name = ids
                        known_bytes += len(block) + 100
                        ids += 1
                        new_ids.append(name)
                        new_blocks.append(block)
                    own.append(name)
                firsts.append(places)
                places += len(own)
                lists.append(own)
            base = int(row_numbers(0, 1)[0])
            doc = [row_numbers(rows, n), batch.column(0), pa.array(shas, pa.string()), np.array(firsts, np.int64) + base]
            own = pa.array([[base + x for x in v] for v in lists], pa.list_(pa.int64()))
            none = lambda kind, k: pa.nulls(k, kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[0]), doc[1].cast(pa.int64()), doc[2], pa.array(doc[3]), own, none(pa.int64(), n), none(pa.binary(), n)],
                schema=_CUT,
            )
            if new_ids:
                k = len(new_ids)
                yield pa.RecordBatch.from_arrays(
                    [*[none(f.type, k) for f in _CUT][:5], pa.array(np.array(new_ids, np.int64) + base), pa.array(new_blocks, pa.binary())],
                    schema=_CUT,
                )
            rows += n

    return cut


def name_texts(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, doc_id, sha, level, name): equal (level, name) if and only if the texts are equal but for the case of A-Z.

    ``docs`` needs doc_id and text; other columns are ignored. A null text counts as empty. Every row, repeated
    ones too, keeps a row of its own; ``row`` tells them apart.
    """
    cut = stored(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_cutter(block_bytes), _CUT_DDL), "cut")
    first = Window.partitionBy("block").orderBy("block_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = cut.filter("block IS NOT NULL").select("block_id", F.first("block_id").over(first).alias("name"))
    parts = (
        cut.filter("row IS NOT NULL").select("row", "first", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block_id"))
        .join(names, "block_id").select("row", "n", "pos", (F.col("first") + F.col("pos")).alias("place"), "name")
    )
    level, done, parts = 0, [], stored(parts, "level")
    while True:
        done.append(parts.filter("n = 1").select("row", F.lit(level).alias("level"), "name"))
        live = parts.filter("n > 1")
        if live.isEmpty():
            break
        level += 1
        even = F.col("pos") % 2 == 0
        pairs = stored(
            live.groupBy("row", "n", F.expr("pos div 2").alias("pos")).agg(
                F.max(F.when(even, F.col("place"))).alias("place"), F.max(F.when(even, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(_ALONE)).alias("b"),
            ),
            "pairs",
        )
        # Stored, so that the join below shuffles both sides itself and a hot pair can be split at run time.
        named = stored(pairs.groupBy("a", "b").agg(F.min("place").alias("name")), "names")
        parts = stored(
            pairs.join(named, ["a", "b"]).select("row", F.expr("cast((n + 1) div 2 AS int)").alias("n"), "pos", "place", "name"), "level"
        )
    ids = done[0]
    for more in done[1:]:
        ids = ids.unionByName(more)
    return cut.filter("row IS NOT NULL").select("row", "doc_id", "sha").join(ids, "row")


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    The row with the largest doc_id of a group of equal texts stays. Nulls: a null text equals the empty text; a
    null doc_id is smaller than any other, and its group's keep_id is null only if all its doc_ids are. Of rows
    repeated with the same doc_id exactly one stays. An empty table gives an empty result.
    """
    ids = stored(name_texts(docs, block_bytes), "ids")
    # The row number only settles repeated rows; -row makes the first of them win.
    best = F.max(F.struct("doc_id", (-F.col("row")).alias("tie")))
    groups = stored(ids.groupBy("level", "name").agg(best.alias("best"), F.count("*").alias("group_size")), "groups")
    return ids.join(groups, ["level", "name"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (-F.col("row") == F.col("best.tie")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``exact_duplicates`` drops; all columns stay as they are."""
    kept = exact_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    low = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keyed = docs.withColumn("_sha_own", F.sha2(F.encode(low, "UTF-8"), 256))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")) & (F.col("_sha_own") == F.col("_sha"))
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_sha_own"]).drop("_sha_own")
