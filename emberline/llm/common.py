"""Shared small helpers of the corpus operators: stored stages, byte texts from Arrow batches, row numbers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.session import scratch_root

SLOT_BITS = 40
BLOCK_BITS = 15  # one bitmap of Spark's holds so many rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once, zstd-compressed, to the shared folder and go on from the written table."""
    path = f"{scratch_root(df.sparkSession)}/emberline-llm-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by_block(df: DataFrame, tag: str) -> DataFrame:
    """Like ``stored``, bucketed by ``block``, the number of a run of rows that one task numbered: without a shuffle.

    ``rows_of_blocks`` then picks rows where they lie.
    """
    spark = df.sparkSession
    name = f"emberline_llm_{tag}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, "block").option("compression", "zstd").option("path", f"{scratch_root(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def rows_of_blocks(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of a ``stored_by_block`` table whose ``row`` is in ``wanted``; repeated wanted rows count once.

    Only a bitmap of 4 KB a block is moved, however many rows are wanted of it.
    """
    slot = F.col("row").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
    bitmaps = wanted.groupBy(F.shiftright("row", BLOCK_BITS).alias("block")).agg(F.bitmap_construct_agg(slot).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(slot, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    chosen = F.getbit(byte, slot.bitwiseAND(F.lit(7)).cast("int")) == 1
    return table.join(bitmaps.hint("shuffle_hash"), "block").filter(chosen).drop("bits")


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def row_numbers(start: int, n: int) -> np.ndarray:
    """Numbers for ``n`` rows of this task, from ``start``; unique over all tasks of one written table."""
    return (TaskContext.get().partitionId() << SLOT_BITS) + start + np.arange(n, dtype=np.int64)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that what is derived from a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
