"""Session helpers: lineage cuts, checked broadcasts and stable ordinals."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_local_scratch: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts, taken from ``spark.checkpoint.dir``.

    A private folder is made only for a local master with the setting unset; on a cluster a
    machine-local folder would be lost with its host, so the missing setting is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
    app = context.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="emberline-")
    return _local_scratch[app]


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="emberline-src-")) / "emberline.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def cut_lineage(df: DataFrame, tag: str = "stage", by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder, in one folder for each value of ``by``, and go on from the written table."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/emberline-{tag}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to every core: few bytes can be much work, so the partitions must not be merged by their size."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys)


def with_ordinal(df: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """Add a 0-based position in the global order without a single-task window.

    The rows are range-sorted, numbered inside their partition, and shifted by the row counts of the
    partitions before; only the per-partition counts (one row per partition) meet in one window.
    """
    local = F.monotonically_increasing_id()
    numbered = cut_lineage(df.orderBy(*order).withColumn("_mid", local), "ordinal")
    part, slot = F.shiftright("_mid", 33), F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    counts = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        numbered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn(name, slot + F.col("_offset"))
        .drop("_part", "_mid", "_offset")
    )
