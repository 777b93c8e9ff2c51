"""Stored tables: playbook folder, chunk index with versions, and the score cache."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_playbooks(spark: SparkSession, folder: str) -> DataFrame:
    """(source_file, content) of the Markdown files of a folder."""
    whole = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return whole.select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("content"))


INDEX = (
    "chunk_id string, source_file string, chunk_no int, playbook_name string, section string, content string, "
    "mitre_techniques string, file_hash string, vec array<double>"
)
BUCKETS = 64
KEPT_VERSIONS = 2  # versions whose buckets stay: readers of the one before the newest can finish


def bucket_of(source: str = "source_file") -> Column:
    return F.pmod(F.xxhash64(source), F.lit(BUCKETS)).cast("int")


def _manifests(root: str) -> str:
    """The folder beside the index with one row for each complete version: which version wrote each of its buckets."""
    return f"{root.rstrip('/')}-versions"


def manifest(spark: SparkSession, root: str) -> tuple[int, dict[int, int]] | None:
    """(newest version, the version that wrote each bucket), at most ``BUCKETS`` entries; null when there is none."""
    try:
        rows = spark.read.schema("version bigint, buckets map<int,bigint>").parquet(_manifests(root))
        newest = rows.orderBy(F.desc("version")).limit(1).collect()
    except AnalysisException:
        return None
    return (newest[0]["version"], dict(newest[0]["buckets"])) if newest else None


def latest_index(spark: SparkSession, root: str, only: set[int] | None = None) -> DataFrame | None:
    """Newest version of the chunk index, which may be empty, or null when none was written; ``only`` some buckets."""
    found = manifest(spark, root)
    if found is None:
        return None
    base = root.rstrip("/")
    paths = [f"{base}/version={v}/bucket={b}" for b, v in sorted(found[1].items()) if only is None or b in only]
    return spark.read.schema(INDEX).parquet(*paths) if paths else spark.createDataFrame([], INDEX)


def write_index(spark: SparkSession, root: str, rows: DataFrame, buckets: set[int] | None = None) -> int:
    """Write ``rows`` as the new content of ``buckets``, or of the whole index, and return the version's number.

    Only the files of these buckets are written; the manifest names the older versions' files for the others. Readers
    switch once the manifest is there. What a run left that did not complete its version is overwritten. One run at a
    time writes an index. Buckets that no kept manifest names are removed.
    """
    found = manifest(spark, root)
    version = 0 if found is None else found[0] + 1
    here = f"{root.rstrip('/')}/version={version}"
    columns = [c.split()[0] for c in INDEX.split(", ")]
    rows.select(*columns, bucket_of().alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(here)
    written = spark.read.schema(f"{INDEX}, bucket int").parquet(here).select("bucket").distinct().collect()  # at most BUCKETS
    old = {} if buckets is None or found is None else {b: v for b, v in found[1].items() if b not in buckets}
    named = old | {r["bucket"]: version for r in written}
    row = spark.createDataFrame([(version, named)], "version bigint, buckets map<int,bigint>")
    row.coalesce(1).write.mode("append").parquet(_manifests(root))
    _remove_unnamed(spark, root)
    return version


def _remove_unnamed(spark: SparkSession, root: str) -> None:
    """Delete the bucket folders that the newest ``KEPT_VERSIONS`` manifests do not name."""
    kept = spark.read.parquet(_manifests(root)).orderBy(F.desc("version")).limit(KEPT_VERSIONS).collect()
    named = {f"version={v}/bucket={b}" for r in kept for b, v in r["buckets"].items()}
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    newest = f"version={kept[0]['version']}"
    for version in files.listStatus(path(root)):
        name = version.getPath().getName()
        if not name.startswith("version="):
            continue
        folders = [f.getPath() for f in files.listStatus(version.getPath()) if f.isDirectory()]
        gone = [f for f in folders if f"{name}/{f.getName()}" not in named]
        if len(gone) == len(folders) and name != newest:
            files.delete(version.getPath(), True)
            continue
        for folder in gone:
            files.delete(folder, True)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(cache_key, vec) rows; an absent cache is empty. A key written twice by racing runs counts once."""
    try:
        return spark.read.parquet(path).groupBy("cache_key").agg(F.first("vec").alias("vec"))
    except AnalysisException:
        return spark.createDataFrame([], "cache_key string, vec array<double>")


def append_cache(path: str, fresh: DataFrame) -> None:
    fresh.select("cache_key", F.col("vec").cast("array<double>").alias("vec")).write.mode("append").parquet(path)
