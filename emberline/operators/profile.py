"""Cluster profiles: membership, counts, modes, histograms, centroids, representatives.

No operator gathers the rows of a cluster into one value. Enum-valued summaries come from one small cube
of (cluster, event type, severity), so a cluster that holds a third of all rows is reduced map-side.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import vectors as vx
from emberline.functions.fields import outside_unit
from emberline.functions.text import max_severity, priority_of_severity
from emberline.schema import DOMINANT_CLASSES, REPRESENTATIVES
from emberline.session import cut_lineage

NOISE = -1


def keep_clusters(labels: DataFrame, include_noise: bool = False) -> DataFrame:
    return labels if include_noise else labels.filter(F.col("cluster_id") >= 0)


def cluster_members(rows: DataFrame, labels: DataFrame, key: str = "log_idx") -> DataFrame:
    """Rows of each cluster: an inner equi-join on the row key."""
    return rows.join(labels, key)


def with_predictions(rows: DataFrame, predictions: DataFrame, key: str = "log_idx") -> DataFrame:
    """Left join; a row without a prediction gets an empty ``top_k``."""
    empty = F.array().cast(predictions.schema["top_k"].dataType)
    return rows.join(predictions, key, "left").withColumn("top_k", F.coalesce("top_k", empty))


def cluster_sizes(labels: DataFrame) -> DataFrame:
    """(cluster_id, size, first_idx, last_idx); the member list itself stays a table."""
    return labels.groupBy("cluster_id").agg(
        F.count("*").alias("size"), F.min("log_idx").alias("first_idx"), F.max("log_idx").alias("last_idx")
    )


def noise_counts(labels: DataFrame) -> DataFrame:
    """One row: distinct clusters without noise, and noise rows."""
    return labels.groupBy("cluster_id").agg(F.count("*").alias("n")).agg(
        F.count_if(F.col("cluster_id") >= 0).alias("n_clusters"),
        F.coalesce(F.sum(F.when(F.col("cluster_id") == NOISE, F.col("n"))), F.lit(0)).alias("n_noise"),
    )


def enum_cube(members: DataFrame) -> DataFrame:
    """(cluster, event type, severity) counts with first row and time bounds: at most 8 x 7 rows per cluster."""
    return members.groupBy("cluster_id", "event_type", "severity").agg(
        F.count("*").alias("n"),
        F.min("log_idx").alias("first_idx"),
        F.min("timestamp").alias("t_min"),
        F.max("timestamp").alias("t_max"),
    )


def time_ranges(cube: DataFrame) -> DataFrame:
    return cube.groupBy("cluster_id").agg(
        F.sum("n").alias("cluster_size"), F.min("t_min").alias("time_start"), F.max("t_max").alias("time_end")
    )


def dominant_event_type(cube: DataFrame) -> DataFrame:
    """Most frequent event type; on ties the one seen first."""
    per_type = cube.groupBy("cluster_id", "event_type").agg(
        F.sum("n").alias("n"), F.min("first_idx").alias("first_idx")
    )
    best = F.max_by("event_type", F.struct("n", (-F.col("first_idx")).alias("early")))
    return per_type.groupBy("cluster_id").agg(best.alias("dominant_event_type"))


def severity_counts(cube: DataFrame) -> DataFrame:
    """Long form (cluster_id, severity, n); a null severity is one of the rows."""
    return cube.groupBy("cluster_id", "severity").agg(F.sum("n").alias("n"))


def severity_breakdown(cube: DataFrame) -> DataFrame:
    """Map form per cluster plus the count of rows without a severity."""
    pairs = F.collect_list(F.when(F.col("severity").isNotNull(), F.struct("severity", "n")))
    return severity_counts(cube).groupBy("cluster_id").agg(
        F.map_from_entries(F.array_sort(pairs)).alias("severity_breakdown"),
        F.coalesce(F.sum(F.when(F.col("severity").isNull(), F.col("n"))), F.lit(0)).alias("severity_missing"),
    )


def distinct_actors(members: DataFrame) -> DataFrame:
    """Distinct non-null source addresses and users per cluster."""
    return members.groupBy("cluster_id").agg(
        F.countDistinct("src_ip").alias("unique_src_ips"), F.countDistinct("user").alias("unique_users_targeted")
    )


def dominant_classes(scored: DataFrame, k: int = DOMINANT_CLASSES) -> DataFrame:
    """Top-k labels per cluster by count, first seen first on ties, with the mean score and a rank."""
    per_label = scored.filter(F.col("label").isNotNull()).groupBy("cluster_id", "label").agg(
        F.count("*").alias("count"), F.avg("score").alias("avg_confidence"), F.min("log_idx").alias("first_idx")
    )
    order = Window.partitionBy("cluster_id").orderBy(F.desc("count"), "first_idx")
    return (
        per_label.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("cluster_id", "rank", F.col("label").alias("class_name"), "count", "avg_confidence")
    )


def class_lists(ranked: DataFrame) -> DataFrame:
    entry = F.struct("rank", "class_name", "count", "avg_confidence")
    return ranked.groupBy("cluster_id").agg(
        F.transform(
            F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["class_name"], e["count"], e["avg_confidence"])
        )
        .cast("array<struct<class_name:string,count:bigint,avg_confidence:double>>")
        .alias("dominant_classes")
    )


def centroids(member_vectors: DataFrame, by: str = "cluster_id", vec: str = "vec") -> DataFrame:
    """Element-wise mean per cluster: one vector-valued aggregate that is combined map-side, whatever the width."""
    rows = member_vectors.filter(F.col(vec).isNotNull()).select(by, array_to_vector(F.col(vec)).alias("_v"))
    return rows.groupBy(by).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("centroid"))


def representative_rows(
    member_vectors: DataFrame, center: DataFrame, count: int = REPRESENTATIVES, vec: str = "vec"
) -> DataFrame:
    """The ``count`` rows per cluster closest to its mean by dot product, lower row index on ties.

    The per-group limit is applied before the shuffle, so a hot cluster sends ``count`` rows per task.
    """
    order = Window.partitionBy("cluster_id").orderBy(F.desc("similarity"), "log_idx")
    scored = member_vectors.join(center, "cluster_id").withColumn(
        "similarity", F.round(vx.dot(F.col(vec), F.col("centroid")), 12)
    )
    return (
        scored.select("cluster_id", "log_idx", "similarity")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= count)
    )


SAMPLE_FIELDS = ["event_id", "timestamp", "event_type", "severity", "description", "src_ip", "dst_ip", "user", "action"]


def representative_lists(ranked: DataFrame, rows: DataFrame) -> DataFrame:
    """Ranked representative rows of each cluster as a short list of structs."""
    detail = ranked.join(rows.select("log_idx", *SAMPLE_FIELDS), "log_idx")
    packed = F.array_sort(F.collect_list(F.struct("rank", F.struct("log_idx", *SAMPLE_FIELDS).alias("r"))))
    return detail.groupBy("cluster_id").agg(
        F.transform(packed, lambda e: e["r"]).alias("representative_logs")
    )


def incident_profiles(members: DataFrame) -> DataFrame:
    """One row per cluster: size, times, dominant type, severity map, distinct actors, derived priority.

    Members are read once: what the profile needs of them is stored, and so is the cube of at most 56 rows a cluster.
    """
    members = cut_lineage(members.select("cluster_id", "log_idx", "timestamp", "event_type", "severity", "src_ip", "user"), "members")
    cube = cut_lineage(enum_cube(members), "cube")
    profile = (
        time_ranges(cube)
        .join(dominant_event_type(cube), "cluster_id")
        .join(severity_breakdown(cube), "cluster_id")
        .join(distinct_actors(members), "cluster_id")
    )
    return profile.withColumn("max_severity", max_severity(F.col("severity_breakdown"))).withColumn(
        "priority", priority_of_severity(F.col("max_severity"))
    )


def out_of_range(df: DataFrame, unit_columns: list[str], positive_columns: list[str]) -> DataFrame:
    """Long report (column, violations): scores outside [0, 1] and sizes below 1."""
    checks: dict[str, Column] = {c: F.expr(outside_unit(f"cast(`{c}` AS DOUBLE)")) for c in unit_columns}
    checks |= {c: F.coalesce(F.col(c) < 1, F.lit(True)) for c in positive_columns}
    counted = df.agg(*[F.count_if(bad).alias(name) for name, bad in checks.items()])
    return counted.unpivot([], list(checks), "column_name", "violations")
