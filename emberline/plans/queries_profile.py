"""Registered queries: joins, aggregations and rankings over clustered log rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import text as tx
from emberline.operators import profile as pf
from emberline.operators import scoring as sc
from emberline.plans import views as v
from emberline.plans.sqlviews import (
    CENTROIDS, CLASS_NAMES, DOMINANT, MEMBERS, MEMBERSHIP, PROFILE, REPRESENTATIVES, SCORED, rank_of,
)
from emberline.session import cut_lineage, with_ordinal

DIMS = 64


def _vectors_of(spark: SparkSession, sf: str) -> DataFrame:
    members = v.members(spark, sf).select("log_idx", "vec_id", "cluster_id")
    return members.join(v.vectors(spark, sf).select("vec_id", "vec"), "vec_id")


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    members = v.members(spark, sf).select("log_idx", "cluster_id", "description")
    return sc.hash_classify(members, "description", CLASS_NAMES)


def membership_join(spark: SparkSession, sf: str) -> DataFrame:
    joined = pf.cluster_members(v.logs(spark, sf), v.membership(spark, sf))
    return joined.select("log_idx", "event_id", "event_type", "vec_id", "cluster_id")


def predictions_join(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of kept clusters have predictions; the noise rows keep an empty list."""
    scored = _predictions(spark, sf)
    kept = pf.keep_clusters(scored).select("log_idx", "label", "score", "top_k")
    joined = pf.with_predictions(v.members(spark, sf).select("log_idx", "cluster_id"), kept)
    return joined.select(
        "log_idx", "cluster_id", "label", F.round("score", 6).alias("score"), F.size("top_k").alias("n_top")
    )


def group_by_label(spark: SparkSession, sf: str) -> DataFrame:
    return pf.cluster_sizes(v.membership(spark, sf))


def noise_counts(spark: SparkSession, sf: str) -> DataFrame:
    return pf.noise_counts(v.membership(spark, sf))


def time_range(spark: SparkSession, sf: str) -> DataFrame:
    ranges = pf.time_ranges(pf.enum_cube(v.members(spark, sf)))
    return ranges.select(
        "cluster_id", "cluster_size", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("time_start", "time_end")]
    )


def dominant_event_type(spark: SparkSession, sf: str) -> DataFrame:
    return pf.dominant_event_type(pf.enum_cube(v.members(spark, sf)))


def severity_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return pf.severity_counts(pf.enum_cube(v.members(spark, sf)))


def distinct_actors(spark: SparkSession, sf: str) -> DataFrame:
    return pf.distinct_actors(v.members(spark, sf))


def centroid(spark: SparkSession, sf: str) -> DataFrame:
    centers = pf.centroids(_vectors_of(spark, sf))
    return centers.select("cluster_id", F.posexplode("centroid").alias("i", "x")).select(
        "cluster_id", (F.col("i") + 1).cast("bigint").alias("i"), F.round("x", 9).alias("x")
    )


def representatives(spark: SparkSession, sf: str) -> DataFrame:
    rows = _vectors_of(spark, sf)
    best = pf.representative_rows(rows, pf.centroids(rows))
    return best.select("cluster_id", "log_idx", "rank", F.round("similarity", 6).alias("similarity"))


def dominant_classes(spark: SparkSession, sf: str) -> DataFrame:
    return pf.dominant_classes(_predictions(spark, sf)).withColumn(
        "avg_confidence", F.round("avg_confidence", 6)
    )


def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    scored = _predictions(spark, sf)
    return scored.groupBy("cluster_id", "label").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.min("log_idx").alias("first_idx")
    )


def max_severity(spark: SparkSession, sf: str) -> DataFrame:
    breakdown = pf.severity_breakdown(pf.enum_cube(v.members(spark, sf)))
    top = tx.max_severity(F.col("severity_breakdown"))
    return breakdown.select("cluster_id", top.alias("max_severity"), tx.priority_of_severity(top).alias("priority"))


def severity_ordering(spark: SparkSession, sf: str) -> DataFrame:
    breakdown = pf.severity_breakdown(pf.enum_cube(v.members(spark, sf)))
    ordered = tx.severities_high_first(F.col("severity_breakdown"))
    text = F.array_join(F.transform(ordered, lambda e: F.concat(e["severity"], F.lit("="), e["n"])), ",")
    return breakdown.select("cluster_id", text.alias("severities"))


def incident_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles of the kept clusters in report order."""
    kept = cut_lineage(pf.keep_clusters(v.members(spark, sf)), "members")
    rows = pf.incident_profiles(kept)
    order = {p: i for i, p in enumerate(("critical", "high", "medium", "low", "informational"))}
    rank = F.create_map(*[x for p, i in order.items() for x in (F.lit(p), F.lit(i))])[F.col("priority")]
    entries = F.map_entries("severity_breakdown")
    text = F.array_join(
        F.transform(
            F.array_sort(entries), lambda e: F.concat(e["key"], F.lit("="), e["value"])
        ), ",",
    )
    return rows.orderBy(rank, F.desc("cluster_size"), "cluster_id").select(
        "cluster_id", "cluster_size", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("time_start", "time_end")],
        "dominant_event_type", text.alias("severities"), "severity_missing", "unique_src_ips",
        "unique_users_targeted", "max_severity", "priority",
    )


def technique_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct techniques named by the rows of each cluster, in long form."""
    members = v.members(spark, sf)
    named = members.select("cluster_id", F.explode(tx.techniques(F.col("description"))).alias("technique"))
    return named.distinct()


def range_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    numbered = with_ordinal(v.table(spark, sf, "documents").select("doc_id", "text"), [F.col("doc_id")])
    return sc.batch_numbers(numbered, "ordinal", 64).groupBy("batch_no").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")
    )


def _sev(order: str) -> str:
    return f"""SELECT cluster_id, string_agg(severity || '=' || n, ',' ORDER BY {order}) AS severities
    FROM (SELECT cluster_id, severity, count(*) AS n FROM members WHERE severity IS NOT NULL GROUP BY ALL)
    GROUP BY cluster_id"""


QUERIES = {
    "c1_membership_join": (
        membership_join,
        f"WITH {MEMBERS} SELECT log_idx, event_id, event_type, vec_id, cluster_id FROM members",
    ),
    "c2_predictions_join": (
        predictions_join,
        f"""WITH {MEMBERS},{SCORED} SELECT log_idx, cluster_id, CASE WHEN cluster_id >= 0 THEN label END AS label,
        CASE WHEN cluster_id >= 0 THEN round(score, 6) END AS score, CASE WHEN cluster_id >= 0 THEN 5 ELSE 0 END AS n_top
        FROM members JOIN scored USING (log_idx)""",
    ),
    "d1_group_by_label": (
        group_by_label,
        f"""WITH {MEMBERSHIP} SELECT cluster_id, count(*) AS size, min(log_idx) AS first_idx, max(log_idx) AS last_idx
        FROM membership GROUP BY cluster_id""",
    ),
    "d2_noise_counts": (
        noise_counts,
        f"""WITH {MEMBERSHIP} SELECT count(DISTINCT cluster_id) FILTER (cluster_id >= 0) AS n_clusters,
        count(*) FILTER (cluster_id = -1) AS n_noise FROM membership""",
    ),
    "d3_time_range": (
        time_range, f"WITH {MEMBERS},{PROFILE} SELECT cluster_id, cluster_size, time_start, time_end FROM profile"
    ),
    "d4_dominant_event_type": (
        dominant_event_type, f"WITH {MEMBERS},{PROFILE} SELECT cluster_id, dominant_event_type FROM profile"
    ),
    "d5_severity_histogram": (
        severity_histogram, f"WITH {MEMBERS} SELECT cluster_id, severity, count(*) AS n FROM members GROUP BY ALL"
    ),
    "d6_distinct_actors": (
        distinct_actors,
        f"WITH {MEMBERS},{PROFILE} SELECT cluster_id, unique_src_ips, unique_users_targeted FROM profile",
    ),
    "d7_centroid": (
        centroid, f"WITH {MEMBERS},{CENTROIDS} SELECT cluster_id, i, round(x, 9) AS x FROM elements"
    ),
    "d8_class_counts": (
        class_counts,
        f"""WITH {MEMBERS},{SCORED} SELECT cluster_id, label, count(*) AS n, round(avg(score), 6) AS mean_score,
        min(log_idx) AS first_idx FROM members JOIN scored USING (log_idx) GROUP BY cluster_id, label""",
    ),
    "d9_max_severity": (
        max_severity, f"WITH {MEMBERS},{PROFILE} SELECT cluster_id, max_severity, priority FROM profile"
    ),
    "d17_technique_sets": (
        technique_sets,
        f"""WITH {MEMBERS} SELECT DISTINCT cluster_id, unnest(regexp_extract_all(description, 'T[0-9]{{4}}(?:\\.[0-9]{{3}})?'))
        AS technique FROM members""",
    ),
    "e1_representatives": (
        representatives,
        f"""WITH {MEMBERS},{CENTROIDS},{REPRESENTATIVES} SELECT cluster_id, log_idx, rank::INT AS rank,
        round(similarity, 6) AS similarity FROM representatives""",
    ),
    "e2_top_classes": (
        dominant_classes,
        f"""WITH {MEMBERS},{SCORED},{DOMINANT} SELECT cluster_id, rank::INT AS rank, class_name, "count",
        round(avg_confidence, 6) AS avg_confidence FROM dominant""",
    ),
    "e10_batch_numbers": (
        range_ordinals,
        """SELECT batch_no, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM (
        SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch_no FROM documents) GROUP BY batch_no""",
    ),
    "e11_severity_order": (
        severity_ordering, f"WITH {MEMBERS} {_sev(rank_of('severity') + ' DESC')}"
    ),
    "p3_incident_profiles": (
        incident_profiles,
        f"""WITH {MEMBERS},{PROFILE}, sev AS ({_sev('severity')}) SELECT cluster_id, cluster_size, time_start, time_end,
        dominant_event_type, severities, severity_missing, unique_src_ips, unique_users_targeted, max_severity, priority
        FROM profile JOIN sev USING (cluster_id) WHERE cluster_id >= 0""",
    ),
}
