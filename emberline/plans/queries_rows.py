"""Registered queries: ingest, validation, filters and score checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import fields as fx
from emberline.operators import validate as val
from emberline.operators.profile import keep_clusters, out_of_range
from emberline.plans import views as v
from emberline.plans.sqlviews import CHECKED, LOGS, MARKERS, MEMBERSHIP, RAW, V4
from emberline.schema import EVENT_TYPES, SEVERITIES, STORED_REJECTS, TEXT_LIMIT
from emberline.session import with_ordinal


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    return val.validate_text(v.raw_logs(spark, sf))


def load_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return val.load_stats(_checked(spark, sf)).withColumn("skip_rate", F.round("skip_rate", 6))


def load_statistics_json(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.raw_json(spark, sf).select("log_idx", F.try_parse_json("value").alias("row"))
    return val.load_stats(val.validate_variant(rows)).withColumn("skip_rate", F.round("skip_rate", 6))


def enum_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return v.raw_logs(spark, sf).select(
        "log_idx",
        F.expr(fx.enum_member("event_type", EVENT_TYPES)).alias("event_type"),
        F.expr(fx.enum_member("severity", SEVERITIES)).alias("severity"),
    )


def marker_to_null(spark: SparkSession, sf: str) -> DataFrame:
    return v.raw_logs(spark, sf).select(
        "log_idx", *[F.expr(fx.blank_marker_to_null(c)).alias(c) for c in ("src_ip", "dst_ip", "src_port")]
    )


def ip_check(spark: SparkSession, sf: str) -> DataFrame:
    return v.raw_logs(spark, sf).select(
        "log_idx", *[F.expr(fx.ip_text(f"({fx.blank_marker_to_null(c)})")).alias(c) for c in ("src_ip", "dst_ip")]
    )


def port_check(spark: SparkSession, sf: str) -> DataFrame:
    return v.raw_logs(spark, sf).select(
        "log_idx", *[F.expr(fx.port_from_text(f"({fx.blank_marker_to_null(c)})")).alias(c) for c in ("src_port", "dst_port")]
    )


def required_fields(spark: SparkSession, sf: str) -> DataFrame:
    missing = F.explode("errors").alias("e")
    return (
        _checked(spark, sf)
        .select(missing)
        .filter(F.col("e.field").isin("event_id", "description", "timestamp") & (F.col("e.msg") != "not a time"))
        .groupBy(F.col("e.field").alias("field"))
        .agg(F.count("*").alias("n"))
    )


def strict_types(spark: SparkSession, sf: str) -> DataFrame:
    """JSON rows whose user field is a number instead of text are rejected."""
    events = v.table(spark, sf, "events")
    as_json = F.to_json(
        F.struct(
            F.concat(F.lit("e"), "event_id").alias("event_id"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"),
            F.lit("auth").alias("event_type"), F.col("props").alias("description"), F.col("props").alias("raw_log"),
            F.col("user_id").alias("user"),
        )
    )
    checked = val.validate_variant(events.select(F.col("event_id").alias("log_idx"), F.parse_json(as_json).alias("row")))
    return (
        checked.select(F.explode("errors").alias("e"))
        .groupBy(F.col("e.field").alias("field"), F.col("e.msg").alias("msg"))
        .agg(F.count("*").alias("n"))
    )


def nested_structs(spark: SparkSession, sf: str) -> DataFrame:
    return v.logs(spark, sf).select(
        "log_idx", F.col("advanced_metadata.risk_score").alias("risk_score"),
        F.col("advanced_metadata.extras")["asset"].alias("asset"),
    )


def open_extras(spark: SparkSession, sf: str) -> DataFrame:
    return v.logs(spark, sf).select("log_idx", F.col("extras")["site"].alias("site"))


def timestamps(spark: SparkSession, sf: str) -> DataFrame:
    return v.raw_logs(spark, sf).select(
        "log_idx", F.expr(fx.time_from_text("`timestamp`")).cast("timestamp_ntz").alias("timestamp")
    )


def valid_rows(spark: SparkSession, sf: str) -> DataFrame:
    return v.logs(spark, sf).select(
        "log_idx", "event_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "event_type", "severity",
        "description", "raw_log", "user", "action", "src_ip", "dst_ip", "src_port", "dst_port",
    )


def text_limit(spark: SparkSession, sf: str) -> DataFrame:
    docs = v.table(spark, sf, "documents").select("doc_id", "text")
    guarded = val.split_by_text_limit(docs, "text", TEXT_LIMIT)
    return guarded.groupBy("over_limit").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest")
    )


def noise_filter(spark: SparkSession, sf: str) -> DataFrame:
    return keep_clusters(v.membership(spark, sf)).select("log_idx", "cluster_id")


def score_ranges(spark: SparkSession, sf: str) -> DataFrame:
    labels, events = v.table(spark, sf, "labels"), v.table(spark, sf, "events")
    first = out_of_range(labels, ["quality", "toxic"], [])
    return first.unionByName(out_of_range(events, ["value"], ["user_id"]))


def ip_serialise(spark: SparkSession, sf: str) -> DataFrame:
    return v.logs(spark, sf).select(
        "log_idx", *[F.coalesce(c, F.lit("n/a")).alias(c) for c in ("src_ip", "dst_ip")]
    )


def reject_rows(spark: SparkSession, sf: str) -> DataFrame:
    """First stored rejects by row number, with their preview length."""
    numbered = with_ordinal(v.raw_logs(spark, sf), [F.col("log_idx")], "_at")
    rows = numbered.withColumn("row_no", F.col("_at") + 1).drop("_at")
    rejects = val.rejected_rows(val.validate_text(rows))
    return rejects.orderBy("row_no").limit(STORED_REJECTS).select(
        "row_no", F.size(F.split("error", "; ")).alias("n_problems"), (F.length("raw_preview") <= 200).alias("short")
    )


_PER_FIELD = """SELECT 'event_id' AS field, sum(bad_event_id)::BIGINT AS n FROM verdict HAVING sum(bad_event_id) > 0
UNION ALL SELECT 'description', sum(bad_description)::BIGINT FROM verdict HAVING sum(bad_description) > 0"""

QUERIES = {
    "a6_load_stats": (
        load_statistics,
        f"""WITH {RAW},{CHECKED} SELECT count(*) AS total_rows, count(*) FILTER (problems = 0) AS parsed,
        count(*) FILTER (problems > 0) AS skipped,
        round(coalesce(count(*) FILTER (problems > 0) / nullif(count(*), 0)::DOUBLE, 0), 6) AS skip_rate FROM verdict""",
    ),
    "d13_load_stats_json": (
        load_statistics_json,
        f"""WITH {RAW},{CHECKED} SELECT count(*) AS total_rows, count(*) FILTER (problems = 0) AS parsed,
        count(*) FILTER (problems > 0) AS skipped,
        round(coalesce(count(*) FILTER (problems > 0) / nullif(count(*), 0)::DOUBLE, 0), 6) AS skip_rate FROM verdict""",
    ),
    "b1_enum_normalise": (
        enum_normalise,
        f"""WITH {RAW},{CHECKED} SELECT log_idx, CASE WHEN bad_event_type = 0 THEN event_type END AS event_type, severity
        FROM verdict""",
    ),
    "b2_empty_marker": (
        marker_to_null,
        f"""WITH {RAW} SELECT log_idx, CASE WHEN lower(trim(src_ip)) NOT IN {MARKERS} THEN src_ip END AS src_ip,
        CASE WHEN lower(trim(dst_ip)) NOT IN {MARKERS} THEN dst_ip END AS dst_ip,
        CASE WHEN lower(trim(src_port)) NOT IN {MARKERS} THEN src_port END AS src_port FROM raw""",
    ),
    "b3_ip_check": (
        ip_check,
        f"""WITH {RAW} SELECT log_idx, CASE WHEN regexp_matches(src_ip, {V4}) THEN src_ip END AS src_ip,
        CASE WHEN regexp_matches(dst_ip, {V4}) THEN dst_ip END AS dst_ip FROM raw""",
    ),
    "b4_port_check": (
        port_check,
        f"""WITH {RAW},{CHECKED} SELECT log_idx, CASE WHEN bad_src_port = 0 THEN src_port::INT END AS src_port,
        CASE WHEN bad_dst_port = 0 THEN dst_port::INT END AS dst_port FROM verdict""",
    ),
    "b5_required_fields": (required_fields, f"WITH {RAW},{CHECKED} {_PER_FIELD}"),
    "b6_strict_types": (
        strict_types,
        "SELECT 'user' AS field, 'not a string' AS msg, count(*) AS n FROM events HAVING count(*) > 0",
    ),
    "b7_nested_structs": (
        nested_structs,
        f"WITH {LOGS} SELECT log_idx, risk::DOUBLE AS risk_score, 'a' || asset AS asset FROM logs",
    ),
    "b9_open_extras": (open_extras, f"WITH {LOGS} SELECT log_idx, 's' || site_no AS site FROM logs"),
    "b10_timestamps": (timestamps, f'WITH {RAW} SELECT log_idx, moment AS "timestamp" FROM raw'),
    "b11_valid_rows": (
        valid_rows,
        f"""WITH {LOGS} SELECT log_idx, event_id, "timestamp", event_type, severity, description, raw_log, "user",
        action, src_ip, dst_ip, src_port, dst_port FROM logs""",
    ),
    "b12_text_limit": (
        text_limit,
        """SELECT length(text) > 2048 AS over_limit, count(*) AS n, sum(length(text))::BIGINT AS chars,
        max(length(text)) AS longest FROM documents GROUP BY 1""",
    ),
    "b13_noise_filter": (
        noise_filter, f"WITH {MEMBERSHIP} SELECT log_idx, cluster_id FROM membership WHERE cluster_id >= 0"
    ),
    "b15_score_ranges": (
        score_ranges,
        """SELECT 'quality' AS column_name, count(*) FILTER (quality NOT BETWEEN 0 AND 1) AS violations FROM labels
        UNION ALL SELECT 'toxic', count(*) FILTER (toxic NOT BETWEEN 0 AND 1) FROM labels
        UNION ALL SELECT 'value', count(*) FILTER (value NOT BETWEEN 0 AND 1) FROM events
        UNION ALL SELECT 'user_id', count(*) FILTER (user_id < 1) FROM events""",
    ),
    "b16_ip_serialise": (
        ip_serialise,
        f"WITH {LOGS} SELECT log_idx, coalesce(src_ip, 'n/a') AS src_ip, coalesce(dst_ip, 'n/a') AS dst_ip FROM logs",
    ),
    "e6_first_rejects": (
        reject_rows,
        f"""WITH {RAW},{CHECKED} SELECT row_no, problems AS n_problems, true AS short
        FROM (SELECT *, row_number() OVER (ORDER BY log_idx) AS row_no FROM verdict) WHERE problems > 0
        ORDER BY row_no LIMIT 10""",
    ),
}
