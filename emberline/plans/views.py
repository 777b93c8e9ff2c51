"""Log, vector and playbook views over the shared Parquet tables, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators.validate import valid_rows, validate_text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RAW_FIELDS = {
    "event_id": "CASE WHEN event_id % 101 = 0 THEN NULL ELSE concat('evt-', event_id) END",
    "timestamp": (
        "CASE WHEN event_id % 103 = 0 THEN 'not a time' "
        "WHEN event_id % 107 = 0 THEN cast(1700000000 + event_id AS STRING) "
        "ELSE concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"), 'Z') END"
    ),
    "event_type": (
        "CASE WHEN event_id % 89 = 0 THEN 'telemetry' WHEN event_type = 'error' THEN 'IDS-Alert' "
        "WHEN event_type = 'click' THEN ' Network ' WHEN event_type = 'view' THEN 'endpoint' "
        "WHEN event_type = 'signup' THEN 'AUTH' ELSE 'Cloud' END"
    ),
    "severity": (
        "CASE WHEN event_id % 50 = 0 THEN NULL WHEN value < 10 THEN 'INFO' WHEN value < 25 THEN 'low' "
        "WHEN value < 60 THEN ' Medium' WHEN value < 120 THEN 'HIGH' WHEN value < 250 THEN 'Critical' "
        "ELSE 'emergency' END"
    ),
    "description": (
        "CASE WHEN event_id % 83 = 0 THEN '' ELSE concat(event_type, ' by user ', user_id, ' on host h', "
        "regexp_extract(props, '[0-9]+', 0), ' tag T', 1000 + event_id % 60, "
        "CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('.00', event_id % 3) END) END"
    ),
    "raw_log": "concat('CEF:0|sensor|', event_type, '|', event_id)",
    "user": "CASE WHEN user_id % 10 = 9 THEN NULL ELSE concat('u', user_id) END",
    "action": "concat('k', regexp_extract(props, '[0-9]+', 0))",
    "src_ip": (
        "CASE WHEN event_id % 7 = 0 THEN ' N/A ' WHEN event_id % 97 = 0 THEN '300.1.2.3' "
        "ELSE concat('10.0.', user_id div 256, '.', user_id % 256) END"
    ),
    "dst_ip": "CASE WHEN event_id % 5 = 0 THEN '-' ELSE concat('192.168.0.', event_id % 256) END",
    "src_port": (
        "CASE WHEN event_id % 11 = 0 THEN 'unknown' WHEN event_id % 13 = 0 THEN concat(' ', event_id % 65536) "
        "ELSE cast(event_id * 37 % 70000 AS STRING) END"
    ),
    "dst_port": "CASE WHEN event_id % 17 = 0 THEN '22.0' ELSE '443' END",
    "advanced_metadata": (
        "CASE WHEN event_id % 79 = 0 THEN 'plain' ELSE concat('{\"risk_score\":', event_id % 100, "
        "',\"asset\":\"a', event_id % 9, '\"}') END"
    ),
    "site": "concat('s', event_id % 4)",
}


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unvalidated text rows, one per event, with every kind of flaw the validator looks for."""
    events = table(spark, sf_dir, "events")
    return events.selectExpr(
        "event_id AS log_idx", *[f"{sql} AS `{name}`" for name, sql in RAW_FIELDS.items() if name != "event_id"],
        f"{RAW_FIELDS['event_id']} AS `event_id`",
    )


def raw_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw rows as JSON text, one object per row; null fields are left out."""
    raw = raw_logs(spark, sf_dir)
    meta = F.coalesce(F.try_parse_json("advanced_metadata"), F.col("advanced_metadata").cast("variant"))
    fields = [c for c in raw.columns if c not in ("log_idx", "advanced_metadata")]
    return raw.select(
        "log_idx", F.to_json(F.struct(*fields, meta.alias("advanced_metadata"))).alias("value")
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validated log rows."""
    return valid_rows(validate_text(raw_logs(spark, sf_dir)))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id"), F.col("embedding").alias("vec"), F.col("label")
    )


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_idx, vec_id, cluster_id): each event uses one vector; label 9 plays the noise cluster."""
    embeddings = table(spark, sf_dir, "embeddings")
    n_vec = embeddings.select(F.count("*")).scalar()
    cluster = F.when(F.col("label") == 9, -1).otherwise(F.col("label")).cast("int")
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("log_idx"), (F.col("event_id") % n_vec).alias("vec_id")
    )
    return events.join(embeddings.select("vec_id", cluster.alias("cluster_id")), "vec_id").select(
        "log_idx", "vec_id", "cluster_id"
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validated rows with their cluster."""
    return logs(spark, sf_dir).join(membership(spark, sf_dir), "log_idx")


def playbook_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_file, content): every document as Markdown, one headed section per line of its text."""
    return table(spark, sf_dir, "documents").selectExpr(
        "concat('doc_', doc_id, '.md') AS source_file",
        """concat('# Playbook: Guide ', doc_id, '\\n\\n',
             array_join(transform(split(text, '\\n'), (l, i) -> concat(
               CASE WHEN i % 3 = 2 THEN '### Step ' ELSE '## Part ' END, i, '\\n', l,
               '\\nSee T', 1000 + (doc_id * 7 + i) % 60,
               CASE WHEN (doc_id + i) % 3 = 0 THEN '' ELSE concat('.00', (doc_id + i) % 3) END)), '\\n\\n'),
             '\\n\\n```\\n# sample, not a heading\\n```\\n') AS content""",
    )
