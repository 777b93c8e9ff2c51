"""The demonstration views of ``views.py`` written as DuckDB common table expressions."""

RAW = """
raw AS (
  SELECT event_id AS log_idx,
    CASE WHEN event_id % 101 = 0 THEN NULL ELSE 'evt-' || event_id END AS event_id,
    CASE WHEN event_id % 103 = 0 THEN NULL
         WHEN event_id % 107 = 0 THEN make_timestamp((1700000000 + event_id) * 1000000) ELSE ts END AS moment,
    CASE WHEN event_id % 89 = 0 THEN 'telemetry' WHEN event_type = 'error' THEN 'IDS-Alert'
         WHEN event_type = 'click' THEN ' Network ' WHEN event_type = 'view' THEN 'endpoint'
         WHEN event_type = 'signup' THEN 'AUTH' ELSE 'Cloud' END AS event_type,
    CASE WHEN event_id % 50 = 0 THEN NULL WHEN value < 10 THEN 'INFO' WHEN value < 25 THEN 'low'
         WHEN value < 60 THEN ' Medium' WHEN value < 120 THEN 'HIGH' WHEN value < 250 THEN 'Critical'
         ELSE 'emergency' END AS severity,
    CASE WHEN event_id % 83 = 0 THEN '' ELSE event_type || ' by user ' || user_id || ' on host h'
      || regexp_extract(props, '[0-9]+') || ' tag T' || (1000 + event_id % 60)
      || CASE WHEN event_id % 3 = 0 THEN '' ELSE '.00' || (event_id % 3) END END AS description,
    'CEF:0|sensor|' || event_type || '|' || event_id AS raw_log,
    CASE WHEN user_id % 10 = 9 THEN NULL ELSE 'u' || user_id END AS "user",
    'k' || regexp_extract(props, '[0-9]+') AS action,
    CASE WHEN event_id % 7 = 0 THEN ' N/A ' WHEN event_id % 97 = 0 THEN '300.1.2.3'
         ELSE '10.0.' || (user_id // 256) || '.' || (user_id % 256) END AS src_ip,
    CASE WHEN event_id % 5 = 0 THEN '-' ELSE '192.168.0.' || (event_id % 256) END AS dst_ip,
    CASE WHEN event_id % 11 = 0 THEN 'unknown' WHEN event_id % 13 = 0 THEN ' ' || (event_id % 65536)
         ELSE (event_id * 37 % 70000)::VARCHAR END AS src_port,
    CASE WHEN event_id % 17 = 0 THEN '22.0' ELSE '443' END AS dst_port,
    CASE WHEN event_id % 79 = 0 THEN 'plain' ELSE '{' END AS advanced_metadata,
    event_id % 100 AS risk, event_id % 9 AS asset, event_id % 4 AS site_no
  FROM events)
"""

MARKERS = "('', 'n/a', 'null', 'none', '-', 'unknown')"
V4 = (
    "'^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$'"
)

CHECKED = f"""
typed AS (
  SELECT log_idx, event_id, moment AS "timestamp",
    replace(replace(lower(trim(event_type)), ' ', '_'), '-', '_') AS event_type,
    replace(replace(lower(trim(severity)), ' ', '_'), '-', '_') AS severity,
    nullif(description, '') AS description, raw_log, "user", action,
    CASE WHEN lower(trim(src_ip)) NOT IN {MARKERS} THEN src_ip END AS src_ip,
    CASE WHEN lower(trim(dst_ip)) NOT IN {MARKERS} THEN dst_ip END AS dst_ip,
    CASE WHEN lower(trim(src_port)) NOT IN {MARKERS} THEN trim(src_port) END AS src_port,
    CASE WHEN lower(trim(dst_port)) NOT IN {MARKERS} THEN trim(dst_port) END AS dst_port,
    advanced_metadata, risk, asset, site_no
  FROM raw),
checked AS (
  SELECT *,
    (event_id IS NULL)::INT AS bad_event_id, ("timestamp" IS NULL)::INT AS bad_timestamp,
    (event_type NOT IN ('auth','firewall','endpoint','network','cloud','ai','iot','ids_alert'))::INT AS bad_event_type,
    (description IS NULL)::INT AS bad_description,
    coalesce(NOT regexp_matches(src_ip, {V4}), false)::INT AS bad_src_ip,
    coalesce(NOT regexp_matches(dst_ip, {V4}), false)::INT AS bad_dst_ip,
    coalesce(NOT (regexp_matches(src_port, '^[+-]?[0-9]+$') AND src_port::INT BETWEEN 0 AND 65535), false)::INT
      AS bad_src_port,
    coalesce(NOT regexp_matches(dst_port, '^[+-]?[0-9]+$'), false)::INT AS bad_dst_port,
    (advanced_metadata <> '{{')::INT AS bad_advanced_metadata
  FROM typed),
verdict AS (
  SELECT *, bad_event_id + bad_timestamp + bad_event_type + bad_description + bad_src_ip + bad_dst_ip
    + bad_src_port + bad_dst_port + bad_advanced_metadata AS problems FROM checked)
"""

LOGS = f"""{RAW},{CHECKED},
logs AS (SELECT log_idx, event_id, "timestamp", event_type, severity, description, raw_log, "user", action,
  src_ip, dst_ip, src_port::INT AS src_port, dst_port::INT AS dst_port, risk, asset, site_no
  FROM verdict WHERE problems = 0)
"""

MEMBERSHIP = """
vectors AS (SELECT vec_id, embedding::DOUBLE[] AS vec, label FROM embeddings),
membership AS (
  SELECT e.event_id AS log_idx, v.vec_id, CASE WHEN v.label = 9 THEN -1 ELSE v.label END AS cluster_id
  FROM (SELECT event_id, event_id % (SELECT count(*) FROM embeddings) AS vec_id FROM events) e
  JOIN embeddings v USING (vec_id))
"""

MEMBERS = f"{LOGS},{MEMBERSHIP}, members AS (SELECT l.*, m.vec_id, m.cluster_id FROM logs l JOIN membership m USING (log_idx))"

# Rank of a severity and the priority of a rank, as CASE text over a column.
def rank_of(c: str) -> str:
    return (
        f"CASE {c} WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 "
        f"WHEN 'critical' THEN 4 WHEN 'emergency' THEN 5 END"
    )


def severity_of(c: str) -> str:
    return (
        f"CASE {c} WHEN 0 THEN 'info' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' "
        f"WHEN 4 THEN 'critical' WHEN 5 THEN 'emergency' ELSE 'low' END"
    )


def priority_of(c: str) -> str:
    return (
        f"CASE {c} WHEN 'emergency' THEN 'critical' WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'high' "
        f"WHEN 'medium' THEN 'medium' WHEN 'low' THEN 'low' ELSE 'informational' END"
    )


CLASS_NAMES = ["brute_force", "beaconing", "data_exfiltration", "port_scan", "policy_violation", "benign_activity"]
_NAMES = "[" + ", ".join(f"'{n}'" for n in CLASS_NAMES) + "]"
SCORED = f"""
scored AS (
  SELECT log_idx, {_NAMES}[(('0x' || substr(sha256(description), 1, 4))::INT % {len(CLASS_NAMES)}) + 1] AS label,
    0.9 / (0.9 + 0.1 * {len(CLASS_NAMES) - 1}) AS score
  FROM members)
"""

PROFILE = f"""
sizes AS (SELECT cluster_id, count(*) AS cluster_size, min("timestamp") AS time_start, max("timestamp") AS time_end,
    count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT "user") AS unique_users_targeted,
    max({rank_of('severity')}) AS sev_rank, count(*) FILTER (severity IS NULL) AS severity_missing
  FROM members GROUP BY cluster_id),
types AS (SELECT cluster_id, event_type AS dominant_event_type FROM (
    SELECT cluster_id, event_type, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, min(log_idx)) AS rn
    FROM members GROUP BY cluster_id, event_type) WHERE rn = 1),
profile AS (SELECT s.*, t.dominant_event_type, {severity_of('s.sev_rank')} AS max_severity,
    {priority_of(severity_of('s.sev_rank'))} AS priority
  FROM sizes s JOIN types t USING (cluster_id))
"""

CENTROIDS = """
elements AS (SELECT m.cluster_id, i.i, avg(v.vec[i.i]) AS x FROM members m JOIN vectors v USING (vec_id),
    (SELECT unnest(range(1, 65)) AS i) i GROUP BY ALL),
centroids AS (SELECT cluster_id, list(x ORDER BY i) AS centroid FROM elements GROUP BY cluster_id)
"""
REPRESENTATIVES = """
representatives AS (SELECT * FROM (
    SELECT cluster_id, log_idx, similarity,
      row_number() OVER (PARTITION BY cluster_id ORDER BY similarity DESC, log_idx) AS rank
    FROM (SELECT m.cluster_id, m.log_idx, round(list_dot_product(v.vec, c.centroid), 12) AS similarity
          FROM members m JOIN vectors v USING (vec_id) JOIN centroids c USING (cluster_id))) WHERE rank <= 3)
"""
DOMINANT = """
dominant AS (SELECT * FROM (
    SELECT cluster_id, label AS class_name, count(*) AS "count", avg(score) AS avg_confidence,
      row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, min(log_idx)) AS rank
    FROM members JOIN scored USING (log_idx) GROUP BY cluster_id, label) WHERE rank <= 3)
"""
