"""Registered queries: density clustering, recommendations, reports and the whole analysis."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import text as tx
from emberline.operators import density as dn
from emberline.operators import nearest as nn
from emberline.operators import profile as pf
from emberline.operators import recommend as rc
from emberline.operators import report as rp
from emberline.operators import retrieve as rt
from emberline.operators import scoring as sc
from emberline.plans import views as v
from emberline.plans.analyse import analyse
from emberline.plans.queries_text import (
    BOOSTED, FETCHED, INCIDENT_SQL, PLAYBOOK_BLOCKS, PLAYBOOKS, TEXT_BLOCKS, embedded_chunks, profiles_with_samples, query_rows, span_sql,
)
from emberline.plans.sqlviews import CLASS_NAMES, LOGS, MEMBERS, MEMBERSHIP, PROFILE, SCORED
from emberline.schema import DOMINANT_CLASSES, MIN_CLUSTER_SIZE, MIN_SAMPLES, REPRESENTATIVES
from emberline.session import cut_lineage, scratch_root

EPS = 1.15
LEAF_ROWS = 64
PAIRS = """
unit AS (SELECT vec_id, [x / sqrt(list_dot_product(e, e)) for x in e] AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.v, b.v) AS d FROM unit a JOIN unit b ON a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(d, 9), b) AS rn FROM pairs),
core AS (SELECT a AS vec_id, max(d) AS core FROM ranked WHERE rn <= 3 GROUP BY a)
"""


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return v.vectors(spark, sf).select(F.col("vec_id").alias("id"), "vec")


def _core(spark: SparkSession, sf: str):
    """(members, tree, neighbours, core) through leaves so small that every table has several."""
    nodes, members = dn.weighted_nodes(_points(spark, sf))
    tree = nn.metric_tree(nodes.select("id", "vec"), LEAF_ROWS)
    near = cut_lineage(nn.tree_nearest(None, nodes, MIN_SAMPLES, LEAF_ROWS, tree), "near")
    return members, tree, near, cut_lineage(dn.core_distances(nodes, near, MIN_SAMPLES), "core")


def _tree(spark: SparkSession, sf: str):
    members, tree, near, core = _core(spark, sf)
    return members, core, dn.spanning_tree(core, tree, near=near)


def core_distance(spark: SparkSession, sf: str) -> DataFrame:
    members, _, _, core = _core(spark, sf)
    return members.join(core.withColumnRenamed("id", "node"), "node").select(
        F.col("id").alias("vec_id"), F.round("core", 6).alias("core")
    )


def mutual_reachability(spark: SparkSession, sf: str) -> DataFrame:
    """What the pairs of each row with all others weigh, and how many of them are links at ``EPS``."""
    members, tree, _, core = _core(spark, sf)
    rows = cut_lineage(tree.rows.join(core, "id").select("id", "vec", "weight", "core"), "reach")
    totals = dn.reachability_totals(rows, EPS).withColumnRenamed("id", "node")
    return members.join(totals, "node").select(F.col("id").alias("vec_id"), "n_pairs", "n_links", F.round("w_total", 5).alias("w_total"))


def spanning_tree(spark: SparkSession, sf: str) -> DataFrame:
    _, _, tree = _tree(spark, sf)
    return tree.agg(F.count("*").alias("n_edges"), F.round(F.sum("w"), 5).alias("total"), F.round(F.max("w"), 6).alias("longest"))


def flat_cut(spark: SparkSession, sf: str) -> DataFrame:
    members, core, tree = _tree(spark, sf)
    cut = dn.flat_cut(core, tree, EPS)
    return members.join(cut, "node").select(F.col("id").alias("vec_id"), F.coalesce("root", F.lit(-1)).alias("component"))


def condensed_tree(spark: SparkSession, sf: str) -> DataFrame:
    _, core, tree = _tree(spark, sf)
    clusters, _ = dn.condensed_tree(core, tree, MIN_CLUSTER_SIZE)
    return clusters


def stable_clusters(spark: SparkSession, sf: str) -> DataFrame:
    _, core, tree = _tree(spark, sf)
    clusters, _ = dn.condensed_tree(core, tree, MIN_CLUSTER_SIZE)
    return dn.select_clusters(cut_lineage(clusters, "clusters"))


def density_labels(spark: SparkSession, sf: str) -> DataFrame:
    return dn.cluster_points(_points(spark, sf)).withColumnRenamed("id", "vec_id")


# ---- model responses ---------------------------------------------------------------------------------

_BODY = (
    "concat('{\"summary\": \"Summary of case ', {k}, ' in full\", \"threat_assessment\": \"Assessment of case ', {k}, "
    "'\", \"relevant_playbooks\": [], \"immediate_actions\": [\"isolate\"], \"investigation_steps\": [\"query\"], "
    "\"mitre_techniques\": [\"T1001\"]', {tail}, '}')"
)


def response_text(key: str) -> str:
    """Spark SQL text of a model response whose shape follows ``key`` modulo 5."""
    whole = _BODY.replace("{k}", key).replace("{tail}", "', \"priority\": \"High\"'")
    short = _BODY.replace("{k}", key).replace("{tail}", "''")
    return (
        f"CASE {key} % 5 WHEN 0 THEN concat('Here:\\n```json\\n', {whole}, '\\n```\\n') WHEN 1 THEN {whole} "
        f"WHEN 2 THEN concat('The answer is ', {whole}, ' as asked') WHEN 3 THEN ' no object here ' ELSE {short} END"
    )


def response_sql(key: str) -> str:
    """The same in DuckDB."""
    return response_text(key).replace("'Here:\\n```json\\n'", "'Here:' || chr(10) || '```json' || chr(10)").replace(
        "'\\n```\\n'", "chr(10) || '```' || chr(10)"
    )


def responses(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "events").selectExpr(
        "event_id AS cluster_id", "0 AS attempt", f"{response_text('event_id')} AS response", "cast(null AS STRING) AS error",
        "event_id % 700 AS tokens_in", "event_id % 90 AS tokens_out",
        "CASE WHEN event_id % 4 = 0 THEN cast(null AS DOUBLE) ELSE (event_id % 16) / 1024.0 END AS cost_usd",
    )


def extract_json(spark: SparkSession, sf: str) -> DataFrame:
    return responses(spark, sf).select("cluster_id", tx.extract_json(F.col("response")).alias("json"))


def parse_responses(spark: SparkSession, sf: str) -> DataFrame:
    parsed = rc.parse_responses(responses(spark, sf))
    return parsed.select(
        "cluster_id", F.col("rec").isNotNull().alias("valid"), F.col("rec.priority").alias("priority"),
        F.col("rec.summary").alias("summary"),
    )


def recommendation_checks(spark: SparkSession, sf: str) -> DataFrame:
    parsed = rc.parse_responses(responses(spark, sf))
    return parsed.select(F.explode("rec_errors").alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


def usage_totals(spark: SparkSession, sf: str) -> DataFrame:
    return rc.usage_totals(responses(spark, sf))


def cluster_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Two stored attempts per cluster, of neighbouring shapes."""
    clusters = v.membership(spark, sf).select("cluster_id").distinct()
    tries = clusters.filter("cluster_id >= 0").withColumn("attempt", F.explode(F.array(F.lit(0), F.lit(1))))
    return tries.selectExpr(
        "cast(cluster_id AS BIGINT) AS cluster_id", "attempt", f"{response_text('(cluster_id + attempt)')} AS response",
        "cast(null AS STRING) AS error", "100L + cluster_id AS tokens_in", "10L AS tokens_out", "cluster_id / 1024.0D AS cost_usd",
    )


def incidents(spark: SparkSession, sf: str) -> DataFrame:
    profiles = pf.keep_clusters(profiles_with_samples(spark, sf))
    lists = rt.chunk_lists(rt.retrieve(query_rows(spark, sf, profiles), embedded_chunks(spark, sf)))
    with_chunks = profiles.join(lists.withColumnRenamed("qid", "cluster_id"), "cluster_id", "left")
    return rc.with_recommendations(with_chunks, cluster_attempts(spark, sf))


def plain_incidents(spark: SparkSession, sf: str) -> DataFrame:
    """Incidents from stored attempts without retrieval."""
    empty = F.expr("cast(array() AS ARRAY<STRUCT<source_file: STRING, section: STRING, content: STRING, score: DOUBLE>>)")
    profiles = pf.keep_clusters(profiles_with_samples(spark, sf)).withColumn("playbook_chunks", empty)
    return cut_lineage(rc.with_recommendations(profiles, cluster_attempts(spark, sf)), "incidents")


def incident_assembly(spark: SparkSession, sf: str) -> DataFrame:
    return plain_incidents(spark, sf).select(
        "cluster_id", "cluster_size", F.col("recommendation.priority").alias("priority"),
        F.col("recommendation.summary").alias("summary"), "recommendation_unavailable",
        F.size("recommendation.relevant_playbooks").alias("n_playbooks"),
    )


def playbook_override(spark: SparkSession, sf: str) -> DataFrame:
    return incidents(spark, sf).select(
        "cluster_id", "recommendation_unavailable", F.size("recommendation.relevant_playbooks").alias("n_playbooks")
    )


def fallback_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = pf.incident_profiles(v.members(spark, sf))
    rec = rc.fallback_recommendation(F.lit("TimeoutError"))
    return rows.select("cluster_id", rec.alias("r")).select(
        "cluster_id", "r.summary", "r.threat_assessment", "r.priority", F.array_join("r.immediate_actions", "|").alias("actions"),
        F.array_join("r.investigation_steps", "|").alias("steps"),
    )


def skipped_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = rc.without_recommendations(pf.incident_profiles(v.members(spark, sf)))
    return rows.select(
        "cluster_id", F.col("recommendation.summary").alias("summary"), "fallback_reason", "recommendation_unavailable"
    )


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    profiles = profiles_with_samples(spark, sf)
    lists = rt.chunk_lists(rt.retrieve(query_rows(spark, sf, profiles), embedded_chunks(spark, sf)))
    rows = profiles.join(lists.withColumnRenamed("qid", "cluster_id"), "cluster_id", "left")
    return rows.select("cluster_id", rc.incident_prompt().alias("prompt"))


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    return rp.run_stats(v.membership(spark, sf), None, rc.usage_totals(cluster_attempts(spark, sf)), "model-a", "run0")


def run_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _stats(spark, sf)


def by_priority(spark: SparkSession, sf: str) -> DataFrame:
    return rp.incidents_by_priority(plain_incidents(spark, sf))


def summary_table(spark: SparkSession, sf: str) -> DataFrame:
    return rp.summary_table(plain_incidents(spark, sf), _stats(spark, sf))


def incident_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = plain_incidents(spark, sf).orderBy(*rp.report_order())
    return rows.select("cluster_id", F.col("recommendation.priority").alias("priority"), "cluster_size")


def markdown_report(spark: SparkSession, sf: str) -> DataFrame:
    return rp.report_rows(plain_incidents(spark, sf), _stats(spark, sf), "2025-01-01 00:00:00", "events")


def json_report(spark: SparkSession, sf: str) -> DataFrame:
    return rp.report_json(plain_incidents(spark, sf))


def run_report(spark: SparkSession, sf: str) -> DataFrame:
    """The run's JSON document, written and read back: an incident or the statistics from each of its lines."""
    path = f"{scratch_root(spark)}/emberline-report-{uuid.uuid4().hex}"
    rp.write_run_json(rp.run_json(plain_incidents(spark, sf), _stats(spark, sf)), path)
    lines = spark.read.text(path)
    line = F.regexp_replace("value", r'^,|^\],"stats":', "")
    rows = lines.withColumn("row", F.try_parse_json(F.when(F.col("value").startswith("]"), F.regexp_replace(line, r"\}$", "")).otherwise(line)))
    field = lambda path, kind: F.try_variant_get("row", f"$.{path}", kind).alias(path.split(".")[-1])
    return rows.select(
        F.col("value").startswith(",").alias("comma"), F.regexp_extract("value", '"correlation_id":"([a-z0-9]+)"', 1).alias("run_id"),
        field("cluster_id", "bigint"), field("cluster_size", "bigint"), field("recommendation.priority", "string"), field("total_logs", "bigint"),
        field("n_clusters", "bigint"),
    )


GROUPS = 9


def planted_vector(group: Column, noise: list[Column]) -> Column:
    """Groups around a circle, and small noise in four dimensions: dense groups, far apart, of different vectors."""
    angle = 2.0 * math.pi / GROUPS * group
    center = [F.cos(angle), F.sin(angle), F.lit(0.0), F.lit(0.0)]
    return F.array(*[c + 0.05 * (n - 0.5) for c, n in zip(center, noise)])


def planted_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Density clusters of vectors planted in groups by row number, noise taken from the stored vectors' digests."""
    digest = F.sha2(F.array_join(F.col("vec").cast("array<string>"), ","), 256)
    rows = v.vectors(spark, sf).select(F.col("vec_id").alias("id"), planted_vector(F.col("vec_id") % GROUPS, _noise(digest)).alias("vec"))
    return dn.cluster_points(rows).select(F.col("id").alias("vec_id"), "cluster_id", (F.col("probability") > 0).alias("inside"))


def _noise(digest: Column) -> list[Column]:
    return [F.conv(F.substring(digest, 1 + 4 * k, 4), 16, 10).cast("double") / 65535.0 for k in range(4)]


def full_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """All valid rows, each with a text and so a vector of its own, through clustering, classing and the skip path."""
    text = F.concat("description", F.lit(" case "), F.col("log_idx").cast("string"))
    rows = cut_lineage(v.logs(spark, sf).withColumn("description", text), "logs")
    case = F.regexp_extract("text", " case ([0-9]+)$", 1).cast("bigint")
    embed = lambda texts: texts.select("cache_key", planted_vector(case % GROUPS, _noise(F.sha2("text", 256))).alias("vec"))
    classify = lambda scored: sc.hash_classify(scored, "description", CLASS_NAMES)
    done = analyse(rows, embed, 4, classify=classify, skip_recommendations=True, run_id="run0")
    return done.incidents.select(
        "cluster_id", "cluster_size", "dominant_event_type", "max_severity", F.col("recommendation.priority").alias("priority"),
        F.size("representative_logs").alias("n_samples"), F.size("dominant_classes").alias("n_classes"), "fallback_reason",
    )


#: Planted groups of at least the least size, numbered by their smallest row; one group alone is no cluster.
_PLANTED = f"""
planted AS (SELECT id % {GROUPS} AS g, min(id) AS low, count(*) AS n FROM points GROUP BY 1),
numbered AS (SELECT g, CASE WHEN count(*) OVER () > 1 THEN row_number() OVER (ORDER BY low) - 1 ELSE -1 END AS cluster_id FROM planted WHERE n >= {MIN_CLUSTER_SIZE})
"""
_PRIM = f"""
mutual AS (SELECT a, b, greatest(d, x.core, y.core) AS w FROM pairs JOIN core x ON x.vec_id = a JOIN core y ON y.vec_id = b),
first AS (SELECT min(vec_id) AS v FROM core),
prim AS (
  SELECT 1 AS step, b AS v, w AS best FROM mutual JOIN first ON a = first.v
  UNION ALL
  SELECT step + 1, r.v, least(r.best, m.w) FROM (SELECT *, first_value(v) OVER (ORDER BY best, v) AS pick FROM prim) r
  JOIN mutual m ON m.a = r.pick AND m.b = r.v WHERE r.v <> r.pick)
"""
_VALID = "cluster_id % 5 <> 3"
_RESULT = f"""
kept AS (SELECT * FROM profile WHERE cluster_id >= 0),
result AS (SELECT cluster_id, cluster_size, {_VALID} AS ok,
  CASE WHEN {_VALID} THEN 'high' ELSE priority END AS priority, dominant_event_type, max_severity, time_start, time_end,
  CASE WHEN cluster_id % 5 = 4 THEN cluster_id + 1 ELSE cluster_id END AS k FROM kept)
"""
_HEADLINE = f"dominant_event_type || ' cluster ' || cluster_id || ': ' || cluster_size || ' events over ' || {span_sql('time_start', 'time_end')} || '; '"
_FALLBACK = f"{_HEADLINE} || 'advice missing (' || {{e}} || ').'"
_ASSESSED = """'Rule-based: peak severity ' || max_severity || ' sets priority ' || priority || '; ' || unique_src_ips
  || CASE WHEN unique_src_ips = 1 THEN ' source address and ' ELSE ' source addresses and ' END || unique_users_targeted
  || CASE WHEN unique_users_targeted = 1 THEN ' account seen.' ELSE ' accounts seen.' END"""
_ACTIONS = """CASE WHEN priority IN ('critical', 'high') THEN 'Page the on-call responder for cluster ' || cluster_id
  ELSE 'Queue cluster ' || cluster_id || ' for the next triage slot' END"""
_STEPS = """concat_ws('|', 'Pull all ' || dominant_event_type || ' logs from ' || strftime(time_start, '%Y-%m-%dT%H:%M:%SZ') || ' to '
  || strftime(time_end, '%Y-%m-%dT%H:%M:%SZ'),
  CASE WHEN unique_src_ips > 0 THEN 'Trace the source addresses of the cluster in neighbouring log feeds' END,
  CASE WHEN unique_users_targeted > 0 THEN 'Check recent sign-ins and rights of the accounts in the cluster' END)"""
_RESPONSES = f"responses AS (SELECT event_id AS cluster_id, {response_sql('event_id')} AS response FROM events)"


def _outer_sql(c: str) -> str:
    """From the first opening to the last closing brace, by string positions."""
    last = f"length({c}) + 1 - strpos(reverse({c}), '}}')"
    return f"CASE WHEN strpos({c}, '{{') > 0 AND strpos({c}, '}}') > 0 AND {last} > strpos({c}, '{{') THEN substr({c}, strpos({c}, '{{'), {last} - strpos({c}, '{{') + 1) END"


_EXTRACTED = f"""fences AS (SELECT *, CASE WHEN len(string_split(response, '```')) > 2 THEN string_split(response, '```')[2] END AS fenced FROM responses),
extracted AS (SELECT *, coalesce({_outer_sql('fenced')}, {_outer_sql('response')}, trim(response, ' ' || chr(9) || chr(10) || chr(13))) AS json FROM fences)"""
_PRIORITY_RANK = (
    "CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
)
_USAGE = """usage AS (SELECT count(*) FILTER (cluster_id >= 0) AS clusters, sum(2 * (100 + cluster_id)) FILTER (cluster_id >= 0) AS t_in,
  20 * count(*) FILTER (cluster_id >= 0) AS t_out, sum(2 * cluster_id / 1024.0) FILTER (cluster_id >= 0) AS cost
  FROM (SELECT DISTINCT cluster_id FROM membership))"""

QUERIES = {
    "k1_core_distance": (core_distance, f"WITH {PAIRS} SELECT vec_id, round(core, 6) AS core FROM core"),
    "k2_mutual_reachability": (
        mutual_reachability,
        f"""WITH {PAIRS}, mutual AS (SELECT a, greatest(d, x.core, y.core) AS w FROM pairs JOIN core x ON x.vec_id = a JOIN core y ON y.vec_id = b)
        SELECT a AS vec_id, count(*) AS n_pairs, count(*) FILTER (w <= {EPS}) AS n_links, round(sum(w), 5) AS w_total FROM mutual GROUP BY a""",
    ),
    "k3_spanning_tree": (
        spanning_tree,
        f"""WITH RECURSIVE {PAIRS},{_PRIM} SELECT count(*) AS n_edges, round(sum(w), 5) AS total, round(max(w), 6) AS longest
        FROM (SELECT step, min(best) AS w FROM prim GROUP BY step)""",
    ),
    "k4_flat_cut": (
        flat_cut,
        f"""WITH RECURSIVE {PAIRS},
        links AS (SELECT a, b FROM pairs JOIN core x ON x.vec_id = a JOIN core y ON y.vec_id = b
          WHERE greatest(d, x.core, y.core) <= {EPS}),
        reach AS (SELECT vec_id AS node, vec_id AS low FROM core WHERE core <= {EPS}
          UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.node)
        SELECT c.vec_id, coalesce(min(r.low), -1) AS component FROM core c LEFT JOIN reach r ON r.node = c.vec_id GROUP BY c.vec_id""",
    ),
    "k5_condensed_tree": (condensed_tree, None),
    "k6_stable_clusters": (stable_clusters, None),
    "k7_density_labels": (density_labels, None),
    "k7_planted_groups": (
        planted_groups,
        f"""WITH points AS (SELECT vec_id AS id FROM embeddings),{_PLANTED}
        SELECT id AS vec_id, coalesce(cluster_id, -1) AS cluster_id, coalesce(cluster_id, -1) >= 0 AS inside
        FROM points LEFT JOIN numbered ON id % {GROUPS} = g""",
    ),
    "h22_extract_json": (extract_json, f"WITH {_RESPONSES},{_EXTRACTED} SELECT cluster_id, json FROM extracted"),
    "h23_parse_responses": (
        parse_responses,
        f"""SELECT event_id AS cluster_id, event_id % 5 < 3 AS valid, CASE WHEN event_id % 5 < 3 THEN 'high' END AS priority,
        CASE WHEN event_id % 5 < 3 THEN 'Summary of case ' || event_id || ' in full' END AS summary FROM events""",
    ),
    "b14_recommendation_checks": (
        recommendation_checks,
        """WITH s AS (SELECT event_id % 5 AS k FROM events), p AS (SELECT * FROM (VALUES (3, 'not an object'), (3, 'summary length'),
        (3, 'threat_assessment length'), (3, 'relevant_playbooks not a list of texts'), (3, 'immediate_actions not a list of texts'),
        (3, 'investigation_steps not a list of texts'), (3, 'mitre_techniques not a list of texts'), (3, 'immediate_actions count'),
        (3, 'investigation_steps count'), (3, 'priority unknown'), (4, 'missing key'), (4, 'priority unknown')) t(k, problem))
        SELECT problem, count(*) AS n FROM s JOIN p USING (k) GROUP BY problem""",
    ),
    "d11_usage_totals": (
        usage_totals,
        """SELECT sum(event_id % 700)::BIGINT AS total_tokens_in, sum(event_id % 90)::BIGINT AS total_tokens_out,
        round(sum((event_id % 16) / 1024.0::DOUBLE) FILTER (event_id % 4 <> 0), 6) AS total_cost_usd FROM events""",
    ),
    "c10_incident_assembly": (
        incident_assembly,
        f"""WITH {MEMBERS},{PROFILE},{_RESULT} SELECT cluster_id, cluster_size, priority, CASE WHEN ok THEN 'Summary of case ' || k
        || ' in full' ELSE {_FALLBACK.replace('{e}', "'InvalidResponse'")} END AS summary, NOT ok AS recommendation_unavailable,
        0 AS n_playbooks FROM result""",
    ),
    "h26_playbook_override": (
        playbook_override,
        f"""WITH {INCIDENT_SQL},{PLAYBOOKS},{FETCHED},{BOOSTED},{_RESULT},
        f AS (SELECT qid, count(DISTINCT split_part(id, '::', 1))::INT AS n FROM boosted GROUP BY qid)
        SELECT cluster_id, NOT ok AS recommendation_unavailable, CASE WHEN ok THEN n ELSE 0 END AS n_playbooks
        FROM result JOIN f ON qid = cluster_id""",
    ),
    "h24_fallback": (
        fallback_texts,
        f"""WITH {MEMBERS},{PROFILE} SELECT cluster_id, {_FALLBACK.replace('{e}', "'TimeoutError'")} AS summary,
        {_ASSESSED} AS threat_assessment, {_ACTIONS} AS actions, {_STEPS} AS steps, priority FROM profile""",
    ),
    "h25_skipped": (
        skipped_texts,
        f"""WITH {MEMBERS},{PROFILE} SELECT cluster_id, {_HEADLINE} || 'advice switched off.' AS summary,
        'skipped_by_user' AS fallback_reason, true AS recommendation_unavailable FROM profile""",
    ),
    "h21_prompts": (
        prompts,
        f"""WITH {INCIDENT_SQL},{PLAYBOOKS},{FETCHED},{BOOSTED},{PLAYBOOK_BLOCKS},{TEXT_BLOCKS}
        SELECT cluster_id, '# Incident to assess\n\n- cluster: ' || cluster_id || '\n- events: ' || cluster_size
        || '\n- first and last event: ' || strftime(time_start, '%Y-%m-%dT%H:%M:%S.%f') || ' to ' || strftime(time_end, '%Y-%m-%dT%H:%M:%S.%f')
        || ' (' || {span_sql('time_start', 'time_end')} || ')\n- main event type: ' || dominant_event_type
        || '\n- distinct sources: ' || unique_src_ips || '\n- distinct users: ' || unique_users_targeted
        || '\n\n## Classes\n\n' || classes || '\n\n## Severities\n\n' || severities || '\n\n## Typical events\n\n' || samples
        || '\n\n## Playbook sections\n\n' || block || '\n\n## Answer\n\n' || '{rc.answer_rules()}' AS prompt
        FROM profile JOIN blocks USING (cluster_id) JOIN playbook_blocks USING (cluster_id)""",
    ),
    "d14_run_stats": (
        run_stats,
        f"""WITH {MEMBERSHIP},{_USAGE} SELECT (SELECT count(*) FROM membership) AS total_logs, clusters AS n_clusters,
        (SELECT count(*) FROM membership WHERE cluster_id = -1) AS n_noise, t_in::BIGINT AS total_tokens_in,
        t_out::BIGINT AS total_tokens_out, round(cost::DOUBLE, 6) AS total_cost_usd, 0.0::DOUBLE AS cache_hit_rate,
        'model-a' AS model, 'run0' AS run_id FROM usage""",
    ),
    "d15_by_priority": (
        by_priority,
        f"""WITH {MEMBERS},{PROFILE},{_RESULT} SELECT priority, count(*) AS n, count(*) FILTER (NOT ok) AS n_fallback FROM result
        GROUP BY priority""",
    ),
    "a12_summary_table": (
        summary_table,
        f"""WITH {MEMBERS},{PROFILE},{_RESULT},{_USAGE} SELECT 0 AS position, 'Total logs' AS metric,
        (SELECT count(*) FROM membership)::VARCHAR AS value
        UNION ALL SELECT 1, 'Incidents', count(*)::VARCHAR FROM result
        UNION ALL SELECT 2, 'Noise points', count(*)::VARCHAR FROM membership WHERE cluster_id = -1
        UNION ALL SELECT 3, 'Cache hit rate', '0.0%'
        UNION ALL SELECT 4, 'Model cost', '$' || printf('%.4f', round_even(cost::DOUBLE, 4)) || ' (' || t_in::BIGINT || '→' || t_out || ' tokens)' FROM usage
        UNION ALL SELECT 5, 'Fallback recommendations', count(*)::VARCHAR FROM result WHERE NOT ok
        UNION ALL SELECT 6 + {_PRIORITY_RANK}, 'Priority ' || priority, count(*)::VARCHAR FROM result GROUP BY priority""",
    ),
    "e9_incident_order": (
        incident_order,
        f"""WITH {MEMBERS},{PROFILE},{_RESULT} SELECT cluster_id, priority, cluster_size FROM result
        ORDER BY {_PRIORITY_RANK}, cluster_size DESC, cluster_id""",
    ),
    "a11_markdown_report": (markdown_report, None),
    "a10_json_report": (json_report, None),
    "a10_run_report": (
        run_report,
        f"""WITH {MEMBERS},{PROFILE},{_RESULT},{_USAGE}, ordered AS (
          SELECT cluster_id, cluster_size, priority, row_number() OVER (ORDER BY
            list_position(['critical', 'high', 'medium', 'low', 'informational'], priority), cluster_size DESC, cluster_id) AS place
          FROM result)
        SELECT place > 1 AS comma, '' AS run_id, cluster_id, cluster_size, priority, NULL AS total_logs, NULL AS n_clusters FROM ordered
        UNION ALL SELECT false, 'run0', NULL, NULL, NULL, NULL, NULL
        UNION ALL SELECT false, '', NULL, NULL, NULL, (SELECT count(*) FROM membership), clusters FROM usage""",
    ),
    "p1_full_analysis": (
        full_analysis,
        f"""WITH {LOGS}, points AS (SELECT log_idx AS id FROM logs),{_PLANTED},
        members AS (SELECT l.* REPLACE (description || ' case ' || log_idx AS description), cluster_id
          FROM logs l JOIN numbered ON log_idx % {GROUPS} = g WHERE cluster_id >= 0),{SCORED},{PROFILE}
        SELECT p.cluster_id, cluster_size, dominant_event_type, max_severity, priority, least(cluster_size, {REPRESENTATIVES})::INT AS n_samples,
          least(c.n, {DOMINANT_CLASSES})::INT AS n_classes, 'skipped_by_user' AS fallback_reason
        FROM profile p JOIN (SELECT cluster_id, count(DISTINCT label) AS n FROM members JOIN scored USING (log_idx) GROUP BY cluster_id) c USING (cluster_id)""",
    ),
}
