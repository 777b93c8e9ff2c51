"""Recommendations: prompts, response parsing and checks, fallbacks, placeholders, usage totals."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import fields as fx
from emberline.functions import text as tx
from emberline.operators.retrieve import first_seen_sources
from emberline.schema import (
    LIST_SIZE, OPEN_LISTS, PRIORITIES, RECOMMENDATION_DDL, RECOMMENDATION_FIELDS, SIZED_LISTS, SIZED_TEXTS, TEXT_LENGTH,
)

_STRUCT = f"struct<{', '.join(p.replace(' ', ':', 1) for p in RECOMMENDATION_DDL.split(', '))}>"


def answer_rules() -> str:
    """What ``parse_responses`` accepts, told to the model."""
    sized = [f'"{f}": text of {TEXT_LENGTH[0]} to {TEXT_LENGTH[1]} characters' for f in SIZED_TEXTS]
    lists = [f'"{f}": list of {LIST_SIZE[0]} to {LIST_SIZE[1]} texts' for f in SIZED_LISTS]
    free = [f'"{f}": list of texts, may be empty' for f in OPEN_LISTS]
    rules = [*sized, *lists, *free, f'"priority": one of {", ".join(PRIORITIES)}']
    return "Return one JSON object with exactly these keys and nothing around it:\n" + "\n".join(f"- {r}" for r in rules)


def incident_prompt() -> Column:
    """Prompt text of a profile row with ``dominant_classes``, ``representative_logs`` and ``playbook_chunks``."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    facts = F.concat(
        F.lit("# Incident to assess\n\n- cluster: "), F.col("cluster_id").cast("string"),
        F.lit("\n- events: "), F.col("cluster_size").cast("string"),
        F.lit("\n- first and last event: "), iso("time_start"), F.lit(" to "), iso("time_end"),
        F.lit(" ("), tx.time_span(F.col("time_start"), F.col("time_end")), F.lit(")"),
        F.lit("\n- main event type: "), F.col("dominant_event_type"),
        F.lit("\n- distinct sources: "), F.col("unique_src_ips").cast("string"),
        F.lit("\n- distinct users: "), F.col("unique_users_targeted").cast("string"),
    )
    return F.concat_ws(
        "\n\n", facts, F.lit("## Classes"), tx.class_table(F.col("dominant_classes")),
        F.lit("## Severities"), tx.severity_lines(F.col("severity_breakdown")),
        F.lit("## Typical events"), tx.sample_rows(F.col("representative_logs")),
        F.lit("## Playbook sections"), tx.playbook_block(F.col("playbook_chunks")),
        F.lit("## Answer\n\n" + answer_rules()),
    )


@dataclass(frozen=True)
class Attempt:
    """One model response; a failed call has an error text and no response."""

    response: str | None
    error: str | None = None
    tokens_in: int = 0
    tokens_out: int = 0
    cost_usd: float | None = None


class Generator(Protocol):
    """Pluggable text generator; one instance per Python task. Several attempts per prompt are allowed."""

    model_id: str

    def generate(self, prompt: str) -> list[Attempt]: ...


_ATTEMPTS = (
    "cluster_id bigint, attempt int, response string, error string, tokens_in bigint, tokens_out bigint, cost_usd double"
)


def generate(prompts: DataFrame, factory: Callable[[], Generator]) -> DataFrame:
    """One row per attempt for (cluster_id, prompt) rows; an exception becomes an error row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in batches:
            rows = []
            for cluster, prompt in zip(pdf["cluster_id"], pdf["prompt"]):
                try:
                    tries = model.generate(prompt)
                except Exception as e:  # noqa: BLE001 - any model failure falls back
                    tries = [Attempt(None, f"{type(e).__name__}: {e}")]
                for i, t in enumerate(tries):
                    rows.append((cluster, i, t.response, t.error, t.tokens_in, t.tokens_out, t.cost_usd))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _ATTEMPTS.split(", ")])

    return prompts.select(F.col("cluster_id").cast("bigint").alias("cluster_id"), "prompt").mapInPandas(run, _ATTEMPTS)


def usage_totals(attempts: DataFrame) -> DataFrame:
    """Token and cost totals over all attempts, invalid ones too; a missing cost counts as 0."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return attempts.agg(
        total("tokens_in").alias("total_tokens_in"), total("tokens_out").alias("total_tokens_out"),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("total_cost_usd"),
    )


def _checked(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Parse one JSON text column; adds ``<prefix>rec`` and ``<prefix>errors``."""
    opened = df.selectExpr("*", f"try_variant_get(try_parse_json({text}), '$', 'map<string,variant>') AS _m")
    known = f"array({fx.quoted(RECOMMENDATION_FIELDS)})"
    texts, lists = ("summary", "threat_assessment", "priority"), (
        "relevant_playbooks", "immediate_actions", "investigation_steps", "mitre_techniques",
    )
    # schema_of_variant on list items keeps numbers from passing as text.
    values = [
        f"CASE WHEN schema_of_variant(_m['{f}']) = 'STRING' THEN try_variant_get(_m['{f}'], '$', 'string') END AS _{f}"
        for f in texts
    ] + [f"try_variant_get(_m['{f}'], '$', 'array<variant>') AS _{f}" for f in lists]
    read = opened.selectExpr(*[c for c in df.columns], "_m", *values)
    problems = [
        ("_m IS NULL", "not an object"),
        (f"size(array_except(map_keys(_m), {known})) > 0", "unknown key"),
        (f"size(array_except({known}, map_keys(_m))) > 0", "missing key"),
    ]
    for f in SIZED_TEXTS:
        problems.append((f"NOT coalesce(length(_{f}) BETWEEN {TEXT_LENGTH[0]} AND {TEXT_LENGTH[1]}, false)", f"{f} length"))
    for f in lists:
        problems.append((f"NOT coalesce(forall(_{f}, x -> schema_of_variant(x) = 'STRING'), false)", f"{f} not a list of texts"))
    for f in SIZED_LISTS:
        problems.append((f"NOT coalesce(size(_{f}) BETWEEN {LIST_SIZE[0]} AND {LIST_SIZE[1]}, false)", f"{f} count"))
    problems.append((f"{fx.enum_member('_priority', PRIORITIES)} IS NULL", "priority unknown"))
    errors = ", ".join(f"CASE WHEN {bad} THEN '{told}' END" for bad, told in problems)
    parts = []
    for f in RECOMMENDATION_FIELDS:
        if f == "priority":
            parts.append(f"'priority', {fx.enum_member('_priority', PRIORITIES)}")
        elif f in texts:
            parts.append(f"'{f}', _{f}")
        else:
            parts.append(f"'{f}', transform(_{f}, x -> try_variant_get(x, '$', 'string'))")
    return read.selectExpr(
        *df.columns,
        # As in the row checks, naming the partition keeps a filter on the errors, also one that an explode brings, above
        # this projection: pushed below, the whole list would be inlined and the text parsed for each mention of a key.
        f"CASE WHEN spark_partition_id() >= 0 THEN array_compact(array({errors})) END AS {prefix}errors",
        f"cast(named_struct({', '.join(parts)}) AS {_STRUCT.replace(':', ': ')}) AS {prefix}rec",
    )


def parse_responses(attempts: DataFrame, text: str = "response") -> DataFrame:
    """Adds ``rec`` (null when invalid) and ``rec_errors``: the raw text is tried first, then the extracted JSON."""
    raw = _checked(attempts, f"`{text}`", "_r_")
    both = _checked(raw.withColumn("_x", tx.extract_json(F.col(text))), "_x", "_e_")
    ok_raw, ok_cut = F.size("_r_errors") == 0, F.size("_e_errors") == 0
    return both.withColumn(
        "rec", F.when(ok_raw, F.col("_r_rec")).when(ok_cut, F.col("_e_rec"))
    ).withColumn(
        "rec_errors", F.when(ok_raw | ok_cut, F.expr("cast(array() AS ARRAY<STRING>)")).otherwise(F.col("_e_errors"))
    ).select(*attempts.columns, "rec", "rec_errors")


def _struct(summary: Column) -> Column:
    """Recommendation that follows from the profile alone: what was counted, who has to look, and where to look first."""
    count = lambda c, one, many: F.concat(F.col(c).cast("string"), F.when(F.col(c) == 1, one).otherwise(many))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    named = F.concat(F.lit("cluster "), F.col("cluster_id").cast("string"))
    facts = F.concat(
        F.lit("Rule-based: peak severity "), F.col("max_severity"), F.lit(" sets priority "), F.col("priority"), F.lit("; "),
        count("unique_src_ips", " source address and ", " source addresses and "),
        count("unique_users_targeted", " account seen.", " accounts seen."),
    )
    urgent = F.col("priority").isin(PRIORITIES[:2])
    action = F.when(urgent, F.concat(F.lit("Page the on-call responder for "), named)).otherwise(
        F.concat(F.lit("Queue "), named, F.lit(" for the next triage slot"))
    )
    steps = F.array_compact(F.array(
        F.concat(F.lit("Pull all "), F.col("dominant_event_type"), F.lit(" logs from "), iso("time_start"), F.lit(" to "), iso("time_end")),
        F.when(F.col("unique_src_ips") > 0, F.lit("Trace the source addresses of the cluster in neighbouring log feeds")),
        F.when(F.col("unique_users_targeted") > 0, F.lit("Check recent sign-ins and rights of the accounts in the cluster")),
    ))
    none = F.expr("cast(array() AS ARRAY<STRING>)")
    values = {
        "summary": summary, "threat_assessment": facts, "relevant_playbooks": none, "immediate_actions": F.array(action),
        "investigation_steps": steps, "mitre_techniques": none, "priority": F.col("priority"),
    }
    return F.struct(*[values[f].alias(f) for f in RECOMMENDATION_FIELDS])


def _headline(why: Column) -> Column:
    return F.concat(
        F.col("dominant_event_type"), F.lit(" cluster "), F.col("cluster_id").cast("string"), F.lit(": "),
        F.col("cluster_size").cast("string"), F.lit(" events over "), tx.time_span(F.col("time_start"), F.col("time_end")),
        F.lit("; "), why, F.lit("."),
    )


def fallback_recommendation(error_name: Column) -> Column:
    """Recommendation made from profile columns after a failed generation."""
    return _struct(_headline(F.concat(F.lit("advice missing ("), error_name, F.lit(")"))))


def skipped_recommendation() -> Column:
    """Recommendation made from profile columns for runs without a generator."""
    return _struct(_headline(F.lit("advice switched off")))


def without_recommendations(profiles: DataFrame) -> DataFrame:
    return profiles.select(
        "*", skipped_recommendation().alias("recommendation"), F.lit(True).alias("recommendation_unavailable"),
        F.lit("skipped_by_user").alias("fallback_reason"),
    )


def with_recommendations(profiles: DataFrame, attempts: DataFrame) -> DataFrame:
    """Incidents from the first valid attempt per cluster, or the fallback with its reason.

    Retrieved source files replace the cited playbooks, but only when something was retrieved.
    """
    parsed = parse_responses(attempts)
    told = F.coalesce("error", F.concat(F.lit("InvalidResponse: "), F.array_join("rec_errors", "; ")))
    valid = F.when(F.col("rec").isNotNull(), F.col("attempt"))
    chosen = parsed.groupBy("cluster_id").agg(
        F.min_by("rec", valid).alias("rec"), F.max_by(told, F.col("attempt")).alias("last_error")
    )
    joined = profiles.join(chosen, "cluster_id", "left")
    reason = F.coalesce("last_error", F.lit("NoResponse: the generator returned nothing"))
    sources = first_seen_sources("playbook_chunks")
    kept = F.col("rec").withField(
        "relevant_playbooks", F.when(F.size(sources) > 0, sources).otherwise(F.col("rec.relevant_playbooks"))
    )
    failed = F.col("rec").isNull()
    return joined.select(
        *profiles.columns,
        F.when(failed, fallback_recommendation(F.split_part(reason, F.lit(":"), F.lit(1)))).otherwise(kept).alias("recommendation"),
        failed.alias("recommendation_unavailable"), F.when(failed, reason).alias("fallback_reason"),
    )
