"""Field lists, enum members and defaults of the log, profile and recommendation rows."""

from __future__ import annotations

# Enum members of the log schema, in rank order where a rank exists.
SEVERITIES = ["info", "low", "medium", "high", "critical", "emergency"]
EVENT_TYPES = ["auth", "firewall", "endpoint", "network", "cloud", "ai", "iot", "ids_alert"]
PRIORITIES = ["critical", "high", "medium", "low", "informational"]
PRIORITY_OF_SEVERITY = {
    "emergency": "critical",
    "critical": "critical",
    "high": "high",
    "medium": "medium",
    "low": "low",
    "info": "informational",
}
PRIORITY_ICONS = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "🔵", "informational": "⚪"}

# Texts that stand for "no value" in address and port fields.
EMPTY_MARKERS = ["", "n/a", "null", "none", "-", "unknown"]

# Fields of a log row by kind.
REQUIRED_TEXT = ["event_id", "description", "raw_log"]
OPTIONAL_TEXT = [
    "user", "action", "object", "protocol", "mac_address", "alert_type",
    "signature_id", "category", "cloud_service", "model_id",
]
IP_FIELDS = ["src_ip", "dst_ip"]
PORT_FIELDS = ["src_port", "dst_port"]
NESTED_TEXT = {"advanced_metadata": ["session_id", "geo_location"], "behavioral_analytics": []}
NESTED_NUMBER = {
    "advanced_metadata": ["risk_score", "confidence"],
    "behavioral_analytics": ["baseline_deviation", "entropy", "frequency_anomaly", "sequence_anomaly"],
}
NESTED_FIELDS = list(NESTED_NUMBER)
KNOWN_FIELDS = [
    *REQUIRED_TEXT, "timestamp", "event_type", "severity",
    *NESTED_FIELDS, *OPTIONAL_TEXT, *IP_FIELDS, *PORT_FIELDS,
]

# Keys of a recommendation, and the sizes that its texts and lists may have.
RECOMMENDATION_FIELDS = [
    "summary", "threat_assessment", "relevant_playbooks", "immediate_actions",
    "investigation_steps", "mitre_techniques", "priority",
]
SIZED_TEXTS, TEXT_LENGTH = ["summary", "threat_assessment"], (10, 2000)
SIZED_LISTS, LIST_SIZE = ["immediate_actions", "investigation_steps"], (1, 15)
OPEN_LISTS = ["relevant_playbooks", "mitre_techniques"]
RECOMMENDATION_DDL = (
    "summary STRING, threat_assessment STRING, relevant_playbooks ARRAY<STRING>, "
    "immediate_actions ARRAY<STRING>, investigation_steps ARRAY<STRING>, "
    "mitre_techniques ARRAY<STRING>, priority STRING"
)

# Defaults of the analysis.
MIN_CLUSTER_SIZE = 5
MIN_SAMPLES = 3
REPRESENTATIVES = 3
DOMINANT_CLASSES = 3
CLASS_TOP_K = 5
RETRIEVE_TOP_K = 5
RETRIEVE_BOOST = 0.3
RETRIEVE_OVER_FETCH = 4
STORED_REJECTS = 10
PREVIEW_CHARS = 200
ERROR_CHARS = 500
TEXT_LIMIT = 2048
BATCH_TEXTS = 512
CHUNK_PREVIEW = 500
