"""Types, closed value sets and the rule dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The closed sets of the data model.
SEVERITIES = ["critical", "high", "medium", "low", "info"]
CONFIDENCES = ["high", "medium", "low"]
STATES = ["disclosed", "opted_out", "published", "retracted", "withdrawn", "withheld"]
GATED = ["critical", "high"]
PUBLISHABLE = ["disclosed", "published", "retracted"]
SHOWN_UNSEEN = ["disclosed", "retracted"]
LABELS = ["true_positive", "false_positive", "unsure"]
PRIVATE_CHANNELS = ["advisory", "email", "security_contact"]
SARIF_LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
WINDOW_DAYS = 90
COLLAPSE_FACTOR = 0.5

SERVER_RECORD = "server_id string, repo_url string, discovered_via string"
FINDING = "server_id string, commit_sha string, rule_id string, severity string, confidence string, location struct<file: string, line: int>, evidence string"
HISTORY = FINDING + ", finding_id string, first_seen timestamp, last_seen timestamp, previous_ids array<string>"
LEDGER = (
    "kind string, server_id string, finding_ids array<string>, finding_id string, channel string, notified_at timestamp, reference string, verified_by string,"
    " acknowledged_at timestamp, fixed_at timestamp, requested_at timestamp, reason string, at timestamp, until timestamp, agreed_at timestamp, note string"
)
ANNOTATION = "entry_id string, label string, reason string, annotator string, seq long"
TREND = "scanned_at string, corpus long, scanned long, findings_found long, findings_published long, withheld long, servers_affected long, by_rule map<string, long>"
CACHE = "key string, probability double, cost_usd double, latency_ms double"
REGISTRY_PAGE = "servers array<struct<server: struct<name: string, repository: struct<url: string>>>>, metadata struct<nextCursor: string>"
FILES = "server_id string, commit_sha string, path string, content binary, size long, is_symlink boolean"

# Rules by id, title, whether a judgement needs the enclosing function.
RULES = [
    ("click", "Click handling", False),
    ("error", "Error handling", True),
    ("purchase", "Purchases", True),
    ("refund", "Refunds (never fires here)", False),
    ("signup", "Sign-up", False),
    ("view", "Views", False),
]


def rule_dimension(spark: SparkSession, rules: list[tuple[str, str, bool]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "rule_id string, title string, needs_enclosing_function boolean")


def state_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in STATES], "disclosure_state string")
