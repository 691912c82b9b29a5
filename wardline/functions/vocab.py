"""Fixed vocabularies of the domain.  Fixed values: names and order are part of every result."""

SEVERITIES = ["info", "low", "medium", "high", "critical"]

DISPOSITIONS = ["incomplete", "benign", "suspicious", "malicious"]

# kill-chain order
TACTICS = [
    "initial-access",
    "execution",
    "persistence",
    "privilege-escalation",
    "defense-evasion",
    "credential-access",
    "discovery",
    "lateral-movement",
    "collection",
    "command-and-control",
    "exfiltration",
    "impact",
]

POLARITIES = ["supports", "refutes"]

CASE_STATUSES = ["open", "investigating", "escalated", "closed", "reopened"]

OPEN_STATUSES = ["open", "investigating", "escalated"]

RESPONSE_KINDS = ["isolate_host", "disable_account", "revoke_session", "block_indicator", "quarantine_file"]

DECISIONS = ["approved", "modified", "rejected"]

KNOWN_PREDICATES = [
    "AUTH_FAILED_BURST",
    "AUTH_SUCCEEDED_AFTER_FAILURES",
    "AUTH_FROM_NEW_ASN",
    "TOKEN_REPLAYED",
    "TRAVEL_IMPOSSIBLE",
    "INTERPRETER_SPAWNED_BY",
    "ENCODED_COMMAND",
    "INTERPRETER_NETWORK_EGRESS",
    "CONNECTED_TO_INDICATOR",
    "RDP_INTERNAL_FIRST_TIME",
    "PERSISTENCE_INSTALLED",
]

ASSET_GROUPS = {
    "ci-runners": ["198.51.100.9"],
    "corporate-egress": ["203.0.113.44"],
}

INT64_MAX = 2**63 - 1
INT64_MIN = -(2**63)
