"""Sample policy versions, once as rows for Spark and once as VALUES for DuckDB."""

from __future__ import annotations

from ..operators.adjudicate import Policy, policy_from_rows

KERNEL = "1.0.0"

# predicate: tactic, weight in v1, weight in v2, techniques
PRICES = {
    "AUTH_FAILED_BURST": ("credential-access", 2000, 2500, ["T1110.001"]),
    "AUTH_SUCCEEDED_AFTER_FAILURES": ("credential-access", 1000, 1000, ["T1078"]),
    "AUTH_FROM_NEW_ASN": ("initial-access", 800, 1200, ["T1078"]),
    "TOKEN_REPLAYED": ("credential-access", 1500, 1500, ["T1550.001"]),
    "TRAVEL_IMPOSSIBLE": ("initial-access", 1800, 1800, ["T1078"]),
    "INTERPRETER_SPAWNED_BY": ("execution", 1500, 1500, ["T1059.001"]),
    "ENCODED_COMMAND": ("execution", 1500, 900, ["T1059.001", "T1027"]),
    "INTERPRETER_NETWORK_EGRESS": ("command-and-control", 2000, 2000, ["T1071.001"]),
    "CONNECTED_TO_INDICATOR": ("command-and-control", 0, 0, ["T1071.001"]),
    "RDP_INTERNAL_FIRST_TIME": ("lateral-movement", 1700, 1700, ["T1021.001"]),
    "PERSISTENCE_INSTALLED": ("persistence", 2200, 2600, ["T1547.001"]),
}

CHAINS = [
    ("initial-access", "execution", 400, 500),
    ("execution", "persistence", 700, 900),
    ("credential-access", "lateral-movement", 5000, 5000),  # two steps apart: never applies
    ("command-and-control", "exfiltration", 600, 600),
]

TIERS = [("info", 0, 0), ("low", 1000, 1500), ("medium", 3000, 3500), ("high", 5000, 5500), ("critical", 8000, 9000)]

VERSIONS = ["policy.v1", "policy.v2"]

WEIGHT_ROWS = [(v, p, t, w[i], tech) for i, v in enumerate(VERSIONS) for p, (t, *w, tech) in PRICES.items()]
CHAIN_ROWS = [(v, a, b, w[i]) for i, v in enumerate(VERSIONS) for a, b, *w in CHAINS]
TIER_ROWS = [(v, pos, w[i], s) for i, v in enumerate(VERSIONS) for pos, (s, *w) in enumerate(TIERS)]


def sample_policy(spark) -> Policy:
    return policy_from_rows(spark, WEIGHT_ROWS, CHAIN_ROWS, TIER_ROWS)


def _value(v) -> str:
    if isinstance(v, str):
        return f"'{v}'"
    if isinstance(v, list):
        return "[" + ", ".join(_value(x) for x in v) + "]"
    return str(v)


def values(rows, name: str, columns: str) -> str:
    body = ", ".join("(" + ", ".join(_value(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) as (values {body})"


POLICY = ",\n  ".join(
    [
        values(WEIGHT_ROWS, "weights", "policy_version, predicate, tactic, weight, techniques"),
        values(CHAIN_ROWS, "chains", "policy_version, from_tactic, to_tactic, bonus"),
        values(TIER_ROWS, "tiers", "policy_version, position, threshold, severity"),
    ]
)
