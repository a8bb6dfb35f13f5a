"""The action scale, policy tables, tiers and prices that results depend on, and the registry of the test systems."""

from __future__ import annotations

# Actions by consequence: rank, share of the full blast radius, and whether they can be undone.
ACTIONS = [("read", 0, 0.10, False), ("draft", 1, 0.35, False), ("advise", 2, 0.70, False), ("decide", 3, 0.90, True), ("execute", 4, 1.00, True)]
IRREVERSIBLE = ("decide", "execute")
# Evidence tiers, weakest first, and the rank each action needs.
TIER_RANK = {"parametric": 0, "system_of_record": 1, "authoritative": 2}
NEEDED_TIER = {"read": 0, "draft": 0, "advise": 1, "decide": 2, "execute": 2}
# Policy profiles: thresholds, detector weights, latency budget in ms, inline and deferred detectors, hard-gated actions.
PROFILES = {
    "customer_support": {
        "thresholds": {"pass": 22, "repair": 40, "escalate": 62},
        "weights": {"grounding": 1.0, "privacy": 1.2, "fairness": 0.8, "cost": 0.4, "purpose": 1.1, "adjudication": 1.0, "abstention": 1.2, "certainty": 1.0, "toxicity": 1.4},
        "latency_budget_ms": 800,
        "inline": ["privacy", "grounding", "purpose", "abstention", "certainty", "toxicity"],
        "deferred": ["fairness", "cost"],
        "hard_gate": [],
    },
    "internal_knowledge": {
        "thresholds": {"pass": 38, "repair": 58, "escalate": 78},
        "weights": {"grounding": 1.0, "privacy": 0.9, "fairness": 0.5, "cost": 0.9, "purpose": 0.9, "adjudication": 1.0, "abstention": 1.2, "certainty": 0.9, "toxicity": 1.4},
        "latency_budget_ms": 2500,
        "inline": ["grounding", "purpose", "abstention", "certainty", "toxicity"],
        "deferred": ["privacy", "fairness", "cost"],
        "hard_gate": [],
    },
    "decision_support": {
        "thresholds": {"pass": 12, "repair": 28, "escalate": 44},
        "weights": {"grounding": 1.2, "privacy": 1.1, "fairness": 1.4, "cost": 0.5, "purpose": 1.3, "adjudication": 1.1, "abstention": 1.3, "certainty": 1.3, "toxicity": 1.4},
        "latency_budget_ms": 6000,
        "inline": ["grounding", "privacy", "fairness", "purpose", "abstention", "certainty", "toxicity"],
        "deferred": ["cost"],
        "hard_gate": ["execute"],
    },
}
JURISDICTIONS = {
    "eu": {"delta": {"pass": 6, "repair": 6, "escalate": 14}, "weights": {"privacy": 1.3, "fairness": 1.3}},
    "in": {"delta": {"pass": 3, "repair": 4, "escalate": 4}, "weights": {"privacy": 1.0}},
}
# What review and tokens cost.
REVIEW_MINUTES = {"pass": 0.0, "repair": 0.0, "escalate": 4.0, "block": 8.0}
INR_PER_1K_TOKENS, INR_PER_REVIEW_MINUTE = 0.85, 8.0
# Radius factors, price band, block margin, and periods in seconds.
EXTERNAL_FACTOR, REGULATED_FACTOR = 1.15, 1.2
BAND_WIDTH, BLOCK_MARGIN = 22, 15
SILENT_S, RECOVERING_S, REVIEW_WINDOW_S = 7200, 900, 604800
# Worst case of one turn, which its reservation holds, in minutes and money.
WORST_MINUTES, WORST_SPEND = 8.0, 2.0
# Seconds after which a reservation that nobody released ends, and places of a system's queue of deferred checks.
HOLD_S, QUEUE_SLOTS = 900, 512
# Controls that set a state, the strongest first.
STATE_BY_KIND = [("suspend", "suspended"), ("quarantine", "quarantined"), ("tool_restricted", "tool_restricted")]

#: The registry behind the views of plans.views: one row for each system of the test tables.
SYSTEMS = [
    # system_id, profile, jurisdiction, audience, regulated, environment, max_action, authorised, month budget, minutes a week, spend baseline, review baseline
    ("sys-0", "customer_support", "eu", "external", False, "production", "advise", ["read", "draft", "advise"], 900.0, 4000.0, 10.0, 60.0),
    ("sys-1", "customer_support", "in", "external", True, "production", "execute", ["read", "draft", "advise", "decide", "execute"], 4000.0, 9000.0, 0.0, 0.0),
    ("sys-2", "internal_knowledge", None, "internal", False, "staging", "advise", ["read", "draft", "advise"], 3500.0, 8000.0, 25.0, 30.0),
    ("sys-3", "decision_support", "eu", "internal", True, "production", "execute", ["read", "draft", "advise", "decide", "execute"], 2500.0, 3000.0, 5.0, 10.0),
    ("sys-4", "decision_support", None, "external", False, "production", "decide", ["read", "draft", "advise", "decide"], 5000.0, 12000.0, 0.0, 15.0),
]
SYSTEM_COLUMNS = "system_id string, profile string, jurisdiction string, audience string, regulated boolean, environment string, max_action string, authorised array<string>, budget_inr double, minutes_week double, spend_baseline double, review_baseline double"
#: Tools that a turn may name; their rows are the same for every system.
TOOLS = [
    # tool_id, effective_action, reversible, approval_required, environments, max_amount
    ("none", "read", True, False, ["staging", "production"], None),
    ("lookup", "read", True, False, ["staging", "production"], None),
    ("drafter", "draft", True, False, ["staging", "production"], None),
    ("adviser", "advise", True, False, ["production"], None),
    ("approver", "decide", False, True, ["production"], None),
    ("payer", "execute", False, False, ["staging", "production"], 80.0),
]
TOOL_COLUMNS = "tool_id string, tool_action string, reversible boolean, approval_required boolean, environments array<string>, max_amount double"
NOW = "2024-01-31 00:00:00"


def sql_value(v) -> str:
    """A literal that Spark and DuckDB read alike."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(sql_value, v)) + "]"
    return f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else repr(v)


def values_sql(rows: list[tuple], columns: list[str]) -> str:
    """A SELECT for DuckDB over rows."""
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(sql_value, r)) + ")" for r in rows) + f") AS t({', '.join(columns)})"
