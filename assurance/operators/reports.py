"""Reports for owners: verdicts in plain words, attribution, briefings, validation of proposals and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assurance import config as C

# Headlines by route, charters of the two supervisors, and what a proposal may hold.
HEADLINES = {"pass": "Released as written", "repair": "Released after a repair", "escalate": "Needs a person", "block": "Not released"}
COST_DETECTORS = ("cost",)
PROPOSAL_KEYS = ("answer", "declared_action", "source_ids", "tool_id")
MOST_ANSWER, MOST_SOURCES, MOST_ID = 8000, 8, 128
BUDGET_CEILING = 100_000_000.0


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(v))))


def plain_verdict(decided: DataFrame) -> DataFrame:
    """(request_id, headline, reasons, next_step) (P14): at most three reasons, the first that hold, and one action."""
    reasons = [
        (F.col("denied").isNotNull(), F.concat(F.lit("refused: "), F.col("denied"))),
        (~F.col("tier_met"), F.lit("the evidence is too weak for this action")),
        (F.col("fail_closed"), F.lit("a required check did not finish")),
        (F.col("price") >= F.col("t_escalate"), F.concat(F.lit("risk price "), F.col("price").cast("string"))),
        (F.size("labels") > 0, F.concat(F.lit("found: "), F.array_join("labels", ", "))),
        (~F.col("fully_governed"), F.lit("not every check was completed")),
    ]
    found = F.slice(F.array_compact(F.array(*(F.when(ok, text) for ok, text in reasons))), 1, 3)
    step = F.when(F.col("final_route") == "block", "correct the request or ask its owner").when(F.col("final_route") == "escalate", "a reviewer decides").otherwise("nothing to do")
    return decided.select("request_id", _map(HEADLINES)[F.col("final_route")].alias("headline"), F.array_join(found, "; ").alias("reasons"), step.alias("next_step"))


def attribution(results: DataFrame, decided: DataFrame) -> DataFrame:
    """(request_id, cost_findings, safety_findings, decided_by, rule) (P15): which charter saw what, and which of three rules settled it."""
    found = F.size("labels") > 0
    cost = F.col("detector_id").isin(*COST_DETECTORS)
    g = results.groupBy("request_id").agg(F.count_if(found & cost).alias("cost_findings"), F.count_if(found & ~cost).alias("safety_findings"))
    j = g.join(decided.select("request_id", "denied"), "request_id")
    rule = F.when(F.col("denied").isNotNull(), "registry").when(F.col("safety_findings") > 0, "safety_first").when(F.col("cost_findings") > 0, "cost_alone").otherwise("none")
    return j.select("request_id", "cost_findings", "safety_findings", _map({"registry": "registry", "safety_first": "safety", "cost_alone": "cost", "none": "nobody"})[rule].alias("decided_by"), rule.alias("rule"))


def validate_proposals(raw: DataFrame) -> DataFrame:
    """(request_id, reason) (P16): null for a proposal that is accepted; nothing is repaired.

    raw: (request_id, payload). The keys are checked as a set on a map, the values by a typed read.
    """
    keys = F.map_keys(F.from_json("payload", "map<string,string>"))
    v = F.from_json("payload", "struct<answer:string,declared_action:string,source_ids:array<string>,tool_id:string>")
    x = raw.select("request_id", keys.alias("keys"), v.alias("v"))
    wanted = F.array(*map(F.lit, PROPOSAL_KEYS))
    ids = F.col("v.source_ids")
    reason = (
        F.when(F.col("keys").isNull(), "unreadable")
        .when(F.size(F.array_except(wanted, "keys")) > 0, F.concat(F.lit("missing "), F.array_join(F.array_sort(F.array_except(wanted, "keys")), ",")))
        .when(F.size(F.array_except("keys", wanted)) > 0, F.concat(F.lit("unknown "), F.array_join(F.array_sort(F.array_except("keys", wanted)), ",")))
        .when(F.char_length("v.answer") > MOST_ANSWER, "answer too long")
        .when((F.size(ids) > MOST_SOURCES) | (F.size(ids) != F.size(F.array_distinct(ids))) | F.exists(ids, lambda i: F.char_length(i) > MOST_ID), "source ids")
        .when(~F.col("v.declared_action").isin(*(a for a, _, _, _ in C.ACTIONS)), "unknown action")
    )
    return x.select("request_id", reason.alias("reason"))


def briefing(cards: DataFrame, advice: DataFrame) -> DataFrame:
    """(system_id, status, spend, n_high, advice, subject) (B1, B2): cards with their advice by severity, and the subject line."""
    rank = F.when(F.col("severity") == "high", 1).otherwise(2)
    a = advice.groupBy("system_id").agg(F.count_if(F.col("severity") == "high").alias("n_high"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(rank.alias("r"), "rule_ord", "rule"))).alias("rules"))
    b = cards.join(a, "system_id", "left")
    high, n = F.coalesce("n_high", F.lit(0)), F.coalesce("n", F.lit(0))
    subject = F.when(F.col("reason") == "over budget", "budget exhausted").when(high > 0, F.format_string("%d urgent", high)).when(n > 0, F.format_string("%d to look at", n)).otherwise("all clear")
    return b.select("system_id", "status", "spend", high.alias("n_high"), F.coalesce(F.array_join(F.transform("rules", lambda r: r["rule"]), ","), F.lit("")).alias("advice"), subject.alias("subject"))


def forecast_sentence(forecast: DataFrame) -> DataFrame:
    """(system_id, sentence)."""
    days = F.format_string("%d", F.floor("days_left"))
    s = F.when(F.col("state") == "too_early", "Too early in the month to say.").when(F.col("state") == "exhausted", "The month's budget is spent.").when(F.col("state") == "steady", "The budget lasts past this week.").otherwise(F.concat(F.lit("The budget lasts "), days, F.lit(" days, until "), F.col("exhausted_on"), F.lit(".")))
    return forecast.select("system_id", s.alias("sentence"))


def explain_policy(systems: DataFrame, profiles: DataFrame, jurisdictions: DataFrame) -> DataFrame:
    """(system_id, threshold, base, jurisdiction_delta, resolved) (B4): one row for each threshold, side by side."""
    s = systems.join(F.broadcast(profiles), "profile").join(F.broadcast(jurisdictions), "jurisdiction", "left")
    rows = [F.struct(F.lit(t).alias("threshold"), F.col(f"t_{t}").alias("base"), F.coalesce(f"d_{t}", F.lit(0)).alias("jurisdiction_delta"), F.greatest(F.lit(1), F.col(f"t_{t}") - F.coalesce(f"d_{t}", F.lit(0))).alias("resolved")) for t in ("pass", "repair", "escalate")]
    return s.select("system_id", F.inline(F.array(*rows)))


def transcript(turns: DataFrame, decided: DataFrame, held: DataFrame) -> DataFrame:
    """turns beside the present state of their decision or held question."""
    j = turns.join(decided.select("request_id", "final_route"), "request_id", "left").join(held.select("request_id", F.col("status").alias("held_status")), "request_id", "left")
    return j.withColumn("state", F.coalesce("held_status", "final_route", F.lit("open"))).drop("held_status", "final_route")


def validate_changes(changes: DataFrame) -> DataFrame:
    """changes (change_id, budget, owner, address) with reason, null if accepted."""
    b = F.col("budget")
    reason = (
        F.when(b.isNull() | F.isnan(b) | (F.abs(b) == float("inf")), "budget is not a number")
        .when(b <= 0, "budget is not positive")
        .when(b > BUDGET_CEILING, "budget is over the ceiling")
        .when(~F.char_length(F.trim("owner")).between(1, 80), "owner")
        .when(~F.col("address").rlike(r"^[\w.+-]+@[\w-]+\.[A-Za-z]{2,}$"), "address")
    )
    return changes.withColumn("reason", reason)


def verification(results: DataFrame) -> DataFrame:
    """(request_id, state) (M25): what can be said of an answer from the checks that ran."""
    ran = F.col("status").isin("completed", "completed_async")
    ground = F.col("detector_id") == "grounding"
    g = results.groupBy("request_id").agg(F.bool_or(ran & ground).alias("checked"), F.max(F.when(ran & ground, F.col("score"))).alias("score"), F.bool_or(ran & ground & F.array_contains("labels", "unverifiable")).alias("unverifiable"))
    state = F.when(~F.col("checked"), "not_checked").when(F.col("unverifiable"), "unverified").when(F.col("score") == 0, "verified").when(F.col("score") < 0.55, "partly_verified").otherwise("contradicted")
    return g.select("request_id", state.alias("state"))
