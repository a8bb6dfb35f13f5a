"""The route ladder, the evidence floor, side effects, policy comparison, replay and amendment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assurance import config as C
from assurance.operators import scoring
from assurance.operators.corpus import few

#: Findings about the text that route by themselves, and how the views derive them.
FLAGS = {"toxic": "k = 97", "omitted": "k % 17 = 3", "unserved": "k % 19 = 4", "overconfident": "k % 23 = 5", "judge_failed": "k % 29 = 6", "contradiction": "k % 31 = 7", "abstained": "k % 37 = 8", "redactable": "k % 2 = 0"}
UNVERIFIABLE = "array_contains(labels, 'unverifiable')"


def ladder(unverifiable: str, has: str, gate: str) -> list[tuple[str, str, str]]:
    """(condition, route, rule) in the order that decides; conditions are SQL over the joined columns."""
    under = "price < t_escalate"
    return [
        ("denied IS NOT NULL", "block", "capability"),
        ("toxic", "block", "toxic_answer"),
        ("fail_closed", "block", "governance"),
        (f"{gate} AND ({unverifiable} OR price >= t_escalate)", "block", "hard_gate"),
        ("mismatch AND effective IN ('decide', 'execute')", "block", "mismatch"),
        ("approval", "escalate", "approval"),
        (f"omitted AND {under}", "escalate", "omitted_condition"),
        (f"unserved AND {under}", "escalate", "objective_unserved"),
        (f"overconfident AND {under}", "escalate", "confidently_wrong"),
        (f"judge_failed AND {under}", "escalate", "judge_unavailable"),
        (f"contradiction AND {under}", "escalate", "contradiction"),
        (f"abstained AND NOT {unverifiable} AND {under}", "pass", "declined"),
        (f"price < t_pass AND NOT {unverifiable}", "pass", "clean"),
        (f"(coalesce(dominant, '') = 'privacy' OR {has.format('privacy')}) AND {under} AND redactable", "repair", "redaction"),
        (f"price >= t_pass AND {under} AND NOT {unverifiable} AND {has.format('')}", "pass", "unnamed"),
        (f"price >= t_escalate + {C.BLOCK_MARGIN} AND effective IN ('decide', 'execute')", "block", "irreversible"),
    ]


def _case(rules: list[tuple[str, str, str]], of: int, last: str) -> str:
    return "CASE " + " ".join(f"WHEN {r[0]} THEN '{r[of]}'" for r in rules) + f" ELSE '{last}' END"


RULES = ladder(UNVERIFIABLE, "array_contains(labels, '{}')", "array_contains(hard_gate, effective)")
RULES[14] = (f"price >= t_pass AND price < t_escalate AND NOT {UNVERIFIABLE} AND size(labels) = 0", "pass", "unnamed")
SQL_RULES = ladder("list_contains(labels, 'unverifiable')", "list_contains(labels, '{}')", "list_contains(hard_gate, effective)")
SQL_RULES[14] = ("price >= t_pass AND price < t_escalate AND NOT list_contains(labels, 'unverifiable') AND len(labels) = 0", "pass", "unnamed")


def route(joined: DataFrame) -> DataFrame:
    """joined with route and rule (P7): the first rule that holds decides."""
    return joined.withColumn("rule", F.expr(_case(RULES, 2, "escalated"))).withColumn("route", F.expr(_case(RULES, 1, "escalate")))


def tier(cited: Column) -> Column:
    """Evidence tier (R7): cited documents are authoritative, memory is parametric."""
    return F.when(cited > 0, "authoritative").otherwise("parametric")


def floor(decided: DataFrame) -> DataFrame:
    """decided with tier_met and final_route (P8): evidence under the action's floor blocks whatever the ladder said."""
    need = F.element_at(F.create_map(*(x for k, v in C.NEEDED_TIER.items() for x in (F.lit(k), F.lit(v)))), F.col("effective"))
    have = F.element_at(F.create_map(*(x for k, v in C.TIER_RANK.items() for x in (F.lit(k), F.lit(v)))), F.col("tier"))
    met = have >= need
    return decided.withColumn("tier_met", met).withColumn("final_route", F.when(met, F.col("route")).otherwise("block"))


def side_effect(route_: Column, effective: Column) -> Column:
    """What the world sees."""
    acts = effective.isin(*C.IRREVERSIBLE)
    return (
        F.when(route_ == "block", "withheld")
        .when(route_ == "escalate", F.when(acts, "queued_for_approval").otherwise("released_with_warning"))
        .when(route_ == "repair", F.when(acts, "performed_after_repair").otherwise("released_after_repair"))
        .otherwise(F.when(acts, "performed").otherwise("released"))
    )


def join_evidence(capability: DataFrame, risk: DataFrame, governance: DataFrame, policy: DataFrame) -> DataFrame:
    """One row for each decision with all that the ladder reads; the three large sides share the key request_id."""
    j = capability.join(risk, "request_id").join(governance, "request_id")
    j = j.join(few(policy.select("system_id", "t_pass", "t_repair", "t_escalate", "hard_gate")), "system_id")
    return j.select("*", *(F.expr(v).alias(k) for k, v in FLAGS.items()), tier(F.col("k") % 5).alias("tier"))


DECIDED = (
    "joined AS (SELECT c.*, r.* EXCLUDE (request_id, blast_radius), g.* EXCLUDE (request_id), p.t_pass, p.t_repair, p.t_escalate, p.hard_gate, "
    + ", ".join(f"{v} AS {k}" for k, v in FLAGS.items())
    + ", CASE WHEN k % 5 > 0 THEN 'authoritative' ELSE 'parametric' END AS tier FROM capability c JOIN risk r ON c.request_id = r.request_id JOIN governance g ON c.request_id = g.request_id JOIN policy p ON c.system_id = p.system_id),\n"
    + f"routed AS (SELECT *, {_case(SQL_RULES, 2, 'escalated')} AS rule, {_case(SQL_RULES, 1, 'escalate')} AS route FROM joined),\n"
    + "decided AS (SELECT *, CASE WHEN tier_met THEN route ELSE 'block' END AS final_route FROM (SELECT *, CASE WHEN tier = 'authoritative' THEN 2 ELSE 0 END >= CASE effective WHEN 'read' THEN 0 WHEN 'draft' THEN 0 WHEN 'advise' THEN 1 ELSE 2 END AS tier_met FROM routed))"
)
SIDE_EFFECT_SQL = "CASE WHEN {r} = 'block' THEN 'withheld' WHEN {r} = 'escalate' THEN CASE WHEN effective IN ('decide', 'execute') THEN 'queued_for_approval' ELSE 'released_with_warning' END WHEN {r} = 'repair' THEN CASE WHEN effective IN ('decide', 'execute') THEN 'performed_after_repair' ELSE 'released_after_repair' END WHEN effective IN ('decide', 'execute') THEN 'performed' ELSE 'released' END"


def compare_policies(evidence: DataFrame, variants: DataFrame) -> DataFrame:
    """The same evidence under two sets of thresholds (P11): route_a, route_b and whether they diverge.

    variants: two rows (variant, t_pass, t_escalate) as data; only their thresholds enter the plan, twice.
    """
    both = evidence.drop("t_pass", "t_escalate").join(few(variants))
    both = route(both)
    out = both.groupBy("request_id").agg(F.max(F.when(F.col("variant") == "a", F.col("route"))).alias("route_a"), F.max(F.when(F.col("variant") == "b", F.col("route"))).alias("route_b"))
    return out.withColumn("diverges", F.col("route_a") != F.col("route_b"))


#: What a replay compares, and what a record holds: the evidence, the policy and the capability as they were when the decision fell, and what came out.
OUTCOME = ["dominant", "final_route", "governance", "p_failure", "price", "route", "rule"]
HELD = ["system_id", "k", "effective", "blast_radius", "mismatch", "approval", "denied"]
RECORD = (
    "system_id string, k int, effective string, blast_radius double, mismatch boolean, approval boolean, denied string, "
    "policy struct<weights:map<string,double>,t_pass:int,t_repair:int,t_escalate:int,hard_gate:array<string>>, "
    "evidence array<struct<monitor_ord:int,detector_id:string,status:string,requirement:string,score:double,confidence:double,labels:array<string>>>, "
    "outcome struct<dominant:string,final_route:string,governance:string,p_failure:double,price:int,route:string,rule:string>"
)


def records(capability: DataFrame, results: DataFrame, policy: DataFrame, decided: DataFrame) -> DataFrame:
    """(request_id, record): one JSON line a decision, from which it can be decided again."""
    row = F.struct("monitor_ord", "detector_id", "status", "requirement", "score", "confidence", "labels")
    evidence = results.groupBy("request_id").agg(F.array_sort(F.collect_list(row)).alias("evidence"))
    snapshot = policy.select("system_id", F.struct("weights", "t_pass", "t_repair", "t_escalate", "hard_gate").alias("policy"))
    j = capability.select("request_id", *HELD).join(few(snapshot), "system_id").join(evidence, "request_id", "left").join(decided.select("request_id", F.struct(*OUTCOME).alias("outcome")), "request_id")
    return j.select("request_id", F.to_json(F.struct(*HELD, "policy", "evidence", "outcome")).alias("record"))


def replay(records: DataFrame, folder: str | None = None) -> DataFrame:
    """(request_id, identical, differences) of records (request_id, record) decided again from what they hold alone.

    Policies come from the records, once for each different one, so a policy or a registry
    that has changed since has no say; a record that was changed is named by the fields that differ.
    With a folder that driver and executors share, what the records hold is written there once: the
    sides of the joins read the columns they need, and no record is parsed for each of them.
    """
    # a generator parses a record once; as a projection it would be parsed anew for every field that is read
    x = records.select("request_id", F.inline(F.array(F.from_json("record", RECORD))))
    x = x.withColumn("system_id", F.sha2(F.to_json("policy"), 256))
    if folder:
        x.write.parquet(folder)
        x = x.sparkSession.read.schema(x.schema).parquet(folder)
    policies = x.groupBy("system_id").agg(F.first("policy").alias("p")).select("system_id", "p.*")
    results = x.select("request_id", "system_id", F.inline("evidence"))
    risk, governance = scoring.price(results, policies, x), scoring.govern(results, x)
    again = floor(route(join_evidence(x.drop("policy", "evidence", "outcome"), risk, governance, policies)))
    both = x.select("request_id", "outcome").join(again.select("request_id", F.struct(*OUTCOME).alias("now")), "request_id", "left")
    differ = F.array_compact(F.array(*(F.when(~F.col(f"outcome.{f}").eqNullSafe(F.col(f"now.{f}")), F.lit(f)) for f in OUTCOME)))
    return both.select("request_id", (F.size(differ) == 0).alias("identical"), F.array_join(differ, ",").alias("differences"))
