"""Queries over decisions: policy, price, governance, route and what follows from them."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assurance.operators import decide, policy, scoring
from assurance.plans import views as V

QUERIES: dict = {}
SQL: dict[str, str] = {}
BASE = [V.DECISIONS, V.DETECTORS, V.CONTROLS, V.DIMS, policy.CAPABILITY, policy.POLICY]


def with_sql(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def full(select: str, results: str = "v_detector_results", *more: str) -> str:
    return with_sql(select, *BASE, *more, scoring.RISK.format(results=results), scoring.GOVERN.format(results=results), decide.DECIDED)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


class Decisions:
    """The chain of decision tables over one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.turns = V.decisions(spark, sf_dir)
        self.systems, self.tools = V.systems(spark), V.tools(spark)
        self.policy = policy.resolve_policy(self.systems, V.profiles(spark), V.jurisdictions(spark))
        self.capability = policy.resolve_capability(self.turns, self.systems, self.tools)
        self.results = V.detector_results(self.turns)

    def risk(self, results: DataFrame | None = None) -> DataFrame:
        return scoring.price(self.results if results is None else results, self.policy, self.capability)

    def governance(self, results: DataFrame | None = None) -> DataFrame:
        return scoring.govern(self.results if results is None else results, self.capability)

    def joined(self, results: DataFrame | None = None) -> DataFrame:
        return decide.join_evidence(self.capability, self.risk(results), self.governance(results), self.policy)

    def decided(self, results: DataFrame | None = None) -> DataFrame:
        return decide.floor(decide.route(self.joined(results)))


@query("p1_capability", with_sql("SELECT request_id, effective, round_even(blast_radius, 4) AS blast_radius, mismatch, reversible, approval, denied, snapshot FROM capability", *BASE))
def p1(spark, d):
    return Decisions(spark, d).capability.select("request_id", "effective", F.bround("blast_radius", 4).alias("blast_radius"), "mismatch", "reversible", "approval", "denied", "snapshot")


@query(
    "p2_policy",
    with_sql(
        "SELECT p.system_id, profile, t_pass, t_repair, t_escalate, max(CASE WHEN detector_id = 'privacy' THEN weight END) AS w_privacy, max(CASE WHEN detector_id = 'fairness' THEN weight END) AS w_fairness, max(CASE WHEN detector_id = 'grounding' THEN weight END) AS w_grounding, count(*) AS n_decisions FROM v_decisions d JOIN policy p USING (system_id) JOIN policy_weights w ON p.system_id = w.system_id GROUP BY ALL",
        *BASE,
    ).replace("count(*) AS n_decisions", "count(DISTINCT d.request_id) AS n_decisions"),
)
def p2(spark, d):
    x = Decisions(spark, d)
    n = x.turns.groupBy("system_id").agg(F.count("*").alias("n_decisions"))
    w = [F.element_at("weights", F.lit(k)).alias(f"w_{k}") for k in ("privacy", "fairness", "grounding")]
    return n.join(F.broadcast(x.policy), "system_id").select("system_id", "profile", "t_pass", "t_repair", "t_escalate", *w, "n_decisions")


LIVE = "live AS (SELECT d.request_id, d.system_id, d.occurred_at, c.* EXCLUDE (system_id) FROM v_decisions d JOIN v_controls c ON d.system_id = c.system_id AND d.occurred_at >= c.valid_from AND d.occurred_at < c.valid_to + INTERVAL {s} SECOND)"


DAY_LIVE = "day_live AS (SELECT d.request_id, d.system_id, c.* EXCLUDE (system_id) FROM v_decisions d JOIN day_controls c ON d.system_id = c.system_id AND d.occurred_at >= c.valid_from AND d.occurred_at < c.valid_to)"


@query(
    "p3_overlay",
    with_sql(
        "SELECT request_id, system_id, count(*) AS n_live, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds, max(control_id) AS last_control, arg_max(mode, control_id) AS mode, arg_max(suspended, control_id) AS suspended, string_agg(tools, ',' ORDER BY control_id) AS tools, arg_max(escalate, control_id)::VARCHAR AS escalate, arg_max(pass, control_id)::VARCHAR AS pass FROM day_live GROUP BY request_id, system_id",
        V.DECISIONS, V.CONTROLS, V.DAY_CONTROLS, DAY_LIVE,
    ),
)
def p3(spark, d):
    turns = V.decisions(spark, d)
    thresholds = lambda k: F.try_element_at(F.try_element_at("dicts", F.lit("thresholds")), F.lit(k)).alias(k)
    scalar = lambda k: F.try_element_at("scalars", F.lit(k)).alias(k)
    return policy.overlays(turns, V.day_controls(turns), scalar("mode"), scalar("suspended"), F.array_join(F.try_element_at("lists", F.lit("tools")), ",").alias("tools"), thresholds("escalate"), thresholds("pass"))


@query(
    "p4_state",
    with_sql(
        "SELECT d.request_id, d.system_id, CASE WHEN suspend THEN 'suspended' WHEN quarantine THEN 'quarantined' WHEN restricted THEN 'tool_restricted' WHEN ended THEN 'recovering' ELSE 'healthy' END AS state FROM v_decisions d LEFT JOIN (SELECT request_id, bool_or(kind = 'suspend' AND occurred_at < valid_to) AS suspend, bool_or(kind = 'quarantine' AND occurred_at < valid_to) AS quarantine, bool_or(kind = 'tool_restricted' AND occurred_at < valid_to) AS restricted, bool_or(kind IN ('suspend', 'quarantine', 'tool_restricted') AND occurred_at >= valid_to) AS ended FROM live GROUP BY request_id) f ON d.request_id = f.request_id",
        V.DECISIONS, V.CONTROLS, LIVE.format(s=900),
    ),
)
def p4(spark, d):
    turns = V.decisions(spark, d)
    return policy.system_states(turns, V.controls(turns))


@query("p5_price", full("SELECT request_id, p_failure, price, confidence, greatest(0, price - half) AS band_low, least(100, price + half) AS band_high, dominant, array_to_string(labels, ',') AS labels FROM risk"))
def p5(spark, d):
    return Decisions(spark, d).risk().withColumn("labels", F.array_join("labels", ","))


@query("p6_governance", full("SELECT * FROM governance"))
def p6(spark, d):
    return Decisions(spark, d).governance()


@query("p7_route", full("SELECT request_id, system_id, price, rule, route FROM routed"))
def p7(spark, d):
    return decide.route(Decisions(spark, d).joined()).select("request_id", "system_id", "price", "rule", "route")


@query("p8_evidence_floor", full("SELECT request_id, effective, tier, tier_met, route, final_route FROM decided"))
def p8(spark, d):
    return Decisions(spark, d).decided().select("request_id", "effective", "tier", "tier_met", "route", "final_route")


@query("p9_side_effect", full("SELECT request_id, final_route, effective, " + decide.SIDE_EFFECT_SQL.format(r="final_route") + " AS state FROM decided"))
def p9(spark, d):
    x = Decisions(spark, d).decided()
    return x.select("request_id", "final_route", "effective", decide.side_effect(F.col("final_route"), F.col("effective")).alias("state"))


MINUTES_SQL = "CASE {r} WHEN 'escalate' THEN 4.0 WHEN 'block' THEN 8.0 ELSE 0.0 END::DOUBLE"


@query("p10_cost", full("SELECT request_id, route, round_even(tokens / 1000.0::DOUBLE * 0.85::DOUBLE, 6) AS spend, " + MINUTES_SQL.format(r="route") + " AS review_minutes, 8 * " + MINUTES_SQL.format(r="route") + " AS review_cost FROM routed"))
def p10(spark, d):
    x = scoring.costs(decide.route(Decisions(spark, d).joined()))
    return x.select("request_id", "route", F.bround("spend", 6).alias("spend"), "review_minutes", "review_cost")


@query(
    "p11_policy_ab",
    full("SELECT a.request_id, a.route AS route_a, b.route AS route_b, a.route <> b.route AS diverges FROM ra a JOIN rb b ON a.request_id = b.request_id").replace(
        "SELECT a.request_id, a.route AS",
        ", ".join([""] + [f"r{v} AS (SELECT request_id, {decide._case(decide.SQL_RULES, 1, 'escalate')} AS route FROM (SELECT * EXCLUDE (t_pass, t_escalate), {p} AS t_pass, {e} AS t_escalate FROM joined))" for v, p, e in (("a", 22, 62), ("b", 12, 44))]) + " SELECT a.request_id, a.route AS",
    ),
)
def p11(spark, d):
    variants = spark.createDataFrame([("a", 22, 62), ("b", 12, 44)], "variant string, t_pass int, t_escalate int")
    return decide.compare_policies(Decisions(spark, d).joined(), variants)


# The record's evidence differs from what was decided on: a score of every tenth turn, a status of others.
CHANGED = """v_changed AS (SELECT * REPLACE (CASE WHEN request_id % 10 = 3 AND detector_id = 'grounding' THEN 1.0::DOUBLE ELSE score END AS score, CASE WHEN request_id % 10 = 6 AND detector_id = 'privacy' THEN 'failed' ELSE status END AS status) FROM v_detector_results)"""
REPLAYED = "SELECT request_id, " + ", ".join(decide.OUTCOME) + " FROM decided"


@query(
    "p12_replay",
    f"SELECT a.request_id, len(x) = 0 AS identical, array_to_string(x, ',') AS differences FROM ({full(REPLAYED)}) a JOIN ({full(REPLAYED, 'v_changed', CHANGED)}) b ON a.request_id = b.request_id "
    f"CROSS JOIN LATERAL (SELECT list_filter([{', '.join(f"CASE WHEN a.{f} IS DISTINCT FROM b.{f} THEN '{f}' END" for f in decide.OUTCOME)}], lambda f: f IS NOT NULL) AS x)",
)
def p12(spark, d):
    """Decisions decided again from the log's records, some of which were changed since."""
    from assurance.plans.logs_and_streams import shared

    x = Decisions(spark, d)
    n, what = F.col("request_id") % 10, F.col("detector_id")
    changed = x.results.withColumn("score", F.when((n == 3) & (what == "grounding"), 1.0).otherwise(F.col("score")))
    changed = changed.withColumn("status", F.when((n == 6) & (what == "privacy"), "failed").otherwise(F.col("status")))
    path = shared(spark)
    decide.records(x.capability, changed, x.policy, x.decided()).write.parquet(path)
    return decide.replay(spark.read.parquet(path), shared(spark))


LATE = """late AS (SELECT * REPLACE ('completed_async' AS status) FROM v_detector_results WHERE status = 'queued_async'),
amended_results AS (SELECT r.* FROM v_detector_results r ANTI JOIN late l ON r.request_id = l.request_id AND r.detector_id = l.detector_id UNION ALL SELECT * FROM late)"""


@query(
    "p13_amendment",
    "WITH before_ AS (" + full("SELECT request_id, price, governance, route FROM routed") + "), after_ AS (" + full("SELECT request_id, price, governance, route FROM routed", "amended_results", LATE)
    + ") SELECT b.request_id, b.price AS price_before, a.price AS price_after, a.price - b.price AS delta, a.governance AS governance_after, b.route AS released_route, a.route AS would_route FROM before_ b JOIN after_ a ON a.request_id = b.request_id WHERE b.request_id % 10 = 1",
)
def p13(spark, d):
    x = Decisions(spark, d)
    late = scoring.late_rows(x.results)
    touched = late.select("request_id").distinct()
    before = decide.route(x.joined()).join(touched, "request_id", "left_semi").select("request_id", F.col("price").alias("price_before"), F.col("route").alias("released_route"))
    after = decide.route(x.joined(scoring.replace_late(x.results, late))).select("request_id", F.col("price").alias("price_after"), F.col("governance").alias("governance_after"), F.col("route").alias("would_route"))
    return before.join(after, "request_id").withColumn("delta", F.col("price_after") - F.col("price_before"))


@query(
    "p17_grants",
    with_sql(
        "SELECT d.system_id, effective, outside, outside <> '' AS mismatch, count(*) AS n_decisions FROM v_decisions d JOIN (SELECT system_id, array_to_string(list_sort(list_filter(authorised, lambda x: x IN ('read', 'draft', 'advise'))), ',') AS effective, array_to_string(list_sort(list_filter(authorised, lambda x: x NOT IN ('read', 'draft', 'advise'))), ',') AS outside FROM systems) s USING (system_id) GROUP BY ALL",
        V.DECISIONS, V.DIMS,
    ),
)
def p17(spark, d):
    n = V.decisions(spark, d).groupBy("system_id").agg(F.count("*").alias("n_decisions"))
    return n.join(F.broadcast(policy.intersect_grants(V.systems(spark))), "system_id")


@query(
    "p18_deadline",
    with_sql(
        "SELECT r.request_id, r.system_id, detector_id, requirement, (k * 97 + monitor_ord * 400) AS latency_ms, CASE WHEN list_contains(deferred, detector_id) AND NOT list_contains(inline, detector_id) THEN 'queued_async' WHEN NOT list_contains(inline, detector_id) THEN 'failed' WHEN k * 97 + monitor_ord * 400 > latency_budget_ms THEN 'timed_out' ELSE 'completed' END AS status FROM v_detector_results r JOIN policy p ON r.system_id = p.system_id",
        *BASE,
    ),
)
def p18(spark, d):
    x = Decisions(spark, d)
    runs = x.results.withColumn("latency_ms", F.col("k") * 97 + F.col("monitor_ord") * 400)
    return policy.deadline_status(runs, x.policy)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per system: exposure, routes and consequence-weighted completeness."""
    x = Decisions(spark, sf_dir).decided()
    return x.groupBy("system_id").agg(
        F.count("*").alias("decisions"),
        F.sum("price").alias("exposure"),
        *(F.count_if(F.col("final_route") == r).alias(r) for r in ("pass", "repair", "escalate", "block")),
        F.bround(F.sum(F.when(F.col("fully_governed"), F.col("blast_radius"))) / F.sum("blast_radius"), 4).alias("completeness"),
    )


query("flagship", full("SELECT system_id, count(*) AS decisions, sum(price) AS exposure, count(*) FILTER (final_route = 'pass') AS pass, count(*) FILTER (final_route = 'repair') AS repair, count(*) FILTER (final_route = 'escalate') AS escalate, count(*) FILTER (final_route = 'block') AS block, round_even(sum(CASE WHEN fully_governed THEN blast_radius END) / sum(blast_radius), 4) AS completeness FROM decided GROUP BY system_id"))(flagship)
