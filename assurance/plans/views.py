"""Tables of turns, decisions and controls as views of the driver's tables, for Spark and, as text, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assurance import config as C


def now():
    return F.lit(C.NOW).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def systems(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.SYSTEMS, C.SYSTEM_COLUMNS)


def tools(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.TOOLS, C.TOOL_COLUMNS)


def actions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.ACTIONS, "action string, rank int, radius double, irreversible boolean")


def profiles(spark: SparkSession) -> DataFrame:
    rows = [(k, *(p["thresholds"][t] for t in ("pass", "repair", "escalate")), p["weights"], p["latency_budget_ms"], p["inline"], p["deferred"], p["hard_gate"]) for k, p in C.PROFILES.items()]
    return spark.createDataFrame(rows, "profile string, t_pass int, t_repair int, t_escalate int, weights map<string,double>, latency_budget_ms int, inline array<string>, deferred array<string>, hard_gate array<string>")


def jurisdictions(spark: SparkSession) -> DataFrame:
    rows = [(k, *(j["delta"][t] for t in ("pass", "repair", "escalate")), j["weights"]) for k, j in C.JURISDICTIONS.items()]
    return spark.createDataFrame(rows, "jurisdiction string, d_pass int, d_repair int, d_escalate int, j_weights map<string,double>")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each turn: what was asked of whom, and what the tool can do."""
    k = F.get_json_object("props", "$.k").cast("int")
    action = F.expr("CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'draft' WHEN 'signup' THEN 'advise' WHEN 'error' THEN 'decide' WHEN 'purchase' THEN 'execute' END")
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("sys-"), (F.col("user_id") % 5).cast("string")).alias("system_id"),
        F.col("ts").cast("timestamp").alias("occurred_at"),
        k.alias("k"),
        F.col("value"),
        F.col("event_type"),
        action.alias("effective_action"),
        F.when(k % 4 == 0, "draft").otherwise(action).alias("declared_action"),
        (k * 37 + 100).alias("tokens"),
        F.when(k % 3 == 0, "user").otherwise("seed").alias("origin"),
        tool_of(k).alias("tool_id"),
    )


def tool_of(k):
    names = ["none", "lookup", "drafter", "adviser", "approver", "payer", "unbound"]
    return F.element_at(F.array(*map(F.lit, names)), k % len(names) + 1)


DECISIONS = """v_decisions AS (
  SELECT *, CASE WHEN k % 4 = 0 THEN 'draft' ELSE effective_action END AS declared_action, k * 37 + 100 AS tokens,
    CASE WHEN k % 3 = 0 THEN 'user' ELSE 'seed' END AS origin,
    (['none', 'lookup', 'drafter', 'adviser', 'approver', 'payer', 'unbound'])[k % 7 + 1] AS tool_id
  FROM (SELECT event_id AS request_id, 'sys-' || CAST(user_id % 5 AS VARCHAR) AS system_id, ts AS occurred_at,
    CAST(props->>'$.k' AS INTEGER) AS k, value, event_type,
    CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'draft' WHEN 'signup' THEN 'advise' WHEN 'error' THEN 'decide' WHEN 'purchase' THEN 'execute' END AS effective_action
    FROM events))"""


def detector_results(d: DataFrame) -> DataFrame:
    """Three rows for each decision: privacy, grounding and cost, in the order of monitor_ord."""
    score = [F.col("k") / 100, (F.col("k") * 7 % 100) / 100, F.least(F.col("value") / 100, F.lit(1.0))]
    status = F.expr("CASE request_id % 10 WHEN 0 THEN 'timed_out' WHEN 1 THEN 'queued_async' WHEN 2 THEN 'failed' ELSE 'completed' END")
    label = [
        F.when(score[0] >= 0.5, F.array(F.lit("privacy"))),
        F.when(score[1] >= 0.9, F.array(F.lit("ungrounded"), F.lit("unverifiable"))).when(score[1] >= 0.55, F.array(F.lit("ungrounded"))),
        F.when(score[2] > 0.3, F.array(F.lit("cost"))),
    ]
    rows = [
        F.struct(F.lit(i + 1).alias("monitor_ord"), F.lit(name).alias("detector_id"), s.alias("score"), F.lit(c).alias("confidence"), F.lit(r).alias("requirement"), F.coalesce(x, F.array().cast("array<string>")).alias("labels"))
        for i, (name, s, c, r, x) in enumerate(zip(("privacy", "grounding", "cost"), score, (0.95, 0.8, 0.7), ("mandatory", "mandatory", "advisory"), label, strict=True))
    ]
    return d.withColumn("status", status).select("request_id", "system_id", "occurred_at", "k", "status", F.inline(F.array(*rows)))


DETECTORS = """v_detector_results AS (
  SELECT request_id, system_id, occurred_at, k, 
    CASE request_id % 10 WHEN 0 THEN 'timed_out' WHEN 1 THEN 'queued_async' WHEN 2 THEN 'failed' ELSE 'completed' END AS status, monitor_ord, detector_id, score, confidence, requirement, labels
  FROM (
    SELECT *, 1 AS monitor_ord, 'privacy' AS detector_id, k / 100.0::DOUBLE AS score, 0.95::DOUBLE AS confidence, 'mandatory' AS requirement,
      CASE WHEN k / 100.0::DOUBLE >= 0.5 THEN ['privacy'] ELSE []::VARCHAR[] END AS labels FROM v_decisions
    UNION ALL SELECT *, 2, 'grounding', (7 * k % 100) / 100.0::DOUBLE, 0.8::DOUBLE, 'mandatory',
      CASE WHEN (7 * k % 100) / 100.0::DOUBLE >= 0.9 THEN ['ungrounded', 'unverifiable'] WHEN (7 * k % 100) / 100.0::DOUBLE >= 0.55 THEN ['ungrounded'] ELSE []::VARCHAR[] END FROM v_decisions
    UNION ALL SELECT *, 3, 'cost', least(value / 100, 1.0::DOUBLE), 0.7::DOUBLE, 'advisory',
      CASE WHEN least(value / 100, 1.0::DOUBLE) > 0.3 THEN ['cost'] ELSE []::VARCHAR[] END FROM v_decisions))"""


def controls(d: DataFrame) -> DataFrame:
    """Controls that an operator applied: five kinds, one hour each."""
    kinds = F.array(*map(F.lit, ("suspend", "quarantine", "tool_restricted", "require_human", "tighten")))
    c = d.filter("event_type = 'error' AND k < 5")
    return c.select(F.col("request_id").alias("control_id"), "system_id", F.element_at(kinds, F.col("k") + 1).alias("kind"), F.col("occurred_at").alias("valid_from"), (F.col("occurred_at") + F.expr("interval 1 hour")).alias("valid_to"))


def day_controls(d: DataFrame) -> DataFrame:
    """The same controls over a whole day, so that several bear on one turn, each with a payload as JSON and its id as version."""
    c = controls(d).withColumn("valid_to", F.col("valid_from") + F.expr("interval 1 day")).withColumn("version", F.col("control_id"))
    n = F.col("control_id")
    payload = (
        F.when(F.col("kind") == "suspend", F.to_json(F.struct(F.lit("off").alias("mode"), F.lit(True).alias("suspended"))))
        .when(F.col("kind") == "quarantine", F.to_json(F.struct(F.lit("shadow").alias("mode"), F.array(F.lit("send")).alias("tools"))))
        .when(F.col("kind") == "tool_restricted", F.to_json(F.struct(F.array(F.lit("refund"), F.concat(F.lit("tool-"), (n % 3).cast("string"))).alias("tools"))))
        .when(F.col("kind") == "require_human", F.to_json(F.struct(F.lit("review").alias("mode"), F.struct((n % 4).alias("pass")).alias("thresholds"))))
        .otherwise(F.to_json(F.struct(F.struct((6 + n % 3).alias("escalate"), (n % 2).alias("pass")).alias("thresholds"))))
    )
    return c.withColumn("payload", payload)


CONTROLS = """v_controls AS (
  SELECT request_id AS control_id, system_id, (['suspend', 'quarantine', 'tool_restricted', 'require_human', 'tighten'])[k + 1] AS kind,
    occurred_at AS valid_from, occurred_at + INTERVAL 1 HOUR AS valid_to
  FROM v_decisions WHERE event_type = 'error' AND k < 5)"""

DAY_CONTROLS = """day_controls AS (SELECT * REPLACE (valid_from + INTERVAL 1 DAY AS valid_to), CASE kind WHEN 'suspend' THEN 'off' WHEN 'quarantine' THEN 'shadow' WHEN 'require_human' THEN 'review' END AS mode,
  CASE kind WHEN 'suspend' THEN 'true' END AS suspended, CASE kind WHEN 'quarantine' THEN 'send' WHEN 'tool_restricted' THEN 'refund,tool-' || control_id % 3 END AS tools,
  CASE kind WHEN 'tighten' THEN 6 + control_id % 3 END AS escalate, CASE kind WHEN 'tighten' THEN control_id % 2 WHEN 'require_human' THEN control_id % 4 END AS pass FROM v_controls)"""

_systems = [c.split()[0] for c in C.SYSTEM_COLUMNS.split(", ")]
_tools = [c.split()[0] for c in C.TOOL_COLUMNS.split(", ")]
DIMS = f"""systems AS ({C.values_sql(C.SYSTEMS, _systems)}),
tools AS ({C.values_sql(C.TOOLS, _tools)}),
actions AS ({C.values_sql(C.ACTIONS, ["action", "rank", "radius", "irreversible"])}),
profiles AS ({C.values_sql([(k, p["thresholds"]["pass"], p["thresholds"]["repair"], p["thresholds"]["escalate"], p["latency_budget_ms"], p["inline"], p["deferred"], p["hard_gate"] or ["-"]) for k, p in C.PROFILES.items()], ["profile", "t_pass", "t_repair", "t_escalate", "latency_budget_ms", "inline", "deferred", "hard_gate"])}),
weights AS ({C.values_sql([(k, d, w) for k, p in C.PROFILES.items() for d, w in p["weights"].items()], ["profile", "detector_id", "weight"])}),
jurisdictions AS ({C.values_sql([(k, j["delta"]["pass"], j["delta"]["repair"], j["delta"]["escalate"]) for k, j in C.JURISDICTIONS.items()], ["jurisdiction", "d_pass", "d_repair", "d_escalate"])}),
j_weights AS ({C.values_sql([(k, d, w) for k, j in C.JURISDICTIONS.items() for d, w in j["weights"].items()], ["jurisdiction", "detector_id", "weight"])})"""
