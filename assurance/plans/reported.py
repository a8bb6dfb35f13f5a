"""Queries over reports and validations."""

from __future__ import annotations

from pyspark.sql import functions as F

from assurance.functions import text as T
from assurance.operators import monitors as M
from assurance.operators import projections as P
from assurance.operators import reports as R
from assurance.plans import projected, turns
from assurance.plans import views as V
from assurance.plans.decisions import Decisions, full, with_sql
from assurance.plans.projected import a10

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query(
    "p14_plain_verdict",
    full(
        "SELECT request_id, CASE final_route WHEN 'pass' THEN 'Released as written' WHEN 'repair' THEN 'Released after a repair' WHEN 'escalate' THEN 'Needs a person' ELSE 'Not released' END AS headline, array_to_string(list_filter([CASE WHEN denied IS NOT NULL THEN 'refused: ' || denied END, CASE WHEN NOT tier_met THEN 'the evidence is too weak for this action' END, CASE WHEN fail_closed THEN 'a required check did not finish' END, CASE WHEN price >= t_escalate THEN 'risk price ' || price END, CASE WHEN len(labels) > 0 THEN 'found: ' || array_to_string(labels, ', ') END, CASE WHEN NOT fully_governed THEN 'not every check was completed' END], lambda r: r IS NOT NULL)[1:3], '; ') AS reasons, CASE final_route WHEN 'block' THEN 'correct the request or ask its owner' WHEN 'escalate' THEN 'a reviewer decides' ELSE 'nothing to do' END AS next_step FROM decided"
    ),
)
def p14(spark, d):
    return R.plain_verdict(Decisions(spark, d).decided())


@query(
    "p15_attribution",
    full("SELECT request_id, cost_findings, safety_findings, CASE rule WHEN 'registry' THEN 'registry' WHEN 'safety_first' THEN 'safety' WHEN 'cost_alone' THEN 'cost' ELSE 'nobody' END AS decided_by, rule FROM (SELECT g.*, CASE WHEN denied IS NOT NULL THEN 'registry' WHEN safety_findings > 0 THEN 'safety_first' WHEN cost_findings > 0 THEN 'cost_alone' ELSE 'none' END AS rule FROM (SELECT request_id, count(*) FILTER (len(labels) > 0 AND detector_id = 'cost') AS cost_findings, count(*) FILTER (len(labels) > 0 AND detector_id <> 'cost') AS safety_findings FROM v_detector_results GROUP BY request_id) g JOIN decided d ON g.request_id = d.request_id)"),
)
def p15(spark, d):
    x = Decisions(spark, d)
    return R.attribution(x.results, x.decided())


@query(
    "p16_proposals",
    with_sql("SELECT request_id, CASE WHEN k % 13 = 0 THEN 'missing tool_id' WHEN k % 11 = 0 THEN 'unknown extra' WHEN k % 7 = 0 THEN 'unknown action' END AS reason FROM v_decisions", V.DECISIONS),
)
def p16(spark, d):
    k = F.col("k")
    action = F.when((k % 7 == 0) & (k % 13 != 0) & (k % 11 != 0), "launch").otherwise(F.col("declared_action"))
    payload = F.to_json(F.struct(F.lit("an answer").alias("answer"), action.alias("declared_action"), F.array(F.lit("a"), F.lit("b")).alias("source_ids"), F.when(k % 13 != 0, F.col("tool_id")).alias("tool_id"), F.when((k % 11 == 0) & (k % 13 != 0), F.lit(1)).alias("extra")))
    return R.validate_proposals(V.decisions(spark, d).select("request_id", payload.alias("payload")))


@query(
    "b1_briefing",
    projected.proj("SELECT c.system_id, status, spend, coalesce(n_high, 0) AS n_high, coalesce(rules, '') AS advice, CASE WHEN reason = 'over budget' THEN 'budget exhausted' WHEN coalesce(n_high, 0) > 0 THEN n_high || ' urgent' WHEN coalesce(n, 0) > 0 THEN n || ' to look at' ELSE 'all clear' END AS subject FROM cards c LEFT JOIN (SELECT system_id, count(*) FILTER (severity = 'high') AS n_high, count(*) AS n, string_agg(rule, ',' ORDER BY CASE severity WHEN 'high' THEN 1 ELSE 2 END, rule_ord) AS rules FROM advised GROUP BY system_id) a ON c.system_id = a.system_id", *projected.ADVISED),
)
def b1(spark, d):
    x = projected.costed(spark, d)
    return R.briefing(P.portfolio(x, V.systems(spark), V.now()), projected.a12(spark, d))


@query("b3_forecast_sentence", "SELECT system_id, CASE state WHEN 'too_early' THEN 'Too early in the month to say.' WHEN 'exhausted' THEN 'The month''s budget is spent.' WHEN 'steady' THEN 'The budget lasts past this week.' ELSE 'The budget lasts ' || CAST(floor(days_left) AS INTEGER) || ' days, until ' || exhausted_on || '.' END AS sentence FROM (" + projected.SQL["a10_burn_rate"] + ")")
def b3(spark, d):
    return R.forecast_sentence(a10(spark, d))


@query("b4_policy_explained", with_sql("SELECT system_id, threshold, base, jurisdiction_delta, greatest(1, base - jurisdiction_delta) AS resolved, n_decisions FROM (SELECT s.system_id, t.threshold, CASE t.threshold WHEN 'pass' THEN t_pass WHEN 'repair' THEN t_repair ELSE t_escalate END AS base, coalesce(CASE t.threshold WHEN 'pass' THEN d_pass WHEN 'repair' THEN d_repair ELSE d_escalate END, 0) AS jurisdiction_delta FROM systems s JOIN profiles p USING (profile) LEFT JOIN jurisdictions j ON s.jurisdiction = j.jurisdiction CROSS JOIN (VALUES ('pass'), ('repair'), ('escalate')) t(threshold)) JOIN (SELECT system_id, count(*) AS n_decisions FROM v_decisions GROUP BY system_id) n USING (system_id)", V.DECISIONS, V.DIMS))
def b4(spark, d):
    n = V.decisions(spark, d).groupBy("system_id").agg(F.count("*").alias("n_decisions"))
    return R.explain_policy(V.systems(spark), V.profiles(spark), V.jurisdictions(spark)).join(n, "system_id")


@query("b5_transcript", full("SELECT d.request_id, d.system_id, CASE WHEN d.request_id % 9 = 0 THEN 'answered' ELSE final_route END AS state FROM v_decisions d JOIN decided x ON d.request_id = x.request_id"))
def b5(spark, d):
    x = Decisions(spark, d)
    held = x.turns.filter("request_id % 9 = 0").select("request_id", F.lit("answered").alias("status"))
    return R.transcript(x.turns.select("request_id", "system_id"), x.decided(), held)


@query("b7_changes", with_sql("SELECT request_id AS change_id, CASE WHEN k = 0 THEN 'budget is not positive' WHEN k % 10 = 9 THEN 'address' END AS reason FROM v_decisions", V.DECISIONS))
def b7(spark, d):
    k = F.col("k")
    changes = V.decisions(spark, d).select(F.col("request_id").alias("change_id"), (k * 1000.0).alias("budget"), F.col("system_id").alias("owner"), F.when(k % 10 == 9, "nobody").otherwise(F.concat(F.col("system_id"), F.lit("@example.com"))).alias("address"))
    return R.validate_changes(changes).select("change_id", "reason")


@query("m25_verification", with_sql("SELECT request_id, CASE WHEN NOT checked THEN 'not_checked' WHEN unverifiable THEN 'unverified' WHEN score = 0 THEN 'verified' WHEN score < 0.55 THEN 'partly_verified' ELSE 'contradicted' END AS state FROM (SELECT request_id, bool_or(ok) AS checked, max(CASE WHEN ok THEN score END) AS score, bool_or(ok AND list_contains(labels, 'unverifiable')) AS unverifiable FROM (SELECT *, status IN ('completed', 'completed_async') AND detector_id = 'grounding' AS ok FROM v_detector_results) GROUP BY request_id)", V.DECISIONS, V.DETECTORS))
def m25(spark, d):
    return R.verification(V.detector_results(V.decisions(spark, d)))


@query("m18_fabricated", "SELECT item_id, count(*) AS cited, count(*) FILTER (d.doc_id IS NULL) AS missing, CASE WHEN count(*) FILTER (d.doc_id IS NULL) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM (SELECT item_id, item_id * 7 % (SELECT max(doc_id) + 50 FROM documents) AS doc_id FROM benchmark UNION ALL SELECT item_id, item_id * 13 % (SELECT max(doc_id) + 50 FROM documents) FROM benchmark) c LEFT JOIN (SELECT DISTINCT doc_id FROM documents) d USING (doc_id) GROUP BY item_id")
def m18(spark, d):
    from assurance.plans.retrieval import r3

    x = r3(spark, d)
    return x.select("item_id", (F.col("resolved") + F.col("missing")).alias("cited"), "missing", F.when(F.col("missing") > 0, 1.0).otherwise(0.0).alias("score"))


@query("m21_requirement", full("SELECT request_id, effective IN ('advise', 'decide', 'execute') AND tier <> 'authoritative' AS required FROM decided"))
def m21(spark, d):
    x = Decisions(spark, d).decided()
    return x.select("request_id", (F.col("effective").isin("advise", "decide", "execute") & (F.col("tier") != "authoritative")).alias("required"))


QUANTITY_SQL = r"(?:^|[^\w.])(?:₹|[Rr][Ss]\.?\s*)?(\d[\d,]*(?:\.\d+)?)(?:\s*((?i:%|percent|lakh|crore|thousand|k\b)))?"


@query(
    "tx8_quantities",
    f"""SELECT doc_id, len(v) AS n, coalesce(list_sum(v), 0.0)::DOUBLE AS total FROM (SELECT doc_id, list_transform(list_zip(regexp_extract_all(text, '{QUANTITY_SQL}', 1), regexp_extract_all(text, '{QUANTITY_SQL}', 2)),
  lambda z: replace(z[1], ',', '')::DOUBLE * CASE lower(z[2]) WHEN 'lakh' THEN 1e5 WHEN 'crore' THEN 1e7 WHEN 'thousand' THEN 1e3 WHEN 'k' THEN 1e3 ELSE 1e0 END) AS v FROM (SELECT doc_id, {turns.begun_sql(turns.ASKED, 'text', 'doc_id')} AS text FROM documents))""",
)
def tx8(spark, d):
    """Quantities with units (TX8) of documents behind a sentence of a small table."""
    x = V.table(spark, d, "documents").withColumn("turn_id", F.col("doc_id"))
    values = M.numbers(F.col("text"))
    x = x.select("doc_id", turns.begun(turns.ASKED, "text").alias("text")).select("doc_id", values.alias("v"))
    return x.select("doc_id", F.size("v").cast("long").alias("n"), F.aggregate("v", F.lit(0.0), lambda s, y: s + y).alias("total"))


@query("q2_size", f"WITH {turns.TURNS} SELECT turn_id, trim(question) = '' AS is_empty, length(question) > 4000 AS oversized FROM v_turns")
def q2(spark, d):
    return turns.turns(spark, d).select("turn_id", (T.trimmed(F.col("question")) == "").alias("is_empty"), (F.char_length("question") > 4000).alias("oversized"))


@query("q4_prompt_identifiers")
def q4(spark, d):
    """The identifier screen over questions (Q4)."""
    return M.identifiers(turns.turns(spark, d), F.col("question"))


