"""Queries over projections, periods, forecasts and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assurance.operators import projections as P
from assurance.operators import scoring
from assurance.operators import windows as W
from assurance.plans import views as V
from assurance.plans.decisions import MINUTES_SQL, Decisions, full, with_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}
NOW_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def costed(spark, d):
    return scoring.costs(Decisions(spark, d).decided())


COSTED = f"costed AS (SELECT *, tokens / 1000.0::DOUBLE * 0.85::DOUBLE AS spend, {MINUTES_SQL.format(r='route')} AS review_minutes FROM decided)"
CARDS = (
    COSTED
    + f""",
sums AS (SELECT system_id, count(*) AS decisions, count(*) FILTER (final_route = 'pass') AS pass, count(*) FILTER (final_route = 'repair') AS repair, count(*) FILTER (final_route = 'escalate') AS escalate,
  count(*) FILTER (final_route = 'block') AS block, sum(price) AS exposure, round_even(sum(CASE WHEN fully_governed THEN blast_radius ELSE 0 END) / sum(blast_radius), 4) AS completeness,
  sum(CASE WHEN occurred_at >= date_trunc('month', {NOW_SQL}) THEN tokens ELSE 0 END) AS month_tokens, sum(CASE WHEN occurred_at >= {NOW_SQL} - INTERVAL 7 DAY THEN review_minutes ELSE 0 END) AS week_minutes,
  count(*) FILTER (origin = 'user') AS live, count(*) FILTER (origin <> 'user') AS synthetic, max(occurred_at) AS last_seen FROM costed GROUP BY system_id),
cards0 AS (SELECT s.system_id, budget_inr, minutes_week, c.* EXCLUDE (system_id), round_even(coalesce(month_tokens * 0.85::DOUBLE / 1000, 0) + spend_baseline, 4) AS spend, round_even(coalesce(week_minutes, 0) + review_baseline, 4) AS review FROM systems s LEFT JOIN sums c ON s.system_id = c.system_id),
cards1 AS (SELECT *, greatest(spend / budget_inr, review / minutes_week) AS share FROM cards0),
cards2 AS (SELECT *, CASE WHEN last_seen IS NULL OR date_diff('second', last_seen, {NOW_SQL}) > 7200 THEN 'no recent signal' WHEN share > 1 THEN 'over budget' WHEN block > decisions * 0.7::DOUBLE THEN 'blocks' WHEN completeness < 0.6::DOUBLE THEN 'incomplete checks' WHEN share > 0.7::DOUBLE THEN 'approaching a budget' ELSE 'within budgets' END AS reason FROM cards1),
cards AS (SELECT system_id, decisions, pass, repair, escalate, block, exposure, round_even(exposure * 100 / decisions::DOUBLE, 4) AS exposure_per_100, completeness, spend, review, live, synthetic,
  CASE WHEN reason = 'no recent signal' THEN 'unknown' WHEN reason IN ('over budget', 'blocks', 'incomplete checks') THEN 'breaching' ELSE 'governed' END AS status, reason FROM cards2)"""
)


def proj(select: str, *more: str) -> str:
    ctes = full("", "v_detector_results")
    return ctes + ",\n" + ",\n".join(more) + "\n" + select


@query("a1_portfolio", proj("SELECT system_id, decisions, pass, repair, escalate, block, CAST(exposure AS BIGINT) AS exposure, exposure_per_100, completeness, spend, review, live, synthetic FROM cards", CARDS))
def a1(spark, d):
    return P.portfolio(costed(spark, d), V.systems(spark), V.now()).drop("status", "reason")


@query("a2_status", proj("SELECT system_id, status, reason FROM cards", CARDS))
def a2(spark, d):
    return P.portfolio(costed(spark, d), V.systems(spark), V.now()).select("system_id", "status", "reason")


@query(
    "a3_fleet",
    proj("SELECT coalesce(system_id, 'fleet') AS system_id, count(*) AS decisions, CAST(sum(price) AS BIGINT) AS exposure, round_even(sum(CASE WHEN fully_governed THEN blast_radius ELSE 0 END) / sum(blast_radius), 4) AS completeness, count(*) FILTER (governance = 'awaiting_verification') AS backlog, CAST(sum(CASE WHEN governance = 'awaiting_verification' THEN price ELSE 0 END) AS BIGINT) AS stale_exposure FROM costed GROUP BY ROLLUP (system_id)", COSTED),
)
def a3(spark, d):
    """Cards and their total in one pass."""
    waiting = F.col("governance") == "awaiting_verification"
    return costed(spark, d).rollup("system_id").agg(F.count("*").alias("decisions"), F.sum("price").alias("exposure"), P.completeness().alias("completeness"), F.count_if(waiting).alias("backlog"), F.sum(F.when(waiting, F.col("price")).otherwise(0)).alias("stale_exposure")).withColumn("system_id", F.coalesce("system_id", F.lit("fleet")))


@query("a5_percentile", proj("SELECT system_id, min(CASE WHEN r = least(n, floor(n * 0.5) + 1) THEN price END) AS p50, min(CASE WHEN r = least(n, floor(n * 0.95) + 1) THEN price END) AS p95 FROM (SELECT system_id, price, row_number() OVER (PARTITION BY system_id ORDER BY price) AS r, count(*) OVER (PARTITION BY system_id) AS n FROM costed) GROUP BY system_id", COSTED))
def a5(spark, d):
    return P.percentile_rank(costed(spark, d), "system_id", "price", {"p50": 0.5, "p95": 0.95})


@query("a6_routes", proj("SELECT system_id, count(*) FILTER (route = 'pass') AS pass, count(*) FILTER (route = 'repair') AS repair, count(*) FILTER (route = 'escalate') AS escalate, count(*) FILTER (route = 'block') AS block FROM costed GROUP BY system_id", COSTED))
def a6(spark, d):
    x = costed(spark, d).groupBy("system_id").pivot("route", list(P.ROUTES)).count()
    return x.na.fill(0, list(P.ROUTES))


@query(
    "a7_live_traffic",
    proj(f"SELECT system_id, count(*) AS turns, count(*) FILTER (final_route = 'block') AS blocked, round_even(sum(tokens) * 0.85::DOUBLE / 1000 * 1000 / count(*), 4) AS cost_per_1000, round_even(count(*) FILTER (requires_judge) / count(*)::DOUBLE, 4) AS judge_share FROM (SELECT *, effective IN ('advise', 'decide', 'execute') AND tier <> 'authoritative' AS requires_judge FROM costed WHERE origin = 'user' AND occurred_at >= {NOW_SQL} - INTERVAL 10 DAY) GROUP BY system_id", COSTED),
)
def a7(spark, d):
    x = costed(spark, d).filter((F.col("origin") == "user") & (F.col("occurred_at") >= V.now() - F.expr("interval 10 day")))
    judge = F.col("effective").isin("advise", "decide", "execute") & (F.col("tier") != "authoritative")
    n = F.count("*")
    return x.groupBy("system_id").agg(n.alias("turns"), F.count_if(F.col("final_route") == "block").alias("blocked"), F.bround(F.sum("tokens") * 0.85 / 1000 * 1000 / n, 4).alias("cost_per_1000"), F.bround(F.count_if(judge) / n, 4).alias("judge_share"))


@query("a8_period_usage", proj(f"SELECT system_id, CAST(sum(CASE WHEN occurred_at >= date_trunc('month', {NOW_SQL}) THEN tokens ELSE 0 END) AS BIGINT) AS month_tokens, sum(CASE WHEN occurred_at >= {NOW_SQL} - INTERVAL 7 DAY THEN review_minutes ELSE 0 END) AS week_minutes FROM costed GROUP BY system_id", COSTED))
def a8(spark, d):
    return costed(spark, d).groupBy("system_id").agg(F.sum(F.when(F.col("occurred_at") >= P.month_start(V.now()), F.col("tokens")).otherwise(0)).alias("month_tokens"), F.sum(F.when(F.col("occurred_at") >= P.week_start(V.now()), F.col("review_minutes")).otherwise(0.0)).alias("week_minutes"))


@query("a9_capacity", proj(f"SELECT system_id, used, reserved, budget, round_even((used + reserved) / budget, 4) AS load, CASE WHEN (used + reserved) / budget >= 1 THEN 'exhausted' WHEN (used + reserved) / budget >= 0.85::DOUBLE THEN 'warning' ELSE 'ok' END AS state FROM (SELECT c.system_id, sum(CASE WHEN occurred_at >= {NOW_SQL} - INTERVAL 7 DAY THEN review_minutes ELSE 0 END) AS used, 8.0::DOUBLE * count(*) FILTER (governance = 'awaiting_verification') AS reserved, max(minutes_week) AS budget FROM costed c JOIN systems s ON c.system_id = s.system_id GROUP BY c.system_id)", COSTED))
def a9(spark, d):
    x = costed(spark, d).join(F.broadcast(V.systems(spark).select("system_id", "minutes_week")), "system_id")
    week = F.sum(F.when(F.col("occurred_at") >= P.week_start(V.now()), F.col("review_minutes")).otherwise(0.0))
    return P.capacity(x.groupBy("system_id").agg(week.alias("used"), (F.lit(8.0) * F.count_if(F.col("governance") == "awaiting_verification")).alias("reserved"), F.max("minutes_week").alias("budget")))


SPEND = "v_spend AS (SELECT c_mktsegment AS system_id, o_orderdate AS occurred_on, CAST(o_totalprice AS DECIMAL(18,2)) AS spend FROM orders JOIN customer ON o_custkey = c_custkey), clock AS (SELECT max(occurred_on) AS now FROM v_spend)"


def v_spend(spark, d):
    o, c = V.table(spark, d, "orders"), V.table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_mktsegment").alias("system_id"), F.col("o_orderdate").alias("occurred_on"), F.col("o_totalprice").cast("decimal(18,2)").alias("spend"))


@query(
    "a10_burn_rate",
    with_sql(
        """SELECT system_id, mtd AS month_to_date, lifetime, round_even(mtd / days, 2) AS per_day, round_even(mtd / days * length, 2) AS month_projection, round_even(left_, 2) AS days_left,
  CASE WHEN days < 3 THEN 'too_early' WHEN mtd >= budget THEN 'exhausted' WHEN left_ <= 3 THEN 'critical' WHEN left_ <= 7 THEN 'warning' ELSE 'steady' END AS state,
  CASE WHEN days >= 3 AND mtd < budget THEN strftime(CAST(now AS DATE) + CAST(ceil(left_) AS INTEGER), '%d %b') END AS exhausted_on
FROM (SELECT *, (budget - mtd) / nullif(mtd / days, 0) AS left_ FROM (SELECT system_id, max(now) AS now, day(max(now)) AS days, day(last_day(max(now))) AS length,
  CAST(coalesce(sum(CASE WHEN occurred_on >= date_trunc('month', now) THEN spend END), 0) AS DOUBLE) AS mtd,
  CAST(coalesce(sum(CASE WHEN occurred_on >= date_trunc('month', now) - INTERVAL 1 MONTH AND occurred_on < date_trunc('month', now) THEN spend END), 0) AS DOUBLE) AS budget, CAST(sum(spend) AS DOUBLE) AS lifetime
  FROM v_spend, clock GROUP BY system_id))""",
        SPEND,
    ),
)
def a10(spark, d):
    s = v_spend(spark, d)
    return P.burn_rate(s, s.agg(F.max("occurred_on").alias("now")))


@query("a11_trend", with_sql("SELECT system_id, n, recent, earlier, CASE WHEN n < 4 THEN 'unknown' WHEN recent / nullif(earlier / 2.0, 0) > 1.25 THEN 'rising' WHEN recent / nullif(earlier / 2.0, 0) < 0.8 THEN 'falling' ELSE 'steady' END AS trend FROM (SELECT system_id, count(*) AS n, count(*) FILTER (late) AS recent, count(*) FILTER (NOT late) AS earlier FROM (SELECT d.system_id, epoch_us(occurred_at) > lo + (hi - lo) * 2 / 3.0::DOUBLE AS late FROM v_decisions d JOIN (SELECT system_id, min(epoch_us(occurred_at)) AS lo, max(epoch_us(occurred_at)) AS hi FROM v_decisions GROUP BY system_id) s ON d.system_id = s.system_id) GROUP BY system_id)", V.DECISIONS))
def a11(spark, d):
    return P.trend(V.decisions(spark, d))


SIGNALS = "signals AS (SELECT system_id, count(*) FILTER (mismatch) AS mismatches, round_even(1 - count(DISTINCT k * 100 + CAST(floor(value) AS BIGINT) % 10) / count(*)::DOUBLE, 4) AS duplicate_share, count(*) FILTER (list_contains(labels, 'privacy')) AS identifiers, count(*) FILTER (k % 25 = 7) AS flips FROM costed GROUP BY system_id)"
BURN_OVER = "(state IN ('critical', 'warning') OR (state <> 'too_early' AND days_left > 0 AND month_projection > month_to_date + days_left * per_day))"
# Market segments whose orders stand for the spend of sys-0 to sys-4.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
A12_RULES = [
    ("mismatches > 0", "'high'", "mismatches::DOUBLE", "tool_restricted"),
    ("duplicate_share >= 0.5", "'medium'", "duplicate_share", "enable_cache"),
    ("reason = 'over budget'", "'high'", "spend", "suspend"),
    ("completeness < 0.9", "'high'", "completeness", "promote_inline"),
    ("flips > 0", "'high'", "flips::DOUBLE", "require_human"),
    ("identifiers > 0", "'high'", "identifiers::DOUBLE", "require_human"),
    (f"days_left IS NOT NULL AND {BURN_OVER}", "CASE WHEN state = 'critical' THEN 'high' ELSE 'medium' END", "month_projection", "enable_cache"),
]
A12_VALUES = ", ".join(f"({i}, '{r}', {ok}, {s}, {e}, '{c}', '{before}' || CAST(floor(({e}) * {factor} + 1e-6) AS BIGINT) || '{after}')" for i, ((r, (before, factor, after)), (ok, s, e, c)) in enumerate(zip(P.ADVICE.items(), A12_RULES, strict=True), 1))
ADVISED = [
    CARDS,
    SIGNALS,
    f"burn AS (SELECT * REPLACE (CASE system_id {' '.join(f"WHEN '{s}' THEN 'sys-{i}'" for i, s in enumerate(SEGMENTS))} END AS system_id) FROM (" + SQL["a10_burn_rate"] + "))",
    f"""advised AS (SELECT system_id, savings, rule_ord, rule, severity, evidence, control, advice FROM (
  SELECT c.*, round_even(spend * coalesce(duplicate_share, 0) * 0.55::DOUBLE, 2) AS savings, s.* EXCLUDE (system_id), b.state, days_left, per_day, month_to_date, month_projection FROM cards c LEFT JOIN signals s ON c.system_id = s.system_id LEFT JOIN burn b ON c.system_id = b.system_id) x
CROSS JOIN LATERAL (SELECT * FROM (VALUES {A12_VALUES}) AS t(rule_ord, rule, ok, severity, evidence, control, advice) WHERE ok))""",
]
A12_SQL = proj("SELECT * FROM advised", *ADVISED)


@query("a12_advisories", A12_SQL)
def a12(spark, d):
    x = costed(spark, d)
    digest = F.col("k") * 100 + F.floor("value") % 10
    signals = x.groupBy("system_id").agg(F.count_if("mismatch").alias("mismatches"), F.bround(1 - F.countDistinct(digest) / F.count("*"), 4).alias("duplicate_share"), F.count_if(F.array_contains("labels", "privacy")).alias("identifiers"), F.count_if(F.col("k") % 25 == 7).alias("flips"))
    burn = a10(spark, d).withColumn("system_id", F.concat(F.lit("sys-"), (F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("system_id")) - 1).cast("string")))
    return P.advisories(P.portfolio(x, V.systems(spark), V.now()), signals, burn)


PREDICTIONS = "predictions AS (SELECT l.doc_id, l.toxic = 1 OR l.quality = 0 AS expected, length(d.text) < 60 OR n_same > 1 OR regexp_matches(d.text, '[0-9]{12,}') OR contains(d.text, '###') AS got FROM labels l JOIN (SELECT *, count(*) OVER (PARTITION BY text) AS n_same FROM documents) d ON l.doc_id = d.doc_id)"


def predictions(spark, d):
    """A text rule held against labels: expected and got."""
    docs = V.table(spark, d, "documents").withColumn("digest", F.sha2("text", 256))
    same = docs.groupBy("digest").agg(F.count("*").alias("n_same"))
    x = V.table(spark, d, "labels").join(docs, "doc_id").join(same, "digest")
    got = (F.char_length("text") < 60) | (F.col("n_same") > 1) | F.col("text").rlike("[0-9]{12,}") | F.contains("text", F.lit("###"))
    return x.select("doc_id", ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("expected"), got.alias("got"))


@query("a15_evaluation", with_sql("SELECT count(*) AS cases, round_even(count(*) FILTER (expected AND got) / nullif(count(*) FILTER (expected), 0)::DOUBLE, 4) AS catch_rate, round_even(count(*) FILTER (NOT expected AND got) / nullif(count(*) FILTER (NOT expected), 0)::DOUBLE, 4) AS false_alarm_rate, round_even(count(*) FILTER (expected = got) / nullif(count(*), 0)::DOUBLE, 4) AS agreement FROM predictions", PREDICTIONS))
def a15(spark, d):
    e, g = F.col("expected"), F.col("got")

    def share(a, b):
        return F.bround(F.count_if(a) / F.nullif(F.count_if(b), F.lit(0)), 4)

    return predictions(spark, d).agg(F.count("*").alias("cases"), share(e & g, e).alias("catch_rate"), share(~e & g, ~e).alias("false_alarm_rate"), share(e == g, F.lit(True)).alias("agreement"))


@query("a16_confusion", with_sql("SELECT expected, count(*) FILTER (got) AS got_true, count(*) FILTER (NOT got) AS got_false FROM predictions GROUP BY expected", PREDICTIONS))
def a16(spark, d):
    return predictions(spark, d).groupBy("expected").agg(F.count_if("got").alias("got_true"), F.count_if(~F.col("got")).alias("got_false"))


@query("a17_refusals", proj("SELECT coalesce(system_id, '*') AS system_id, coalesce(rule, '*') AS rule, count(*) AS n FROM costed WHERE route IN ('block', 'escalate') GROUP BY CUBE (system_id, rule)", COSTED))
def a17(spark, d):
    x = costed(spark, d).filter(F.col("route").isin("block", "escalate")).cube("system_id", "rule").agg(F.count("*").alias("n"))
    return x.select(F.coalesce("system_id", F.lit("*")).alias("system_id"), F.coalesce("rule", F.lit("*")).alias("rule"), "n")


@query("a18_freshness", with_sql(f"SELECT system_id, count(*) FILTER (status = 'queued_async') AS pending, CAST(max(CASE WHEN status = 'queued_async' THEN date_diff('second', occurred_at, {NOW_SQL}) END) AS BIGINT) AS oldest_s FROM v_detector_results GROUP BY system_id", V.DECISIONS, V.DETECTORS))
def a18(spark, d):
    r = V.detector_results(V.decisions(spark, d))
    waiting = F.col("status") == "queued_async"
    age = F.unix_timestamp(V.now()) - F.unix_timestamp("occurred_at")
    return r.groupBy("system_id").agg(F.count_if(waiting).alias("pending"), F.max(F.when(waiting, age)).alias("oldest_s"))


@query("a19_portfolio_v1", proj("SELECT system_id, CAST(sum(CASE WHEN denied IS NULL THEN price ELSE 0 END) AS BIGINT) AS exposure, round_even(10 * sum(blast_radius), 4) AS spend, round_even(count(*) FILTER (fully_governed) / count(*)::DOUBLE, 4) AS completeness, 100 - 10 * count(*) FILTER (governance = 'awaiting_verification') AS reviewer_capacity FROM costed GROUP BY system_id", COSTED))
def a19(spark, d):
    return costed(spark, d).groupBy("system_id").agg(F.sum(F.when(F.col("denied").isNull(), F.col("price")).otherwise(0)).alias("exposure"), F.bround(10 * F.sum("blast_radius"), 4).alias("spend"), F.bround(F.count_if("fully_governed") / F.count("*"), 4).alias("completeness"), (100 - 10 * F.count_if(F.col("governance") == "awaiting_verification")).alias("reviewer_capacity"))


@query("w1_sequence", with_sql("SELECT request_id, system_id, row_number() OVER (PARTITION BY system_id ORDER BY occurred_at, request_id) AS sequence FROM v_decisions", V.DECISIONS))
def w1(spark, d):
    x = V.decisions(spark, d).select("request_id", "system_id", "occurred_at")
    return W.sequence(x, ["system_id"], F.date_trunc("hour", "occurred_at"), ["occurred_at", "request_id"]).select("request_id", "system_id", "sequence")


@query("w3_latest", with_sql("SELECT system_id, event_type, request_id, k FROM v_decisions QUALIFY row_number() OVER (PARTITION BY system_id, event_type ORDER BY occurred_at DESC, request_id DESC) = 1", V.DECISIONS))
def w3(spark, d):
    return P.latest(V.decisions(spark, d), ["system_id", "event_type"], ["occurred_at", "request_id"], ["request_id", "k"])


@query("w4_history", with_sql("SELECT conv_id, turn, role, place FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations) WHERE place <= 4"))
def w4(spark, d):
    return P.history(V.table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 4)


SQL["w4_history"] = SQL["w4_history"].removeprefix("WITH ").lstrip()


@query("w5_rolling_median", with_sql("SELECT request_id, n_before, CASE WHEN n_before = 0 THEN 1 ELSE list_sort(before_)[n_before // 2 + 1] END AS median FROM (SELECT request_id, list(tokens) OVER w AS before_, count(*) OVER w AS n_before FROM v_decisions WINDOW w AS (PARTITION BY system_id ORDER BY occurred_at, request_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING))", V.DECISIONS))
def w5(spark, d):
    x = V.decisions(spark, d).select("request_id", "system_id", "occurred_at", "tokens")
    x = W.previous_rows(x, ["system_id"], F.date_trunc("hour", "occurred_at"), ["occurred_at", "request_id"], 50, {"before": lambda w: F.sort_array(F.collect_list("tokens").over(w))})
    n = F.size("before")
    return x.select("request_id", n.cast("long").alias("n_before"), F.when(n == 0, 1).otherwise(F.get("before", F.floor(n / 2).cast("int"))).alias("median"))


@query("w6_periods", with_sql("SELECT request_id, sum(tokens) OVER (PARTITION BY system_id ORDER BY epoch(occurred_at) RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW)::BIGINT AS week_tokens, sum(tokens) OVER (PARTITION BY system_id, date_trunc('month', occurred_at) ORDER BY occurred_at, request_id ROWS UNBOUNDED PRECEDING)::BIGINT AS month_tokens FROM v_decisions", V.DECISIONS))
def w6(spark, d):
    x = V.decisions(spark, d).select("request_id", "system_id", "occurred_at", F.col("tokens").cast("long").alias("tokens"))
    week = W.trailing_sum(x, "request_id", "system_id", "occurred_at", "tokens", 604800, "week_tokens")
    x = x.withColumn("month", F.date_trunc("month", "occurred_at"))
    month = W.running_total(x, ["system_id", "month"], F.date_trunc("hour", "occurred_at"), ["occurred_at", "request_id"], F.col("tokens"), "month_tokens")
    return week.join(month.select("request_id", "month_tokens"), "request_id").select("request_id", "week_tokens", "month_tokens")


@query("w8_review_queue", proj("SELECT request_id, rule, CASE rule WHEN 'toxic_answer' THEN 1 WHEN 'capability' THEN 2 ELSE 3 END AS severity, row_number() OVER (PARTITION BY system_id ORDER BY CASE rule WHEN 'toxic_answer' THEN 1 WHEN 'capability' THEN 2 ELSE 3 END, occurred_at, request_id) AS place FROM costed WHERE route IN ('block', 'escalate')", COSTED))
def w8(spark, d):
    severity = F.when(F.col("rule") == "toxic_answer", 1).when(F.col("rule") == "capability", 2).otherwise(3)
    x = costed(spark, d).filter(F.col("route").isin("block", "escalate")).withColumn("severity", severity)
    bucket = F.struct("severity", F.date_trunc("hour", "occurred_at").alias("hour"))
    return W.sequence(x, ["system_id"], bucket, ["occurred_at", "request_id"], "place").select("request_id", "rule", "severity", "place")


@query("j7_as_of", with_sql("SELECT d.request_id, d.system_id, c.kind FROM v_decisions d ASOF LEFT JOIN (SELECT system_id, valid_from, max(kind) AS kind FROM v_controls GROUP BY system_id, valid_from) c ON d.system_id = c.system_id AND d.occurred_at >= c.valid_from", V.DECISIONS, V.CONTROLS))
def j7(spark, d):
    """The newest control of each turn's system that is not after it."""
    x = V.decisions(spark, d)
    controls = V.controls(x).select("system_id", "valid_from", "kind")
    return W.as_of(x.select("request_id", "system_id", "occurred_at"), controls, "system_id", "occurred_at", "valid_from", F.col("kind"), "kind").select("request_id", "system_id", "kind")


@query("w9_recent_feed", with_sql("SELECT request_id, system_id, occurred_at FROM v_decisions WHERE origin = 'user' ORDER BY occurred_at DESC, request_id DESC LIMIT 14", V.DECISIONS))
def w9(spark, d):
    """A feed of the newest 14, so a top-k without a full sort."""
    return V.decisions(spark, d).filter("origin = 'user'").orderBy(F.desc("occurred_at"), F.desc("request_id")).limit(14).select("request_id", "system_id", "occurred_at")


@query("w12_control_version", with_sql("SELECT control_id, system_id, kind, row_number() OVER (PARTITION BY system_id, kind ORDER BY valid_from, control_id) AS version FROM v_controls", V.DECISIONS, V.CONTROLS))
def w12(spark, d):
    x = V.controls(V.decisions(spark, d)).select("control_id", "system_id", "kind", "valid_from")
    return W.sequence(x, ["system_id", "kind"], F.date_trunc("day", "valid_from"), ["valid_from", "control_id"], "version").select("control_id", "system_id", "kind", "version")


@query("src7_cursor", with_sql("SELECT request_id, system_id, sequence FROM (SELECT request_id, system_id, row_number() OVER (PARTITION BY system_id ORDER BY occurred_at, request_id) AS sequence FROM v_decisions) WHERE sequence > 100", V.DECISIONS))
def src7(spark, d):
    return w1(spark, d).filter("sequence > 100")


@query("u3_outcome_union", proj("SELECT outcome, count(*) AS n FROM (SELECT 'refused' AS outcome FROM costed WHERE rule = 'capability' UNION ALL SELECT 'held' FROM costed WHERE route = 'escalate' UNION ALL SELECT 'blocked' FROM costed WHERE final_route = 'block') GROUP BY outcome", COSTED))
def a14(spark, d):
    """Review counts (A14) over the union of outcome logs (U3), in one scan."""
    outcomes = F.array_compact(F.array(F.when(F.col("rule") == "capability", F.lit("refused")), F.when(F.col("route") == "escalate", F.lit("held")), F.when(F.col("final_route") == "block", F.lit("blocked"))))
    return costed(spark, d).select(F.explode(outcomes).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


