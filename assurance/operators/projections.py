"""Projections of decisions: per system, per fleet, per period, and what windows say about order and recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assurance import config as C

ROUTES = ("pass", "repair", "escalate", "block")


def month_start(now: Column) -> Column:
    return F.date_trunc("month", now)


def week_start(now: Column) -> Column:
    return now - F.make_dt_interval(secs=F.lit(C.REVIEW_WINDOW_S))


def completeness() -> Column:
    """Governed share by consequence (A4); null without decisions."""
    return F.bround(F.sum(F.when(F.col("fully_governed"), F.col("blast_radius")).otherwise(0.0)) / F.nullif(F.sum("blast_radius"), F.lit(0.0)), 4)


def portfolio(costed: DataFrame, systems: DataFrame, now: Column) -> DataFrame:
    """One card for each registered system (A1), status and reason (A2); systems without decisions stay with nulls and zeros.

    One partial aggregation; lifetime, month and week are conditional sums of the same scan.
    """
    in_month, in_week, user = F.col("occurred_at") >= month_start(now), F.col("occurred_at") >= week_start(now), F.col("origin") == "user"
    cards = costed.groupBy("system_id").agg(
        F.count("*").alias("decisions"),
        *(F.count_if(F.col("final_route") == r).alias(r) for r in ROUTES),
        F.sum("price").alias("exposure"),
        completeness().alias("completeness"),
        F.sum(F.when(in_month, F.col("tokens")).otherwise(0)).alias("month_tokens"),
        F.sum(F.when(in_week, F.col("review_minutes")).otherwise(0.0)).alias("week_minutes"),
        F.count_if(user).alias("live"),
        F.count_if(~user).alias("synthetic"),
        F.max("occurred_at").alias("last_seen"),
    )
    c = systems.select("system_id", "budget_inr", "minutes_week", "spend_baseline", "review_baseline").join(cards, "system_id", "left")
    spend = F.coalesce(F.col("month_tokens") * C.INR_PER_1K_TOKENS / 1000, F.lit(0.0)) + F.col("spend_baseline")
    minutes = F.coalesce("week_minutes", F.lit(0.0)) + F.col("review_baseline")
    c = c.withColumn("spend", F.bround(spend, 4)).withColumn("review", F.bround(minutes, 4))
    share = F.greatest(F.col("spend") / F.col("budget_inr"), F.col("review") / F.col("minutes_week"))
    silent = F.col("last_seen").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("last_seen") > C.SILENT_S)
    reason = (
        F.when(silent, "no recent signal")
        .when(share > 1, "over budget")
        .when(F.col("block") > F.col("decisions") * 0.7, "blocks")
        .when(F.col("completeness") < 0.6, "incomplete checks")
        .when(share > 0.7, "approaching a budget")
        .otherwise("within budgets")
    )
    c = c.withColumn("reason", reason)
    status = F.when(F.col("reason") == "no recent signal", "unknown").when(F.col("reason").isin("over budget", "blocks", "incomplete checks"), "breaching").otherwise("governed")
    per_100 = F.bround(F.col("exposure") * 100 / F.col("decisions"), 4)
    return c.select("system_id", "decisions", *ROUTES, "exposure", per_100.alias("exposure_per_100"), "completeness", "spend", "review", "live", "synthetic", status.alias("status"), "reason")


def percentile_rank(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles (A5): the value at place floor(n * q), from a histogram of values, so no group is gathered."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by)
    up_to = F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.select(by, value, up_to.alias("up_to"), F.sum("n").over(w).alias("total"))
    return counts.groupBy(by).agg(*(F.min(F.when(F.col("up_to") > F.least(F.col("total") - 1, F.floor(F.col("total") * q)), F.col(value))).alias(k) for k, q in shares.items()))


def capacity(usage: DataFrame) -> DataFrame:
    """usage (system_id, used, reserved, budget) with load and state."""
    load = (F.col("used") + F.col("reserved")) / F.col("budget")
    return usage.withColumn("load", F.bround(load, 4)).withColumn("state", F.when(load >= 1, "exhausted").when(load >= 0.85, "warning").otherwise("ok"))


def burn_rate(spend: DataFrame, now: DataFrame) -> DataFrame:
    """Forecast of each system's month (A10): spend (system_id, occurred_on, spend); now: one row (now).

    Month-to-date spend over the days gone gives the pace; the budget is what the month
    before cost. Before the third day there is no forecast. Lifetime sums, which the
    month's budget must not be held against, are kept beside it.
    """
    s = spend.join(F.broadcast(now))
    this, before = F.date_trunc("month", "now"), F.add_months(F.date_trunc("month", "now"), -1)
    day = F.col("occurred_on")
    g = s.groupBy("system_id").agg(
        F.max("now").alias("now"),
        F.coalesce(F.sum(F.when(day >= this, F.col("spend"))), F.lit(0)).alias("month_to_date"),
        F.coalesce(F.sum(F.when((day >= before) & (day < this), F.col("spend"))), F.lit(0)).alias("budget"),
        F.sum("spend").alias("lifetime"),
    )
    mtd, budget, days, length = F.col("month_to_date").cast("double"), F.col("budget").cast("double"), F.dayofmonth("now"), F.dayofmonth(F.last_day("now"))
    per_day = mtd / days
    left = (budget - mtd) / F.nullif(per_day, F.lit(0.0))
    state = F.when(days < 3, "too_early").when(mtd >= budget, "exhausted").when(left <= 3, "critical").when(left <= 7, "warning").otherwise("steady")
    return g.select(
        "system_id",
        mtd.alias("month_to_date"),
        F.col("lifetime").cast("double").alias("lifetime"),
        F.bround(per_day, 2).alias("per_day"),
        F.bround(per_day * length, 2).alias("month_projection"),
        F.bround(left, 2).alias("days_left"),
        state.alias("state"),
        F.when((days >= 3) & (mtd < budget), F.date_format(F.date_add("now", F.ceil(left).cast("int")), "dd MMM")).alias("exhausted_on"),
    )


def trend(decided: DataFrame) -> DataFrame:
    """Traffic of the last third of each system's span against the two before (A11); four decisions at least."""
    w = Window.partitionBy("system_id")
    t = F.unix_micros("occurred_at")
    span = decided.groupBy("system_id").agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
    d = decided.join(span, "system_id").withColumn("late", F.unix_micros("occurred_at") > F.col("lo") + (F.col("hi") - F.col("lo")) * 2 / 3)
    g = d.groupBy("system_id").agg(F.count("*").alias("n"), F.count_if("late").alias("recent"), F.count_if(~F.col("late")).alias("earlier"))
    ratio = F.col("recent") / F.nullif(F.col("earlier") / 2, F.lit(0.0))
    return g.select("system_id", "n", "recent", "earlier", F.when(F.col("n") < 4, "unknown").when(ratio > 1.25, "rising").when(ratio < 0.8, "falling").otherwise("steady").alias("trend"))


def latest(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The newest row of each key (W3), as one max of a struct with map-side combine."""
    top = df.groupBy(*keys).agg(F.max(F.struct(*order, *(c for c in columns if c not in order))).alias("x"))
    return top.select(*keys, *(F.col(f"x.{c}").alias(c) for c in columns))


def history(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n rows of each key (W4); ranks over n are dropped before the shuffle by Spark's group limit."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("place", r).filter(F.col("place") <= n)


# Names and order of the rules. The sentences are our own: what stands before a rule's figure, its factor, and what follows.
ADVICE = {
    "CAPABILITY.ACTION_MISMATCH": ("", 1, " turns did more than they had declared; restrict the tool."),
    "COST.DUPLICATE_PROMPTS": ("", 100, " of 100 prompts came before; answer those from a cache."),
    "COST.BUDGET_EXCEEDED": ("The spend of ", 1, " is over the budget of the month; suspend the system."),
    "GOVERNANCE.LOW_COMPLETENESS": ("Only ", 100, " of 100 mandatory checks ran; run them before the release."),
    "SAFETY.COUNTERFACTUAL_FLIP": ("", 1, " outcomes changed with a swapped attribute; let a person decide."),
    "PRIVACY.UNMASKED_IDENTIFIERS": ("", 1, " turns hold identifiers; let a person see them first."),
    "COST.BURN_RATE_PROJECTION": ("At this rate the month ends at ", 1, "; use a cache."),
}


def advisories(cards: DataFrame, signals: DataFrame, burn: DataFrame) -> DataFrame:
    """Rule-derived advice (A12): each rule that holds gives a row with severity, evidence, the control it proposes, and a sentence with the figure.

    cards: portfolio; signals: (system_id, mismatches, duplicate_share, flips, identifiers);
    burn: burn_rate.
    """
    c = cards.join(signals, "system_id", "left").join(burn.select("system_id", "state", "days_left", "per_day", "month_to_date", "month_projection"), "system_id", "left")
    over = (F.col("days_left") > 0) & (F.col("month_projection") > F.col("month_to_date") + F.col("days_left") * F.col("per_day"))
    rules = [
        (F.col("mismatches") > 0, F.lit("high"), F.col("mismatches").cast("double"), "tool_restricted"),
        (F.col("duplicate_share") >= 0.5, F.lit("medium"), F.col("duplicate_share"), "enable_cache"),
        (F.col("reason") == "over budget", F.lit("high"), F.col("spend"), "suspend"),
        (F.col("completeness") < 0.9, F.lit("high"), F.col("completeness"), "promote_inline"),
        (F.col("flips") > 0, F.lit("high"), F.col("flips").cast("double"), "require_human"),
        (F.col("identifiers") > 0, F.lit("high"), F.col("identifiers").cast("double"), "require_human"),
        (F.col("days_left").isNotNull() & (F.col("state").isin("critical", "warning") | (over & (F.col("state") != "too_early"))), F.when(F.col("state") == "critical", "high").otherwise("medium"), F.col("month_projection"), "enable_cache"),
    ]
    said = lambda e, before, factor, after: F.concat(F.lit(before), F.floor(e * factor + 1e-6).cast("string"), F.lit(after))
    row = lambda i, r, s, e, k: F.struct(F.lit(i + 1).alias("rule_ord"), F.lit(r).alias("rule"), s.alias("severity"), e.alias("evidence"), F.lit(k).alias("control"), said(e, *ADVICE[r]).alias("advice"))
    found = F.array_compact(F.array(*(F.when(ok, row(i, r, s, e, k)) for i, (r, (ok, s, e, k)) in enumerate(zip(ADVICE, rules, strict=True)))))
    savings = F.bround(F.col("spend") * F.coalesce("duplicate_share", F.lit(0.0)) * 0.55, 2)
    return c.withColumn("savings", savings).select("system_id", "savings", F.inline(found))
