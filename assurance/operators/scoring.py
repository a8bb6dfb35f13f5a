"""Prices and governance of decisions from their detector results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assurance import config as C
from assurance.operators.corpus import few

RAN = ("completed", "completed_async")


def noisy_or(values: Column) -> Column:
    """A sorted array's first value, and half of what the others add by noisy-or."""
    rest = F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.lit(1.0), lambda s, x: s * (1 - x))
    top = F.get(values, 0)
    return top + (1 - top) * 0.5 * (1 - rest)


def price(results: DataFrame, weights: DataFrame, radius: DataFrame) -> DataFrame:
    """(request_id, p_failure, price, confidence, band_low, band_high, dominant, labels) (P5).

    results: detector rows; weights: (system_id, weights map); radius: (request_id,
    blast_radius). Only rows that ran and have a score count; a decision without any is
    priced 0 with confidence 0.3. Ties for the dominant detector go to the earlier one.
    """
    r = results.join(few(weights.select("system_id", "weights")), "system_id", "left")
    counts = F.col("status").isin(*RAN) & F.col("score").isNotNull()
    weighted = F.least(F.lit(1.0), F.col("score") * F.coalesce(F.element_at("weights", F.col("detector_id")), F.lit(1.0)))
    item = F.when(counts, F.struct(weighted.alias("v"), (-F.col("monitor_ord")).alias("o"), F.col("detector_id").alias("d")))
    g = r.groupBy("request_id").agg(
        F.sort_array(F.collect_list(item), asc=False).alias("items"),
        F.avg(F.when(counts, F.coalesce("confidence", F.lit(0.0)))).alias("mean_confidence"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(counts, F.col("labels")))))).alias("labels"),
    )
    p = F.when(F.size("items") == 0, 0.0).otherwise(noisy_or(F.transform("items", lambda i: i["v"])))
    g = g.join(radius.select("request_id", "blast_radius"), "request_id").withColumn("p", p)
    g = g.withColumn("price", F.bround(F.least(F.lit(100.0), F.col("p") * F.col("blast_radius") * 100), 0).cast("int"))
    half = F.when(F.size("items") == 0, 0).otherwise(F.bround((1 - F.col("mean_confidence")) * C.BAND_WIDTH, 0).cast("int"))
    return g.select(
        "request_id",
        (F.floor(F.col("p") * 1e6) / 1e6).alias("p_failure"),
        "price",
        F.bround(F.coalesce("mean_confidence", F.lit(0.3)), 3).alias("confidence"),
        F.greatest(F.lit(0), F.col("price") - half).alias("band_low"),
        F.least(F.lit(100), F.col("price") + half).alias("band_high"),
        F.get("items", 0)["d"].alias("dominant"),
        "labels",
    )


RISK = """risk_items AS (
  SELECT r.request_id, least(1.0::DOUBLE, score * coalesce(weight, 1.0)) AS v, monitor_ord, r.detector_id, confidence, labels
  FROM {results} r LEFT JOIN policy_weights w ON r.system_id = w.system_id AND r.detector_id = w.detector_id
  WHERE status IN ('completed', 'completed_async') AND score IS NOT NULL),
risk_sums AS (
  SELECT request_id, list(v ORDER BY v DESC, monitor_ord) AS vs, first(detector_id ORDER BY v DESC, monitor_ord) AS dominant, avg(confidence) AS c,
    list_sort(list_distinct(flatten(list(labels)))) AS labels FROM risk_items GROUP BY request_id),
risk AS (
  SELECT c.request_id, c.blast_radius, floor(p * 1e6) / 1e6 AS p_failure, CAST(round_even(least(100.0::DOUBLE, p * c.blast_radius * 100), 0) AS INTEGER) AS price,
    round_even(coalesce(s.c, 0.3), 3) AS confidence, coalesce(CAST(round_even((1 - s.c) * 22, 0) AS INTEGER), 0) AS half, dominant, coalesce(labels, []::VARCHAR[]) AS labels
  FROM (SELECT request_id, blast_radius FROM capability) c
  LEFT JOIN (SELECT *, vs[1] + (1 - vs[1]) * 0.5::DOUBLE * (1 - list_reduce(list_prepend(1.0::DOUBLE, list_transform(vs[2:], lambda x: 1 - x)), lambda x, y: x * y)) AS p0 FROM risk_sums) s ON c.request_id = s.request_id
  CROSS JOIN LATERAL (SELECT coalesce(s.p0, 0.0::DOUBLE) AS p))"""


def govern(results: DataFrame, capability: DataFrame) -> DataFrame:
    """(request_id, governance, fully_governed, missing, pending, advisory, fail_closed)."""
    out = ~F.col("status").isin(*RAN, "skipped_by_policy")
    must, queued = F.col("requirement") == "mandatory", F.col("status") == "queued_async"

    def names(condition: Column) -> Column:
        found = F.sort_array(F.collect_list(F.when(condition, F.struct("monitor_ord", "detector_id"))))
        return F.array_join(F.transform(found, lambda x: x["detector_id"]), ",")

    g = results.groupBy("request_id").agg(
        names(out & must & ~queued).alias("missing"), names(out & must & queued).alias("pending"), names(out & ~must & ~queued).alias("advisory"), F.bool_or(out & must & (F.col("status") == "failed")).alias("broke")
    )
    status = F.when(F.col("missing") != "", F.when(F.col("broke"), "ungoverned_due_to_failure").otherwise("ungoverned_due_to_timeout")).when(F.col("pending") != "", "awaiting_verification").when(F.col("advisory") != "", "partially_governed").otherwise("fully_governed")
    g = g.join(capability.select("request_id", "effective"), "request_id").withColumn("governance", status)
    gap = (F.col("missing") != "") | (F.col("pending") != "")
    return g.select("request_id", "governance", (F.col("governance") == "fully_governed").alias("fully_governed"), "missing", "pending", "advisory", (gap & F.col("effective").isin(*C.IRREVERSIBLE)).alias("fail_closed"))


GOVERN = """governance AS (
  SELECT g.request_id, governance, governance = 'fully_governed' AS fully_governed, missing, pending, advisory,
    (missing <> '' OR pending <> '') AND effective IN ('decide', 'execute') AS fail_closed
  FROM (SELECT *, CASE WHEN missing <> '' THEN CASE WHEN broke THEN 'ungoverned_due_to_failure' ELSE 'ungoverned_due_to_timeout' END
      WHEN pending <> '' THEN 'awaiting_verification' WHEN advisory <> '' THEN 'partially_governed' ELSE 'fully_governed' END AS governance
    FROM (SELECT request_id,
        coalesce(string_agg(CASE WHEN gap AND must AND NOT queued THEN detector_id END, ',' ORDER BY monitor_ord), '') AS missing,
        coalesce(string_agg(CASE WHEN gap AND must AND queued THEN detector_id END, ',' ORDER BY monitor_ord), '') AS pending,
        coalesce(string_agg(CASE WHEN gap AND NOT must AND NOT queued THEN detector_id END, ',' ORDER BY monitor_ord), '') AS advisory,
        bool_or(gap AND must AND status = 'failed') AS broke
      FROM (SELECT *, status NOT IN ('completed', 'completed_async', 'skipped_by_policy') AS gap, requirement = 'mandatory' AS must, status = 'queued_async' AS queued FROM {results})
      GROUP BY request_id)) g JOIN capability c ON g.request_id = c.request_id)"""


def costs(decided: DataFrame) -> DataFrame:
    """decided with spend, review_minutes and review_cost (P10)."""
    minutes = F.element_at(F.create_map(*(x for k, v in C.REVIEW_MINUTES.items() for x in (F.lit(k), F.lit(v)))), F.col("route"))
    return decided.withColumn("spend", F.col("tokens") / 1000 * C.INR_PER_1K_TOKENS).withColumn("review_minutes", minutes).withColumn("review_cost", minutes * C.INR_PER_REVIEW_MINUTE)


def late_rows(results: DataFrame) -> DataFrame:
    """The queued rows issued again as completed, k minutes later."""
    return results.filter("status = 'queued_async'").withColumn("status", F.lit("completed_async")).withColumn("arrived_at", F.col("occurred_at") + F.make_dt_interval(mins=F.col("k")))


def replace_late(results: DataFrame, late: DataFrame) -> DataFrame:
    """Evidence after late results have come (P13): a late row takes the place of the queued or timed-out one."""
    late = late.select(results.columns)
    waiting = F.col("status").isin("queued_async", "timed_out")
    stay = results.filter(~waiting).unionByName(results.filter(waiting).join(late.select("request_id", "detector_id"), ["request_id", "detector_id"], "left_anti").select(results.columns))
    return stay.unionByName(late)
