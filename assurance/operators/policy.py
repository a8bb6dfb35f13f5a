"""Capability, policy and control state: what a turn may do, under which thresholds, with which controls live."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assurance import config as C
from assurance.operators.windows import as_of

TIGHTEN = {"pass": 4, "repair": 4, "escalate": 6}


def rank(action: Column) -> Column:
    """Place on the action scale, null for an action that is not on it."""
    return F.element_at(F.create_map(*(x for a, r, _, _ in C.ACTIONS for x in (F.lit(a), F.lit(r)))), action)


def radius(action: Column) -> Column:
    return F.element_at(F.create_map(*(x for a, _, r, _ in C.ACTIONS for x in (F.lit(a), F.lit(r)))), action)


def resolve_capability(turns: DataFrame, systems: DataFrame, tools: DataFrame) -> DataFrame:
    """turns with effective, blast_radius, mismatch, reversible, approval, denied and snapshot.

    Registry and bindings are small dimensions, joined from the left. The checks run in a
    fixed order and the first that fails names the denial; nothing unknown is let through.
    """
    t = turns.withColumnRenamed("effective_action", "proposed_action")
    t = t.join(F.broadcast(systems.select("system_id", "audience", "regulated", "environment", "max_action", "authorised")), "system_id", "left")
    t = t.join(F.broadcast(tools.withColumn("bound", F.lit(True))), "tool_id", "left")
    known, bound = F.col("max_action").isNotNull(), F.coalesce("bound", F.lit(False))
    declared = rank(F.col("declared_action"))
    capped = F.when(declared > rank(F.col("max_action")), F.col("max_action")).otherwise(F.col("declared_action"))
    stranger = F.col("tool_id").isNotNull() & ~bound
    denied = (
        F.when(~known, "unregistered application")
        .when(stranger, "unregistered tool")
        .when(~bound & declared.isNull(), "unrecognised declared action")
        .when(bound & ~F.array_contains("environments", F.col("environment")), "tool not permitted in this environment")
        .when(bound & (F.coalesce("value", F.lit(0.0)) > F.col("max_amount")), "transaction exceeds the tool's authorised limit")
        .when(declared.isNull(), "unrecognised declared action")
    )
    effective = F.when(~known | stranger | (~bound & declared.isNull()), "execute").when(bound, F.col("tool_action")).otherwise(capped)
    t = t.withColumn("early", denied).withColumn("effective", effective)
    t = t.withColumn("denied", F.when(F.col("early").isNotNull(), F.col("early")).when(~F.array_contains("authorised", F.col("effective")), "tool proves an action the application is not authorised for"))
    refused = F.col("denied").isNotNull()
    factor = F.when(F.col("audience") == "external", C.EXTERNAL_FACTOR).otherwise(1.0) * F.when(F.col("regulated"), C.REGULATED_FACTOR).otherwise(1.0)
    whole = F.col("effective").isin(*C.IRREVERSIBLE)
    nobody = F.col("denied").isin("unregistered application", "unregistered tool") | (~bound & declared.isNull())
    return t.select(
        *turns.drop("effective_action").columns,
        "effective",
        F.when(refused, radius(F.col("effective"))).otherwise(F.least(F.lit(1.0), radius(F.col("effective")) * factor)).alias("blast_radius"),
        (refused | (declared < rank(F.col("effective")))).alias("mismatch"),
        F.when(nobody, False).when(bound, F.col("reversible")).otherwise(~whole).alias("reversible"),
        (refused | (bound & F.col("approval_required"))).alias("approval"),
        "denied",
        F.when(~refused, F.substring(F.sha2(F.concat_ws("|", "system_id", "tool_id", "effective", "environment", "audience", F.col("regulated").cast("string")), 256), 1, 16)).alias("snapshot"),
    )


CAPABILITY = """capability AS (
  SELECT request_id, system_id, occurred_at, k, value, event_type, declared_action, tokens, origin, tool_id, effective,
    CASE WHEN denied IS NOT NULL THEN r_eff ELSE least(1.0::DOUBLE, r_eff * (CASE WHEN audience = 'external' THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN regulated THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END)) END AS blast_radius,
    denied IS NOT NULL OR rk_decl < rk_eff AS mismatch,
    CASE WHEN denied IN ('unregistered application', 'unregistered tool') THEN false ELSE reversible END AS reversible,
    denied IS NOT NULL OR approval_required AS approval, denied,
    CASE WHEN denied IS NULL THEN substr(sha256(concat_ws('|', system_id, tool_id, effective, environment, audience, CASE WHEN regulated THEN 'true' ELSE 'false' END)), 1, 16) END AS snapshot
  FROM (SELECT c.*, a.radius::DOUBLE AS r_eff, a.rank AS rk_eff, b.rank AS rk_decl,
      CASE WHEN early IS NOT NULL THEN early WHEN NOT list_contains(authorised, effective) THEN 'tool proves an action the application is not authorised for' END AS denied
    FROM (SELECT d.* EXCLUDE (effective_action), s.audience, s.regulated, s.environment, s.authorised, t.reversible, t.approval_required,
        CASE WHEN t.tool_id IS NULL THEN 'execute' ELSE t.tool_action END AS effective,
        CASE WHEN t.tool_id IS NULL THEN 'unregistered tool'
          WHEN NOT list_contains(t.environments, s.environment) THEN 'tool not permitted in this environment'
          WHEN d.value > t.max_amount THEN 'transaction exceeds the tool''s authorised limit' END AS early
      FROM v_decisions d JOIN systems s USING (system_id) LEFT JOIN tools t ON d.tool_id = t.tool_id) c
    JOIN actions a ON a.action = c.effective JOIN actions b ON b.action = c.declared_action))"""


def resolve_policy(systems: DataFrame, profiles: DataFrame, jurisdictions: DataFrame, overlay: Column | None = None) -> DataFrame:
    """systems with their thresholds and weights (P2): base, less the jurisdiction's delta, weights merged by maximum.

    Nothing loosens: a threshold never rises and never falls under 1, a weight never falls.
    """
    s = systems.join(F.broadcast(profiles), "profile").join(F.broadcast(jurisdictions), "jurisdiction", "left")
    merged = F.when(F.col("j_weights").isNull(), F.col("weights")).otherwise(F.map_zip_with("weights", "j_weights", lambda k, a, b: F.greatest(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0)))))
    cut = [F.greatest(F.lit(1), F.col(f"t_{t}") - F.coalesce(f"d_{t}", F.lit(0))).alias(f"t_{t}") for t in ("pass", "repair", "escalate")]
    return s.select("system_id", "profile", "jurisdiction", *cut, merged.alias("weights"), "latency_budget_ms", "inline", "deferred", "hard_gate")


POLICY = """policy AS (
  SELECT system_id, profile, s.jurisdiction, greatest(1, t_pass - coalesce(d_pass, 0)) AS t_pass, greatest(1, t_repair - coalesce(d_repair, 0)) AS t_repair,
    greatest(1, t_escalate - coalesce(d_escalate, 0)) AS t_escalate, latency_budget_ms, inline, deferred, hard_gate
  FROM systems s JOIN profiles USING (profile) LEFT JOIN jurisdictions j ON s.jurisdiction = j.jurisdiction),
policy_weights AS (
  SELECT system_id, w.detector_id, greatest(w.weight, coalesce(j.weight, 0.0))::DOUBLE AS weight
  FROM systems s JOIN weights w USING (profile) LEFT JOIN j_weights j ON s.jurisdiction = j.jurisdiction AND w.detector_id = j.detector_id)"""


def live_controls(points: DataFrame, controls: DataFrame, after_s: int = 0) -> DataFrame:
    """Pairs of a point (request_id, system_id, occurred_at) and a control whose interval, and after_s more, holds it.

    An interval join without a scan of all controls: both sides meet on the system and the
    hours that the interval touches, so the join is an equi-join that Spark can hash.
    """
    end = F.col("valid_to") + F.make_dt_interval(secs=F.lit(after_s))
    c = controls.withColumn("hour", F.explode(F.sequence(F.date_trunc("hour", "valid_from"), F.date_trunc("hour", end), F.expr("interval 1 hour"))))
    p = points.select("request_id", "system_id", "occurred_at").withColumn("hour", F.date_trunc("hour", "occurred_at"))
    return p.join(c, ["system_id", "hour"]).filter((F.col("occurred_at") >= F.col("valid_from")) & (F.col("occurred_at") < end)).drop("hour")


def parsed(payload: Column) -> Column:
    """struct(scalars, lists, dicts) of a JSON payload: arrays of struct(key, value), where a value is a string, an array of strings, or an array of struct(key, value)."""
    every = F.coalesce(F.from_json(payload, "map<string,string>"), F.create_map().cast("map<string,string>"))
    kind = lambda sign: F.map_entries(F.map_filter(every, lambda _, v: F.coalesce(v.startswith(sign), F.lit(False))))
    plain = F.map_entries(F.map_filter(every, lambda _, v: ~F.coalesce(v.startswith("[") | v.startswith("{"), F.lit(False))))
    put = lambda e, value: F.struct(e["key"].alias("key"), value.alias("value"))
    lists = F.transform(kind("["), lambda e: put(e, F.coalesce(F.from_json(e["value"], "array<string>"), F.array().cast("array<string>"))))
    dicts = F.transform(kind("{"), lambda e: put(e, F.coalesce(F.map_entries(F.from_json(e["value"], "map<string,string>")), F.array().cast("array<struct<key:string,value:string>>"))))
    return F.struct(plain.alias("scalars"), lists.alias("lists"), dicts.alias("dicts"))


def folded(layers: Column) -> list[Column]:
    """Maps scalars, lists and dicts of an array of parsed payloads, later ones on top: members of a dict are updated, lists are extended, anything else is overwritten by what is not null."""
    bound = lambda x, f: F.get(F.transform(F.array(x), f), 0)

    def by_key(pairs: Column, value: Callable[[Column], Column]) -> Column:
        """Each key with the value of its pairs, in order."""
        keys = lambda p: F.array_distinct(F.transform(p, lambda e: e["key"]))
        return bound(pairs, lambda p: F.map_from_entries(F.transform(keys(p), lambda k: F.struct(k, value(F.transform(F.filter(p, lambda e: e["key"] == k), lambda e: e["value"]))))))

    last = lambda values: F.try_element_at(F.filter(values, lambda v: v.isNotNull()), F.lit(-1))
    pairs = lambda name: F.flatten(F.transform(layers, lambda x: x["layer"][name]))
    return [by_key(pairs("scalars"), last).alias("scalars"), by_key(pairs("lists"), F.flatten).alias("lists"), by_key(pairs("dicts"), lambda v: by_key(F.flatten(v), last)).alias("dicts")]


def timeline(controls: DataFrame) -> DataFrame:
    """(system_id, from_at, n_live, kinds, last_control, scalars, lists, dicts): elementary intervals of each system, with the controls live in them folded by version.

    controls: (control_id, system_id, kind, version, payload as JSON, valid_from, valid_to). Their
    ends cut a system's time into intervals in which nothing changes, so payloads are folded
    once an interval, not once a decision. Each payload is parsed once; the controls that touch
    an hour of a system are sorted once, and its intervals pick the live ones of them, so no
    pair of an interval and a control is shuffled.
    """
    hour = lambda c: F.date_trunc("hour", c)
    ends = controls.select("system_id", F.explode(F.array("valid_from", "valid_to")).alias("from_at"))
    ends = ends.groupBy("system_id", hour("from_at").alias("hour")).agg(F.collect_set("from_at").alias("times"))
    rows = controls.select("system_id", F.struct("version", "control_id", "kind", "valid_from", "valid_to", parsed(F.col("payload")).alias("layer")).alias("c"))
    rows = rows.withColumn("hour", F.explode(F.sequence(hour("c.valid_from"), hour("c.valid_to"), F.expr("interval 1 hour"))))
    touching = rows.groupBy("system_id", "hour").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    each = ends.join(touching, ["system_id", "hour"]).select("system_id", F.explode("times").alias("from_at"), "cs")
    live = each.select("system_id", "from_at", F.filter("cs", lambda c: (c["valid_from"] <= F.col("from_at")) & (c["valid_to"] > F.col("from_at"))).alias("live"))
    column = lambda name: F.transform("live", lambda c: c[name])
    some = lambda x: F.when(F.size("live") > 0, x)
    return live.select(
        "system_id",
        "from_at",
        some(F.size("live").cast("long")).alias("n_live"),
        some(F.array_join(F.array_sort(F.array_distinct(column("kind"))), ",")).alias("kinds"),
        F.array_max(column("control_id")).alias("last_control"),
        *folded(F.col("live")),
    )


FOLDED = ("scalars", "lists", "dicts")


def overlays(points: DataFrame, controls: DataFrame, *columns: Column) -> DataFrame:
    """(request_id, system_id, n_live, kinds, last_control, scalars, lists, dicts) of each point that controls bear on.

    A point meets the interval that began last before it, as of its time. With columns of
    scalars, lists and dicts, these are made once an interval and stand in their place.
    """
    intervals = timeline(controls)
    ends = controls.select("system_id", F.explode(F.array("valid_from", "valid_to")).alias("from_at")).distinct()
    at = as_of(points.select("request_id", "system_id", "occurred_at"), ends, "system_id", "occurred_at", "from_at", F.unix_micros("from_at"), "interval")
    live = intervals.filter("n_live > 0").select("system_id", F.unix_micros("from_at").alias("interval"), "n_live", "kinds", "last_control", *(columns or FOLDED))
    return at.join(live, ["system_id", "interval"]).select("request_id", "system_id", *live.columns[2:])


def strongest(points: DataFrame, controls: DataFrame, value: Column, name: str) -> DataFrame:
    """(request_id, system_id, name): the largest value of the controls live at each point that has one.

    It is found once for each elementary interval between the ends of controls, and a point
    reads the interval that began last before it: points and controls are never paired.
    """
    ends = controls.select("system_id", F.explode(F.array("valid_from", "valid_to")).alias("occurred_at")).distinct()
    live = live_controls(ends.withColumn("request_id", F.unix_micros("occurred_at")), controls.select("system_id", "valid_from", "valid_to", value.alias("__value")))
    inside = live.groupBy("system_id", F.col("occurred_at").alias("from_at")).agg(F.max("__value").alias("__value"))
    intervals = ends.select("system_id", F.col("occurred_at").alias("from_at")).join(inside, ["system_id", "from_at"], "left")
    at = as_of(points.select("request_id", "system_id", "occurred_at"), intervals, "system_id", "occurred_at", "from_at", F.struct("__value"), name)  # an interval without a control is a value too
    return at.filter(F.col(name)["__value"].isNotNull()).select("request_id", "system_id", F.col(name)["__value"].alias(name))


def system_states(points: DataFrame, controls: DataFrame) -> DataFrame:
    """State of its system at each point (P4): the strongest live control, recovering for a while after, else healthy."""
    pairs = live_controls(points, controls, C.RECOVERING_S)
    live = F.col("occurred_at") < F.col("valid_to")
    flags = pairs.groupBy("request_id").agg(*(F.bool_or(live & (F.col("kind") == k)).alias(k) for k, _ in C.STATE_BY_KIND), F.bool_or(~live & F.col("kind").isin(*(k for k, _ in C.STATE_BY_KIND))).alias("ended"))
    state = F.lit(None).cast("string")
    state = F.when(F.col("ended"), "recovering").otherwise("healthy")
    for kind, name in reversed(C.STATE_BY_KIND):
        state = F.when(F.col(kind), name).otherwise(state)
    return points.select("request_id", "system_id").join(flags, "request_id", "left").select("request_id", "system_id", state.alias("state"))


def deadline_status(runs: DataFrame, policy: DataFrame) -> DataFrame:
    """Status of each detector run (P18): scheduled later, not scheduled, too late for the profile, or completed."""
    r = runs.join(F.broadcast(policy.select("system_id", "latency_budget_ms", "inline", "deferred")), "system_id")
    status = (
        F.when(F.array_contains("deferred", F.col("detector_id")) & ~F.array_contains("inline", F.col("detector_id")), "queued_async")
        .when(~F.array_contains("inline", F.col("detector_id")), "failed")
        .when(F.col("latency_ms") > F.col("latency_budget_ms"), "timed_out")
        .otherwise("completed")
    )
    return r.select("request_id", "system_id", "detector_id", "requirement", "latency_ms", status.alias("status"))


def intersect_grants(systems: DataFrame) -> DataFrame:
    """Effective grants (P17): what the tool proves, the application declares and the policy trusts; mismatch if any is outside."""
    trusted = F.array(*map(F.lit, ("read", "draft", "advise")))
    return systems.select(
        "system_id",
        F.array_join(F.array_sort(F.array_intersect("authorised", trusted)), ",").alias("effective"),
        F.array_join(F.array_sort(F.array_except("authorised", trusted)), ",").alias("outside"),
        (F.size(F.array_except("authorised", trusted)) > 0).alias("mismatch"),
    )
