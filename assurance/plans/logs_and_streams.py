"""Queries over the event log, and streams run over what the tables hold."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from assurance.operators import eventlog as L
from assurance.operators import scoring
from assurance.plans import views as V
from assurance.plans.decisions import with_sql
from assurance.sources import corpus_files
from assurance.streaming import streams as ST

QUERIES: dict = {}
SQL: dict[str, str] = {}
KEY = b"log signing key of the tests"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def shared(spark) -> str:
    """A new folder that driver and executors reach; a temporary one only on a local master whose session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="assurance-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def log(spark, d):
    return L.chain(L.canonical(V.decisions(spark, d)), KEY)


CANONICAL = """records AS (SELECT system_id || '/' || strftime(occurred_at, '%Y-%m-%d') AS chain, occurred_at, request_id,
  '{"action":"' || effective_action || '","event":"decision.issued","k":' || k || ',"origin":"' || origin || '","request_id":' || request_id || ',"system_id":"' || system_id || '","time":"' || strftime(occurred_at, '%Y-%m-%d %H:%M:%S') || '"}' AS record_json FROM v_decisions)"""
CHAIN = """numbered AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY occurred_at, request_id) - 1 AS idx FROM records),
log AS (WITH RECURSIVE r(chain, idx, previous_hash, hash) AS (
  SELECT chain, idx, repeat('0', 64), sha256(repeat('0', 64) || record_json) FROM numbered WHERE idx = 0
  UNION ALL SELECT n.chain, n.idx, r.hash, sha256(r.hash || n.record_json) FROM r JOIN numbered n ON n.chain = r.chain AND n.idx = r.idx + 1) SELECT * FROM r)"""


@query("l3_record_json", with_sql("SELECT chain, request_id, sha256(record_json) AS digest FROM records", V.DECISIONS, CANONICAL))
def l3(spark, d):
    r = L.canonical(V.decisions(spark, d))
    return r.select(F.concat_ws("/", "system_id", F.date_format("at", "yyyy-MM-dd")).alias("chain"), "request_id", F.sha2("record_json", 256).alias("digest"))


@query("src2_chain", with_sql("SELECT chain AS system_id, idx, previous_hash, hash FROM log", V.DECISIONS, CANONICAL, CHAIN))
def src2(spark, d):
    return log(spark, d).select("system_id", "idx", "previous_hash", "hash")


@query("l1_verify", with_sql("SELECT chain AS system_id, count(*) AS n, true AS valid, CAST(NULL AS BIGINT) AS broken_at, CAST(NULL AS VARCHAR) AS reason FROM records GROUP BY chain", V.DECISIONS, CANONICAL))
def l1(spark, d):
    return L.verify(log(spark, d), KEY)


@query("l1_tampered", with_sql("SELECT chain AS system_id, count(*) AS n, count(*) <= 3 AS valid, CASE WHEN count(*) > 3 THEN 3 END AS broken_at, CASE WHEN count(*) > 3 THEN 'hash' END AS reason FROM records GROUP BY chain", V.DECISIONS, CANONICAL))
def l1_tampered(spark, d):
    x = log(spark, d)
    return L.verify(x.withColumn("record_json", F.when(F.col("idx") == 3, F.concat("record_json", F.lit(" "))).otherwise(F.col("record_json"))), KEY)


@query("l2_tail", with_sql("SELECT chain AS system_id, CAST(right(chain, 2) AS INTEGER) % 2 = 0 AS matches FROM records GROUP BY chain HAVING count(*) > 6", V.DECISIONS, CANONICAL))
def l2(spark, d):
    """A batch from the seventh record on, against logs that end a record too early on odd days."""
    x = log(spark, d)
    return L.tail_check(x.filter("idx <= 5 - cast(right(system_id, 2) as int) % 2"), x.filter("idx > 5"))


@query("l5_digest", with_sql("SELECT chain AS system_id, sha256(count(*) || ':' || sum(('0x' || substr(hash, 1, 15))::HUGEINT)) AS digest FROM log GROUP BY chain", V.DECISIONS, CANONICAL, CHAIN))
def l5(spark, d):
    return L.batch_digest(log(spark, d))


@query("w7_links", with_sql("SELECT chain AS system_id, idx, idx <> 4 AS linked FROM log WHERE idx <> 3", V.DECISIONS, CANONICAL, CHAIN))
def w7(spark, d):
    """Links of logs from which the fourth record was taken."""
    return L.link_check(log(spark, d).filter("idx <> 3")).select("system_id", "idx", "linked")


def events_of(d):
    """Events as keyed writes: the last write of a user and event type wins, an error removes it."""
    return d.select(F.col("event_type").alias("kind"), "system_id", F.concat_ws(":", "system_id", (F.col("k") % 50).cast("string")).alias("key"), F.struct("occurred_at", "request_id").alias("seq"), F.col("k").alias("value"), (F.col("k") % 11 == 0).alias("removed"))


RECOVERED = "recovered AS (SELECT event_type AS kind, system_id || ':' || CAST(k % 50 AS VARCHAR) AS key, k AS value, k % 11 = 0 AS removed FROM v_decisions QUALIFY row_number() OVER (PARTITION BY event_type, system_id, k % 50 ORDER BY occurred_at DESC, request_id DESC) = 1)"


@query("st11_recovery", with_sql("SELECT kind, key, value FROM recovered WHERE NOT removed", V.DECISIONS, RECOVERED))
def st11(spark, d):
    return L.recover(events_of(V.decisions(spark, d))).select("kind", "key", "value")


@query("l4_counters", with_sql("SELECT kind, count(*) AS n FROM recovered WHERE NOT removed GROUP BY kind", V.DECISIONS, RECOVERED))
def l4(spark, d):
    return L.counters(events_of(V.decisions(spark, d)))


def torn_log(spark, d):
    """The log written as JSON lines, some torn, and read again."""
    x = log(spark, d)
    line = F.to_json(F.struct("hash", "idx", "previous_hash", "record_json", "signature", "system_id"))
    torn = F.get_json_object("record_json", "$.request_id").cast("long") % 97 == 0
    path = shared(spark)
    x.select(F.when(torn, F.substring(line, 1, 40)).otherwise(line).alias("value")).write.text(path)
    return L.read_log(spark.read.text(path))


@query("src1_log_scan", with_sql("SELECT count(*) AS lines, count(*) FILTER (request_id % 97 = 0) AS corrupt FROM records", V.DECISIONS, CANONICAL))
def src1(spark, d):
    return torn_log(spark, d).agg(F.count("*").alias("lines"), F.count_if("corrupt").alias("corrupt"))


@query("src9_health", with_sql("SELECT CAST(sum(n) AS BIGINT) AS lines, CAST(sum(torn) AS BIGINT) AS unreadable, count(*) FILTER (kept IS NOT NULL) AS chains, count(*) FILTER (hole < kept) AS broken FROM (SELECT chain, count(*) AS n, count(*) FILTER (request_id % 97 = 0) AS torn, max(idx) FILTER (request_id % 97 <> 0) AS kept, min(idx) FILTER (request_id % 97 = 0) AS hole FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY occurred_at, request_id) - 1 AS idx FROM records) GROUP BY chain)", V.DECISIONS, CANONICAL))
def src9(spark, d):
    """Health of the log with torn lines: a chain is broken where a line that can be read follows one that cannot."""
    x = torn_log(spark, d)
    return L.health(x, L.verify(x.filter(~F.col("corrupt")), KEY))


@query("src6_rollover", with_sql("SELECT epoch, count(*) + epoch AS n, count(DISTINCT chain) + epoch AS chains, epoch = 1 AS started, true AS valid FROM (SELECT *, CAST(k >= 50 AS INTEGER) AS epoch FROM records) GROUP BY epoch", V.DECISIONS, CANONICAL.replace("SELECT system_id ||", "SELECT k, system_id ||")))
def src6(spark, d):
    """Two epochs of the log in one store: the second begins with a record of its own and new chains."""
    x = L.canonical(V.decisions(spark, d))
    path = shared(spark)
    k = F.get_json_object("record_json", "$.k").cast("int")
    L.write_epoch(x.filter(k < 50), 0, KEY, path)
    L.write_epoch(L.rollover(x.filter(k >= 50), V.now()), 1, KEY, path)
    out = spark.read.schema(L.LOG + ", epoch int").parquet(path)
    checked = out.groupBy("epoch").agg(F.count("*").alias("n"), F.countDistinct("system_id").alias("chains"), (F.count_if(F.col("record_json").contains("epoch.started")) == 1).alias("started"))
    whole = L.verify(out.withColumn("system_id", F.concat_ws(":", F.col("epoch").cast("string"), "system_id")), KEY)
    return checked.join(whole.groupBy(F.substring_index("system_id", ":", 1).cast("int").alias("epoch")).agg(F.bool_and("valid").alias("valid")), "epoch")


@query("src3_scan", "SELECT coalesce(source, 'none') AS system_id, CAST(sum(length(coalesce(text, '')) + 1) AS BIGINT) AS n_chars FROM documents GROUP BY ALL")
def src3(spark, d):
    """The documents as text files in a folder for each source, found and read again file by file."""
    path = shared(spark)
    docs = V.table(spark, d, "documents").select(F.coalesce("source", F.lit("none")).alias("system_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs.write.partitionBy("system_id").option("maxRecordsPerFile", 500).text(path)
    found, _ = corpus_files.scan(spark, path)
    return found.groupBy(F.regexp_replace("system_id", "^system_id=", "").alias("system_id")).agg(F.sum(F.char_length("text")).alias("n_chars"))


@query("tx10_chunks")
def tx10(spark, d):
    docs = V.table(spark, d, "documents").select(F.col("source").alias("system_id"), "doc_id", "text")
    return corpus_files.chunk(docs).select("system_id", "doc_id", "ord", F.char_length("text").alias("n_chars"))


@query("tx1_nfkc")
def tx1(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.sha2(corpus_files.nfkc(F.col("text")), 256).alias("digest"))


@query("src4_store", "SELECT source AS system_id, count(*) AS n_docs FROM documents GROUP BY source")
def src4(spark, d):
    path = shared(spark)
    docs = V.table(spark, d, "documents").select(F.col("source").alias("system_id"), "doc_id", "text")
    corpus_files.store(docs, path)
    corpus_files.store(docs.filter("system_id = 'src3'"), path)
    return spark.read.parquet(path).groupBy("system_id").agg(F.count("*").alias("n_docs"))


def decision_stream(spark, d):
    """The events table as a file stream; its rows are mapped as the batch view maps them."""
    path = shared(spark)
    V.decisions(spark, d).withColumn("user_id", F.col("request_id") % 97).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


@query("st1_ingest", with_sql("SELECT system_id, count(*) AS n FROM v_decisions GROUP BY system_id", V.DECISIONS))
def st1(spark, d):
    return ST.run_once(ST.ingest(decision_stream(spark, d)), "st1", shared(spark)).groupBy("system_id").agg(F.count("*").alias("n"))


@query("st2_late_verification")
def st2(spark, d):
    x = V.decisions(spark, d)
    path = shared(spark)
    scoring.late_rows(V.detector_results(x)).filter("detector_id = 'privacy'").select("request_id", "arrived_at", "score").write.parquet(path)
    late = spark.readStream.schema("request_id long, arrived_at timestamp, score double").parquet(path)
    joined = ST.late_verification(decision_stream(spark, d).select("request_id", "occurred_at", "system_id"), late)
    out = ST.run_once(joined.select("request_id", "system_id", "score"), "st2", shared(spark))
    return out.filter("score is not null").groupBy("system_id").agg(F.count("*").alias("matched"))


SQL["st2_late_verification"] = with_sql("SELECT system_id, count(*) AS matched FROM v_detector_results WHERE status = 'queued_async' AND detector_id = 'privacy' GROUP BY system_id", V.DECISIONS, V.DETECTORS)


ROLLING = """costed_turns AS (SELECT system_id AS task, request_id AS turn_id, tokens, CAST(k % 5 AS VARCHAR) AS digest FROM v_decisions),
framed AS (SELECT task, turn_id, tokens, digest, list_sort(list(tokens) OVER w) AS b, list(digest) OVER w AS s FROM costed_turns WINDOW w AS (PARTITION BY task ORDER BY turn_id ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING)),
rolled AS (SELECT task, turn_id, CASE WHEN len(b) > 0 THEN tokens / greatest(b[len(b) // 2 + 1], 1)::DOUBLE END AS ratio, CASE WHEN len(s) > 0 THEN len(list_filter(s, lambda x: x = digest)) / len(s)::DOUBLE END AS repeated FROM framed)"""


def cost_columns():
    return F.col("system_id").alias("task"), F.col("request_id").alias("turn_id"), F.col("tokens").cast("long").alias("tokens"), (F.col("k") % 5).cast("string").alias("digest")


@query("st5_rolling_cost", with_sql("SELECT task, count(*) AS n, round_even(max(ratio), 4) AS most, round_even(max(repeated), 4) AS most_repeated FROM rolled GROUP BY task", V.DECISIONS, ROLLING))
def st5(spark, d):
    out = ST.run_once(ST.rolling_cost(decision_stream(spark, d).select(*cost_columns())), "st5", shared(spark))
    return out.groupBy("task").agg(F.count("*").alias("n"), F.bround(F.max("ratio"), 4).alias("most"), F.bround(F.max("repeated"), 4).alias("most_repeated"))


@query("st11_restarted_stream", with_sql("SELECT task, turn_id, round_even(ratio, 4) AS ratio, round_even(repeated, 4) AS repeated FROM rolled WHERE turn_id >= (SELECT max(turn_id) / 2 FROM costed_turns)", V.DECISIONS, ROLLING))
def st11_restarted(spark, d):
    """A stream that begins at the later half of the turns with what the log holds of the earlier one: it gives what one gives that never stopped."""
    x = V.decisions(spark, d).select(*cost_columns())
    half = x.agg((F.max("turn_id") / 2).alias("half")).first()[0]
    path = shared(spark)
    x.filter(F.col("turn_id") >= half).write.parquet(path)
    later = spark.readStream.schema(x.schema).parquet(path)
    out = ST.run_once(ST.rolling_cost(later, x.filter(F.col("turn_id") < half)), "st11", shared(spark))
    return out.select("task", "turn_id", F.bround("ratio", 4).alias("ratio"), F.bround("repeated", 4).alias("repeated"))


def sliding_sql(length: str, step: str, n: int) -> str:
    """Windows that the stream has closed: their end lies an hour before the newest turn at least."""
    return with_sql(
        f"SELECT start, system_id, count(*) AS turns, sum(tokens)::BIGINT AS tokens FROM (SELECT system_id, tokens, date_trunc('{step}', occurred_at)::TIMESTAMP - to_{step}s(unnest(range({n}))::INTEGER) AS start FROM v_decisions) GROUP BY ALL "
        f"HAVING start + INTERVAL '{length}' <= (SELECT max(occurred_at)::TIMESTAMP - INTERVAL 1 HOUR FROM v_decisions)",
        V.DECISIONS,
    )


@query("st8_live_windows", sliding_sql("30 minutes", "minute", 30))
def st8(spark, d):
    return ST.run_once(ST.live_windows(decision_stream(spark, d)), "st8", shared(spark))


@query("st9_week_usage", sliding_sql("7 days", "hour", 168))
def st9_week(spark, d):
    return ST.run_once(ST.budget_windows(decision_stream(spark, d)), "st9w", shared(spark))


@query("st9_month_usage", with_sql("SELECT date_trunc('month', occurred_at)::TIMESTAMP AS month, system_id, CAST(sum(tokens) AS BIGINT) AS tokens FROM v_decisions GROUP BY ALL", V.DECISIONS))
def st9(spark, d):
    out = ST.run_once(ST.month_usage(decision_stream(spark, d)), "st9", shared(spark), "update")
    return out.groupBy("month", "system_id").agg(F.max_by("tokens", "batch_id").alias("tokens"))


SESSIONS = """turns_of AS (SELECT request_id % 97 AS user_id, occurred_at::TIMESTAMP AS t FROM v_decisions),
begun AS (SELECT *, coalesce(t > lag(t) OVER w + INTERVAL 30 MINUTE, true) AS fresh FROM turns_of WINDOW w AS (PARTITION BY user_id ORDER BY t)),
placed AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS n FROM begun)"""


@query("st10_sessions", with_sql('SELECT min(t) AS start, max(t) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS turns FROM placed GROUP BY user_id, n HAVING max(t) + INTERVAL 30 MINUTE <= (SELECT max(t) - INTERVAL 1 HOUR FROM turns_of)', V.DECISIONS, SESSIONS))
def st10(spark, d):
    return ST.run_once(ST.sessions(decision_stream(spark, d)), "st10", shared(spark))


SILENT = "sent AS (SELECT system_id || ':' || CAST(request_id % 97 AS VARCHAR) AS system_id, epoch_us(occurred_at) // 1000 AS ms FROM v_decisions), gaps AS (SELECT *, lead(ms) OVER (PARTITION BY system_id ORDER BY ms) AS later FROM sent)"


@query("st3_silence", with_sql(f"SELECT system_id, ms AS silent_from FROM gaps WHERE coalesce(later, (SELECT max(ms) FROM sent) - 600000) - ms > {ST.C.SILENT_S * 1000}", V.DECISIONS, SILENT))
def st3(spark, d):
    """Users of a system that sent nothing for two hours."""
    s = decision_stream(spark, d).withColumn("system_id", F.concat_ws(":", "system_id", F.col("user_id").cast("string")))
    return ST.run_once(ST.silence(s), "st3", shared(spark))


@query("st4_control_states", with_sql(f"SELECT system_id, control_id, CASE WHEN now < valid_to THEN kind WHEN now < valid_to + INTERVAL {ST.C.RECOVERING_S} SECOND THEN 'recovering' ELSE 'healthy' END AS state FROM v_controls, (SELECT max(valid_from) - INTERVAL 30 MINUTE AS now FROM v_controls) WHERE valid_from <= now", V.DECISIONS, V.CONTROLS))
def st4(spark, d):
    """State of each control half an hour before the newest one."""
    path = shared(spark)
    c = V.controls(V.decisions(spark, d))
    c.write.parquet(path)
    out = ST.run_once(ST.control_states(spark.readStream.schema(c.schema).parquet(path)), "st4", shared(spark))
    newest = spark.read.parquet(path).agg((F.max("valid_from") - F.expr("interval 30 minutes")).alias("now"))
    return ST.state_now(out.join(newest), F.col("now"))


@query("st6_admissions")
def st6(spark, d):
    """Turns that reserve when they come and release when their work ends, against a hundredth of the budgets; every tenth never ends."""
    s = decision_stream(spark, d).join(V.systems(spark).select("system_id", (F.col("minutes_week") / 100).alias("minutes_budget"), (F.col("budget_inr") / 100).alias("spend_budget")), "system_id")
    at = F.unix_millis("occurred_at")
    steps = F.array(F.struct(at.alias("at"), (F.col("request_id") * 2).alias("seq"), F.lit("reserve").alias("kind")), F.when(F.col("k") % 10 > 0, F.struct((at + F.col("tokens") * 100).alias("at"), (F.col("request_id") * 2 + 1).alias("seq"), F.lit("release").alias("kind"))))
    used = F.col("k") / 100
    s = s.select("system_id", F.col("request_id").alias("hold"), (used * F.col("minutes_budget")).alias("minutes_used"), "minutes_budget", (F.col("k") % 2 == 0).alias("minutes_hard"), (used * F.col("spend_budget")).alias("spend_used"), "spend_budget", (F.col("k") % 3 == 0).alias("spend_hard"), F.inline(F.array_compact(steps)))
    return ST.run_once(ST.admissions(s), "st6", shared(spark))


REVIEWS = """steps AS (SELECT request_id // 4 AS held_id, request_id AS seq, (['held', 'refused', 'released', 'blocked', 'answered'])[k % 5 + 1] AS step, row_number() OVER (PARTITION BY request_id // 4 ORDER BY request_id) AS n FROM v_decisions),
reviewed AS (WITH RECURSIVE r(held_id, n, seq, status, rejected) AS (
  SELECT held_id, n, seq, CASE WHEN step IN ('held', 'refused') THEN step END, step NOT IN ('held', 'refused') FROM steps WHERE n = 1
  UNION ALL SELECT s.held_id, s.n, s.seq, CASE WHEN x.ok THEN s.step ELSE r.status END, NOT x.ok FROM r JOIN steps s ON s.held_id = r.held_id AND s.n = r.n + 1
    CROSS JOIN LATERAL (SELECT CASE WHEN r.status IS NULL THEN s.step IN ('held', 'refused') WHEN r.status IN ('held', 'refused') THEN s.step IN ('released', 'blocked') ELSE r.status = 'released' AND s.step = 'answered' END AS ok) x) SELECT * FROM r)"""


@query("st7_reviews", with_sql("SELECT held_id, seq, status, rejected FROM reviewed", V.DECISIONS, REVIEWS))
def st7(spark, d):
    steps = F.array(*map(F.lit, ("held", "refused", "released", "blocked", "answered")))
    s = decision_stream(spark, d).select(F.floor(F.col("request_id") / 4).alias("held_id"), F.col("request_id").alias("seq"), F.element_at(steps, F.col("k") % 5 + 1).alias("step"))
    return ST.run_once(ST.reviews(s), "st7", shared(spark))


@query("st12_saturation")
def st12(spark, d):
    """Three slow deferred checks of each turn; those that find their system's queue full come out as failed."""
    takes = F.col("tokens").cast("long") * 150_000
    checks = F.explode(F.array(*map(F.lit, ("privacy", "grounding", "cost")))).alias("detector_id")
    s = decision_stream(spark, d).select("system_id", F.unix_millis("occurred_at").alias("at"), "request_id", takes.alias("takes_ms"), checks)
    return ST.run_once(ST.deferred_checks(s), "st12", shared(spark))
