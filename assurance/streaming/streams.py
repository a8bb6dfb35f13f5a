"""Streams of decisions, results and controls; each has a batch twin that its tests compare it with."""

from __future__ import annotations

import tempfile
from bisect import bisect_left, bisect_right, insort
from collections import Counter, deque
from collections.abc import Iterator
from contextlib import ExitStack

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from assurance import config as C
from assurance.operators.projections import history

#: Rows of a frame that a processor gives out at once.
OUT_ROWS = 10_000
#: Rows of a key that are sorted at once, and of a sorted run that are read at once.
RUN_ROWS, BLOCK_ROWS = 200_000, 5_000
#: Questions whose reviews stand in one state.
HELD_TOGETHER = 1000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Decisions once each (ST1): repeats within the watermark are dropped."""
    return stream.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(["request_id"])


def late_verification(decisions: DataFrame, results: DataFrame, delay: str = "2 hours", within: str = "interval 3 hours") -> DataFrame:
    """Decisions beside the results that came later (ST2, J10); a decision without one comes out once the watermark has passed."""
    d = decisions.withWatermark("occurred_at", delay).alias("d")
    r = results.withColumnRenamed("request_id", "r_request_id").withWatermark("arrived_at", delay).alias("r")
    on = (F.col("d.request_id") == F.col("r.r_request_id")) & (F.col("r.arrived_at") >= F.col("d.occurred_at")) & (F.col("r.arrived_at") <= F.col("d.occurred_at") + F.expr(within))
    return d.join(r, on, "leftOuter")


def live_windows(stream: DataFrame, length: str = "30 minutes", step: str = "1 minute", delay: str = "1 hour") -> DataFrame:
    """Turns and tokens of each system in sliding windows (ST8); equal length and step tumble.

    Turns are summed into panes of one step first, and windows are made of panes: what is
    copied into every window that overlaps is one row a pane, not one a turn.
    """
    panes = stream.withWatermark("occurred_at", delay).groupBy(F.window("occurred_at", step), "system_id").agg(F.count("*").alias("turns"), F.sum("tokens").alias("tokens"))
    if length != step:
        panes = panes.groupBy(F.window(F.window_time("window"), length, step), "system_id").agg(F.sum("turns").alias("turns"), F.sum("tokens").alias("tokens"))
    return panes.select(F.col("window.start").alias("start"), "system_id", "turns", "tokens")


def budget_windows(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Seven days sliding by the hour (ST9); calendar months are a key, see month_usage."""
    return live_windows(stream, "7 days", "1 hour", delay)


def month_usage(stream: DataFrame, delay: str = "40 days") -> DataFrame:
    """Tokens of each system and calendar month (ST9), in update mode; a month's state goes once the delay after it has passed."""
    return stream.withColumn("month", F.date_trunc("month", "occurred_at")).withWatermark("month", delay).groupBy("month", "system_id").agg(F.sum("tokens").alias("tokens"))


def sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Turns of each user's sessions (ST10) where no session id exists."""
    s = stream.withWatermark("occurred_at", delay).groupBy(F.session_window("occurred_at", gap), "user_id").agg(F.count("*").alias("turns"))
    return s.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "turns")


class Silence(StatefulProcessor):
    """An alert once a system has sent nothing for SILENT_S of event time (ST3), whether the watermark or the next row shows it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, told boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, told = self.last.get() if self.last.exists() else (None, False)
        for b in in_order(rows, "at", ["at"]):
            silent = []
            for at in b["at"]:
                if last is not None and at - last > C.SILENT_S * 1000 and not told:
                    silent.append(last)
                if last is None or at > last:
                    last, told = int(at), False
            if silent:
                yield pd.DataFrame({"system_id": [key[0]] * len(silent), "silent_from": silent})
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.last.update((last, told))
        if not told:
            self.handle.registerTimer(last + C.SILENT_S * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0]
        self.last.update((last, True))
        yield pd.DataFrame({"system_id": [key[0]], "silent_from": [last]})

    def close(self) -> None:
        pass


def silence(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(system_id, silent_from) alerts of Silence."""
    s = stream.withWatermark("occurred_at", delay).select("system_id", "occurred_at", F.unix_millis("occurred_at").alias("at"))
    return s.groupBy("system_id").transformWithStateInPandas(Silence(), "system_id string, silent_from long", "append", "EventTime")


def in_order(rows: Iterator[pd.DataFrame], by: str | list[str], columns: list[str]) -> Iterator[pd.DataFrame]:
    """All rows of a key in one micro-batch in order of columns, at most OUT_ROWS at once: they come in several frames in shuffle order.

    Beyond RUN_ROWS they are sorted in runs, which wait in a temporary file of the task and are merged block by
    block, so what is held is one run, or one block of each run, of these columns only.
    """
    by = [by] if isinstance(by, str) else by
    held, n, runs = [], 0, []
    with ExitStack() as files:
        for b in rows:
            for at in range(0, len(b), RUN_ROWS):
                part = b[columns].iloc[at : at + RUN_ROWS]
                if n and n + len(part) > RUN_ROWS:
                    runs.append(stored_run(ordered(held, by), files))
                    held, n = [], 0
                held.append(part)
                n += len(part)
        if not held:
            return
        last = ordered(held, by)
        blocks = (last.iloc[at : at + OUT_ROWS] for at in range(0, len(last), OUT_ROWS))
        yield from blocks if not runs else merged([*runs, blocks], by)


def ordered(frames: list[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(frames, ignore_index=True).sort_values(by, kind="stable", ignore_index=True)


def stored_run(run: pd.DataFrame, files: ExitStack) -> Iterator[pd.DataFrame]:
    """Blocks of a sorted run, read back from a file that goes with the task."""
    file = files.enter_context(tempfile.TemporaryFile())
    table = pa.Table.from_pandas(run, preserve_index=False)
    with pa.ipc.new_file(file, table.schema) as out:
        out.write_table(table, max_chunksize=BLOCK_ROWS)
    reader = pa.ipc.open_file(file)
    return (reader.get_batch(i).to_pandas() for i in range(reader.num_record_batches))


def merged(runs: list[Iterator[pd.DataFrame]], by: list[str]) -> Iterator[pd.DataFrame]:
    """Rows of sorted runs in order: up to the least of the blocks' last rows nothing that is still to be read can come."""
    heads = [h for h in ((next(r, None), r) for r in runs) if h[0] is not None]
    while heads:
        least = min(tuple(block[by].iloc[-1]) for block, _ in heads)
        ready, waiting = [], []
        for block, run in heads:
            n = bisect_right(range(len(block)), least, key=lambda i, block=block: tuple(block[c].iat[i] for c in by))
            ready.append(block.iloc[:n])
            rest = block.iloc[n:] if n < len(block) else next(run, None)
            if rest is not None:
                waiting.append((rest, run))
        heads = waiting
        out = ordered(ready, by)
        for at in range(0, len(out), OUT_ROWS):
            yield out.iloc[at : at + OUT_ROWS]


def keep(state, rows: list[tuple]) -> None:
    """Store a list state, which cannot hold an empty list."""
    if rows:
        state.put(rows)
    else:
        state.clear()


class RollingCost(StatefulProcessor):
    """Cost and repetition of each turn against the class's last LAST turns (ST5), which are its bounded state; turns of a micro-batch go by turn_id."""

    LAST = 200

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "tokens long, digest string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        """What the log holds of the class (ST11): its last turns, as if the stream had seen them."""
        rows = initialState.sort_values("turn_id").tail(self.LAST)
        keep(self.seen, [(int(t), str(d)) for t, d in zip(rows["tokens"], rows["digest"], strict=True)])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = deque(((r[0], r[1]) for r in self.seen.get()), self.LAST)
        last, times = sorted(t for t, _ in before), Counter(d for _, d in before)
        for b in in_order(rows, "turn_id", ["turn_id", "tokens", "digest"]):
            out = []
            for turn, tokens, digest in b.itertuples(index=False):
                n = len(last)
                out.append((key[0], int(turn), float(tokens) / max(1, last[n // 2]) if n else None, times[digest] / n if n else None))
                if n == self.LAST:
                    del last[bisect_left(last, before[0][0])]
                    times[before[0][1]] -= 1
                before.append((int(tokens), digest))
                insort(last, int(tokens))
                times[digest] += 1
            yield pd.DataFrame(out, columns=["task", "turn_id", "ratio", "repeated"])
        self.seen.put(list(before))

    def close(self) -> None:
        pass


def rolling_cost(stream: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """(task, turn_id, ratio, repeated) of a stream (task, turn_id, tokens, digest); log: earlier turns with the same columns, from which a restarted stream takes its state (ST11)."""
    past = None if log is None else history(log.select("task", "turn_id", "tokens", "digest"), "task", "turn_id", RollingCost.LAST).drop("place").groupBy("task")
    schema = "task string, turn_id long, ratio double, repeated double"
    return stream.select("task", "turn_id", "tokens", "digest").groupBy("task").transformWithStateInPandas(RollingCost(), schema, "append", "None", past)


class Admission(StatefulProcessor):
    """Reservations against a system's budgets (ST6): one writer for each key makes check and reserve one step.

    A turn holds the worst case of minutes and spend until it is released, or until HOLD_S have passed, so a
    turn that never ends gives its share back. Only a hard budget refuses.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.holds = handle.getListState("holds", "hold long, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        holds = {r[0]: r[1] for r in self.holds.get()}  # in the order in which they end
        for b in in_order(rows, ["at", "seq"], ["at", "seq", "kind", "hold", "minutes_used", "minutes_budget", "minutes_hard", "spend_used", "spend_budget", "spend_hard"]):
            out = []
            for r in b.itertuples(index=False):
                while holds and next(iter(holds.values())) <= r.at:
                    del holds[next(iter(holds))]
                reason = "released"
                if r.kind == "release":
                    holds.pop(r.hold, None)
                elif r.minutes_hard and r.minutes_used + (len(holds) + 1) * C.WORST_MINUTES > r.minutes_budget:
                    reason = "review_capacity"
                elif r.spend_hard and r.spend_used + (len(holds) + 1) * C.WORST_SPEND > r.spend_budget:
                    reason = "spend_budget"
                else:
                    reason = "within budget"
                    holds.pop(r.hold, None)
                    holds[int(r.hold)] = int(r.at) + C.HOLD_S * 1000
                out.append((key[0], int(r.seq), reason in ("released", "within budget"), reason, len(holds) * C.WORST_MINUTES, len(holds) * C.WORST_SPEND))
            yield pd.DataFrame(out, columns=["system_id", "seq", "admitted", "reason", "minutes_held", "spend_held"])
        keep(self.holds, list(holds.items()))

    def close(self) -> None:
        pass


def admissions(stream: DataFrame) -> DataFrame:
    """stream: (system_id, at in milliseconds, seq, kind reserve|release, hold, minutes_used, minutes_budget, minutes_hard, spend_used, spend_budget, spend_hard)."""
    return stream.groupBy("system_id").transformWithStateInPandas(Admission(), "system_id string, seq long, admitted boolean, reason string, minutes_held double, spend_held double", "append", "None")


class Queue(StatefulProcessor):
    """Deferred checks of a system in a queue of QUEUE_SLOTS (ST12): a check that finds it full becomes a row that says so."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.busy = handle.getListState("busy", "until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        busy = sorted(r[0] for r in self.busy.get())
        for b in in_order(rows, ["at", "request_id", "detector_id"], ["at", "request_id", "detector_id", "takes_ms"]):
            out = []
            for r in b.itertuples(index=False):
                del busy[: bisect_right(busy, r.at)]
                full = len(busy) >= C.QUEUE_SLOTS
                if not full:
                    insort(busy, int(r.at + r.takes_ms))
                out.append((key[0], int(r.request_id), r.detector_id, "failed" if full else "queued_async", "queue_saturated" if full else None, len(busy)))
            yield pd.DataFrame(out, columns=["system_id", "request_id", "detector_id", "status", "error_code", "queued"])
        keep(self.busy, [(x,) for x in busy])

    def close(self) -> None:
        pass


def deferred_checks(stream: DataFrame) -> DataFrame:
    """stream: (system_id, at in milliseconds, request_id, detector_id, takes_ms); no check is lost, those dropped are rows."""
    return stream.groupBy("system_id").transformWithStateInPandas(Queue(), "system_id string, request_id long, detector_id string, status string, error_code string, queued long", "append", "None")


class Review(StatefulProcessor):
    """Held or refused questions (ST7): released or blocked by one review, then answered if released; other steps are rejected.

    One key is a block of HELD_TOGETHER questions, so state and frames are paid for once a block; each question keeps a status of its own.
    """

    STEPS = {(None, "held"), (None, "refused"), ("held", "released"), ("held", "blocked"), ("refused", "released"), ("refused", "blocked"), ("released", "answered")}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getListState("status", "held_id long, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = {r[0]: r[1] for r in self.status.get()}
        for b in in_order(rows, ["held_id", "seq"], ["held_id", "seq", "step"]):
            status, rejected = [], []
            for held, step in zip(b["held_id"].tolist(), b["step"].tolist(), strict=True):
                ok = (now.get(held), step) in self.STEPS
                if ok:
                    now[held] = step
                status.append(now.get(held))
                rejected.append(not ok)
            yield pd.DataFrame({"held_id": b["held_id"].to_numpy(), "seq": b["seq"].to_numpy(), "status": pd.Series(status, dtype=object), "rejected": rejected})
        keep(self.status, list(now.items()))

    def close(self) -> None:
        pass


def reviews(stream: DataFrame) -> DataFrame:
    """(held_id, seq, status, rejected) of a stream (held_id, seq, step)."""
    s = stream.select(F.floor(F.col("held_id") / HELD_TOGETHER).alias("block"), F.col("held_id").cast("long").alias("held_id"), "seq", "step")
    return s.groupBy("block").transformWithStateInPandas(Review(), "held_id long, seq long, status string, rejected boolean", "append", "None")


def control_states(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Changes of state by controls (ST4): the end and the recovery are stored as absolute times, so a restart never extends them.

    Each control gives three dated changes at once; a reader takes the newest not after now.
    """
    changes = F.array(
        F.struct(F.col("valid_from").alias("at"), F.col("kind").alias("state")),
        F.struct(F.col("valid_to").alias("at"), F.lit("recovering").alias("state")),
        F.struct((F.col("valid_to") + F.make_dt_interval(secs=F.lit(C.RECOVERING_S))).alias("at"), F.lit("healthy").alias("state")),
    )
    return stream.withWatermark("valid_from", delay).select("system_id", "control_id", F.inline(changes))


def state_now(changes: DataFrame, at: Column) -> DataFrame:
    """(system_id, control_id, state): the newest change of each control that is not after a time (ST4)."""
    return changes.filter(F.col("at") <= at).groupBy("system_id", "control_id").agg(F.max_by("state", "at").alias("state"))


def run_once(result: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now, with checkpoint in the shared folder, and return what it gave."""
    spark = result.sparkSession
    path = f"{checkpoint}/{name}"
    w = result.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        w = w.format("parquet").option("path", f"{path}/out")
    else:
        w = w.foreachBatch(lambda df, i: df.withColumn("batch_id", F.lit(i)).write.mode("append").parquet(f"{path}/out"))
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # keyed state with several values needs it; a query keeps what it starts with
    try:
        q = w.start()
    finally:
        spark.conf.set(PROVIDER, before)
    q.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{path}/out") if mode == "append" else spark.read.parquet(f"{path}/out")
