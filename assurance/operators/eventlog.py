"""The append-only event log: chaining, verification, recovery and health."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64
LOG = "system_id string, idx long, previous_hash string, record_json string, hash string, signature string"


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 under a constant key of at most 64 bytes, from sha2 alone."""
    padded = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in padded)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def canonical(d: DataFrame) -> DataFrame:
    """(system_id, at, request_id, record_json): fields in alphabetical order, fixed before anything is hashed (L3)."""
    record = F.to_json(F.struct(F.col("effective_action").alias("action"), F.lit("decision.issued").alias("event"), F.col("k"), F.col("origin"), F.col("request_id"), F.col("system_id"), F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss").alias("time")))
    return d.select("system_id", F.col("occurred_at").alias("at"), "request_id", record.alias("record_json"))


def chain(events: DataFrame, key: bytes) -> DataFrame:
    """The log of events (SRC2): one hash chain for each system and day.

    A hash covers the one before it, so building is sequential within a chain; chains are
    cut by day so that a hot system is many chains. A chain's rows stream through its task
    in order, and only the last hash is held.
    """
    e = events.withColumn("chain", F.concat_ws("/", "system_id", F.date_format("at", "yyyy-MM-dd")))
    ordered = e.repartition("chain").sortWithinPartitions("chain", "at", "request_id").select("chain", "record_json")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, n, before = None, 0, GENESIS
        for b in batches:
            out = []
            for c, r in zip(b["chain"], b["record_json"], strict=True):
                if c != last:
                    last, n, before = c, 0, GENESIS
                h = hashlib.sha256((before + r).encode()).hexdigest()
                out.append((c, n, before, r, h, hmac.new(key, h.encode(), hashlib.sha256).hexdigest()))
                before, n = h, n + 1
            yield pd.DataFrame(out, columns=["system_id", "idx", "previous_hash", "record_json", "hash", "signature"])

    return ordered.mapInPandas(run, LOG)


def link_check(log: DataFrame) -> DataFrame:
    """log with linked, hashed and signed left to verify(); here the link alone."""
    w = Window.partitionBy("system_id").orderBy("idx")
    return log.withColumn("linked", F.col("previous_hash") == F.coalesce(F.lag("hash").over(w), F.lit(GENESIS)))


def verify(log: DataFrame, key: bytes | None = None) -> DataFrame:
    """(system_id, valid, broken_at, reason) for each chain (L1).

    Every row is checked on its own against the stored hash before it, so verification is
    parallel where building was not; the first broken index is a minimum.
    """
    x = link_check(log)
    sound = F.sha2(F.concat("previous_hash", "record_json"), 256) == F.col("hash")
    reason = F.when(~F.col("linked"), "link").when(~sound, "hash")
    if key is not None:
        reason = reason.when(hmac_sha256(key, F.col("hash")) != F.col("signature"), "signature")
    x = x.withColumn("reason", reason)
    g = x.groupBy("system_id").agg(F.count("*").alias("n"), F.min(F.when(F.col("reason").isNotNull(), F.struct("idx", "reason"))).alias("first"))
    return g.select("system_id", "n", F.col("first").isNull().alias("valid"), F.col("first.idx").alias("broken_at"), F.col("first.reason").alias("reason"))


def tail_check(log: DataFrame, batch: DataFrame) -> DataFrame:
    """(system_id, matches) for each chain that a new batch extends (L2): its first link against the tail of the log."""
    tail = log.groupBy("system_id").agg(F.max_by("hash", "idx").alias("tail"))
    head = batch.groupBy("system_id").agg(F.min_by("previous_hash", "idx").alias("head"))
    return head.join(tail, "system_id", "left").select("system_id", (F.col("head") == F.coalesce("tail", F.lit(GENESIS))).alias("matches"))


def batch_digest(log: DataFrame) -> DataFrame:
    """(system_id, digest) that does not depend on the order of rows (L5): a sum of hash prefixes, which combines on the map side."""
    part = F.conv(F.substring("hash", 1, 15), 16, 10).cast("decimal(38,0)")
    return log.groupBy("system_id").agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.sum(part).cast("string")), 256).alias("digest"))


def read_log(lines: DataFrame) -> DataFrame:
    """(line, idx, hash, record_json, corrupt) from JSON lines (SRC1); blank lines are skipped, bad ones kept and marked."""
    x = lines.filter(F.trim("value") != "").select("value", F.from_json("value", "idx long, hash string, record_json string, previous_hash string, system_id string, signature string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"))
    return x.select(F.col("value").alias("line"), "x.system_id", "x.idx", "x.previous_hash", "x.record_json", "x.hash", "x.signature", (F.col("x._bad").isNotNull() | F.col("x.idx").isNull()).alias("corrupt"))


def recover(events: DataFrame) -> DataFrame:
    """Current state of each key (ST11) from (kind, key, seq, value, removed): last write wins, a removal ends the key."""
    last = events.groupBy("kind", "key").agg(F.max(F.struct("seq", "value", "removed")).alias("x"))
    return last.filter(~F.col("x.removed")).select("kind", "key", F.col("x.value").alias("value"), F.col("x.seq").alias("seq"))


def counters(events: DataFrame) -> DataFrame:
    """One row of counts over the recovered state (L4)."""
    live = recover(events)
    g = live.groupBy("kind").agg(F.count("*").alias("n"))
    return g


def rollover(events: DataFrame, at: Column) -> DataFrame:
    """Events of a new epoch with the record that starts it (SRC6)."""
    first = events.sparkSession.range(1).select(F.lit("-").alias("system_id"), at.alias("at"), F.lit(0).cast("long").alias("request_id"), F.to_json(F.struct(F.lit("epoch.started").alias("event"), F.lit(True).alias("synthetic"))).alias("record_json"))
    return events.unionByName(first)


def write_epoch(events: DataFrame, epoch: int, key: bytes, path: str) -> None:
    """Chain the events of an epoch and add them to the store in a partition of their own; earlier epochs stay as they are."""
    chain(events, key).withColumn("epoch", F.lit(epoch)).write.mode("append").partitionBy("epoch").parquet(path)


def health(lines: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row (SRC9): unreadable lines, chains and broken chains."""
    a = lines.agg(F.count("*").alias("lines"), F.count_if("corrupt").alias("unreadable"))
    b = verdicts.agg(F.count("*").alias("chains"), F.count_if(~F.col("valid")).alias("broken"))
    return a.join(F.broadcast(b))
