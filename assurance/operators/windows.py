"""Ordered windows over keys that hold many rows: per key and time bucket in many tasks, carried on by a small table of buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from assurance.operators.corpus import few


def running_total(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: Column, name: str, ties: bool = False) -> DataFrame:
    """df with the running sum of value over all rows of the keys up to the row, in order.

    bucket must rise with the order. Rows are ordered within a bucket only; what came in
    earlier buckets is one number for each, summed over the table of buckets. With ties,
    rows of equal order count together (RANGE), else one after another (ROWS).
    """
    rows = df.withColumn("__bucket", bucket).withColumn("__value", value)
    sums = rows.groupBy(*keys, "__bucket").agg(F.sum("__value").alias("__sum"))
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "__bucket", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    inside = inside.rangeBetween(Window.unboundedPreceding, 0) if ties else inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__inside", F.sum("__value").over(inside)).join(few(sums), [*keys, "__bucket"])
    return rows.withColumn(name, F.col("__before") + F.col("__inside")).drop("__bucket", "__value", "__inside", "__before")


def sequence(df: DataFrame, keys: list[str], bucket: Column, order: list[str], name: str = "sequence") -> DataFrame:
    """df with the number of each row among the rows of its keys, in order."""
    return running_total(df, keys, bucket, order, F.lit(1).cast("long"), name)


def previous_rows(df: DataFrame, keys: list[str], bucket: Column, order: list[str], last: int, frames: dict[str, Callable[[WindowSpec], Column]], size: int = 2048) -> DataFrame:
    """df with columns over the last so many rows before each row of its keys, in order.

    Rows are numbered (as in sequence), and each run of size of them is a block of its own;
    the last rows of a block also stand in the next one, where they only precede. So a
    frame never needs more than one block, whatever share of the rows a key has.
    """
    size = max(size, last)
    place = F.col("__number") - 1
    block = F.floor(place / size)
    own, halo = F.struct(block.alias("block"), F.lit(False).alias("halo")), F.struct((block + 1).alias("block"), F.lit(True).alias("halo"))
    rows = sequence(df, keys, bucket, order, "__number").withColumn("__to", F.explode(F.when(place % size >= size - last, F.array(own, halo)).otherwise(F.array(own))))
    window = Window.partitionBy(*keys, "__block").orderBy("__number").rowsBetween(-last, -1)
    rows = rows.withColumn("__block", F.col("__to.block"))
    rows = rows.select("*", *(f(window).alias(name) for name, f in frames.items())).filter(~F.col("__to.halo"))
    return rows.select(*df.columns, *frames)


def trailing_sum(df: DataFrame, row_id: str, key: str, at: str, value: str, seconds: int, name: str) -> DataFrame:
    """(row_id, name): the sum of value over the key's rows from seconds before each row up to it, both ends and ties included.

    It is the running total at the row less the running total just before its frame, so
    each row also asks at the beginning of its frame. Both are met by hour.
    """
    micros = F.unix_micros(at)
    rows = df.select(row_id, key, (2 * micros + 1).alias("at"), F.col(value).cast("long").alias("v"), F.lit(1).alias("sign"))
    asks = df.select(row_id, key, (2 * (micros - seconds * 1_000_000)).alias("at"), F.lit(0).cast("long").alias("v"), F.lit(-1).alias("sign"))
    hour = F.floor(F.col("at") / (2 * 3_600_000_000))
    totals = running_total(rows.unionAll(asks), [key], hour, ["at"], F.col("v"), "total", ties=True)
    return totals.groupBy(row_id).agg(F.sum(F.col("total") * F.col("sign")).alias(name))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, value: Column, name: str) -> DataFrame:
    """left with the value of the newest row of right of the same key that is not after it (J7); null if there is none.

    Rows of both sides meet by key and hour; the newest value of earlier hours comes from
    one row for each key and hour. Of right rows at one time the largest value counts.
    """
    hour = F.floor(F.unix_micros("__at") / 3_600_000_000)
    found = F.struct(F.col(right_at).alias("at"), value.alias("v"))
    states = right.select(key, F.col(right_at).alias("__at"), found.alias("__state"))
    last = states.groupBy(key, hour.alias("__hour")).agg(F.max("__state").alias("__last"))
    asked = left.select(key, F.col(at).alias("__at")).select(key, hour.alias("__hour")).distinct()
    hours = asked.join(last, [key, "__hour"], "full_outer")
    before = Window.partitionBy(key).orderBy("__hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select(key, "__hour", F.max("__last").over(before).alias("__before"))
    rows = left.withColumn("__at", F.col(at)).withColumn("__state", F.lit(None).cast(states.schema["__state"].dataType)).withColumn("__left", F.lit(True))
    both = rows.unionByName(states.withColumn("__left", F.lit(False)), allowMissingColumns=True).withColumn("__hour", hour)
    inside = Window.partitionBy(key, "__hour").orderBy("__at").rangeBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__now", F.max("__state").over(inside)).filter("__left").join(few(hours), [key, "__hour"], "left")
    return both.select(*left.columns, F.coalesce(F.col("__now.v"), F.col("__before.v")).alias(name))
