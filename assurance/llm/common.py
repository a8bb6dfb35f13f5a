"""Small helpers that several operators share: words, shared folders, sorted runs and components."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

U64 = np.uint64


class Words(dict):
    """64-bit hashes of words, in a table of at most 150,000 (about 25 MB of a worker)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


WORDS = Words()


class Kept:
    """What a worker has computed, by key: two tables of at most size entries each; when the new one is full it becomes the old one."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        """The value, or None; what the old table alone holds moves to the new one."""
        value = self.new.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.new, self.old = {}, self.new
        self.new[key] = value


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased; runs of anything but the six ASCII white-space bytes."""
    return text.encode("utf-8").lower().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that close inputs give unrelated outputs."""
    x = x.astype(U64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def crc_mod(column: str, n: int):
    """crc32 of an integer id written as text, modulo n, as a column."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def crc_mod_py(value: int, n: int) -> int:
    return zlib.crc32(str(value).encode()) % n


def shared_dir(spark: SparkSession) -> str:
    """A new folder name that driver and executors both reach.

    On a cluster it lies under spark.checkpoint.dir, which must be set there; only on one
    machine (tests) a temporary folder is made and set where it is not.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="assurance-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def plus(df: DataFrame, ddl: str) -> StructType:
    """The schema of df with more fields behind it."""
    return StructType(df.schema.fields + StructType.fromDDL(ddl).fields)


def park(df: DataFrame) -> DataFrame:
    """Write a table once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def near(df: DataFrame, keys: DataFrame, on: str, n: int, how: str, most: int = 200_000) -> DataFrame:
    """df joined with keys on one column; keys are sent to every task only if n, their counted rows, is small."""
    return df.join(F.broadcast(keys) if n <= most else keys, on, how)


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes in a column of texts, or with one row."""
    size = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that each hold whole runs of equal keys, from batches sorted by key.

    The last run of a batch waits for the next batch, so memory is one batch and one run.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        if held and k[0] != last:
            yield pa.Table.from_batches(held)
            held = []
        cut = int(np.searchsorted(k, k[-1], side="left"))
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
        last = k[-1]
    if held:
        yield pa.Table.from_batches(held)


def run_bounds(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    return np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)] if len(keys) else np.zeros(1, int)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the edges; component is the smallest node reachable.

    Large-star and small-star steps in turn (Kiveris et al. 2014): each step hangs
    neighbours on a node's least neighbour with one min() that combines on the map side
    and one join that AQE can split, so no neighbourhood is gathered in a task. Every
    step is written to the shared folder; a forest of stars is the fix point.
    """
    e = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u <> v").distinct()
    e = park(e)
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(least, "v")
            .select(F.explode(F.array(F.struct(F.col("m").alias("u"), "v"), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .filter("u <> v")
            .distinct()
        )
        e = park(small)
        # done once every edge goes from a root to a node that nothing else holds
        ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x")).select("x.*")
        ends = ends.groupBy("n").agg(F.max("up").alias("up"), F.sum("down").alias("down"))
        if not ends.agg(F.coalesce(F.bool_or(F.col("up") + F.col("down") > 1), F.lit(False))).first()[0]:
            break
    roots = e.select("u").distinct().select(F.col("u").alias("node"), F.col("u").alias("component"))
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).unionAll(roots)
