"""Operator 9: near-duplicate vectors by cross-polytope hashing.

A table of the index rotates a vector by three rounds of random signs and fast Hadamard
transforms for each of HASHES functions; a function's value is the signed axis nearest to
the rotated vector. A vector stands in its own bucket of each table and in those of its
PROBES next best values. Buckets are met by ids and sketches of BITS random signs alone;
vectors go only where a sketch has found a partner. Pairs in a bucket are verified by their
cosine in double precision and counted in the first bucket they share, so links are counted
once without a table of pairs. Buckets over BLOCK rows are compared block by block in
separate tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assurance.llm.common import U64, components, mix64, near, park, run_bounds, runs
from assurance.llm.neardup import stars

TABLES, HASHES, PROBES, BLOCK = 4, 2, 2, 1000
#: Signs of a sketch, and the deviations above the mean that a pair at the threshold may differ in them.
BITS, DEVIATIONS = 128, 5


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2)
        step *= 2
    return x.reshape(n, width) / np.sqrt(width)


@lru_cache(8)
def signs(width: int) -> np.ndarray:
    return np.random.default_rng(77_001).choice([-1.0, 1.0], (TABLES, HASHES, 3, width))


def buckets(x: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """[rows, TABLES, 1 + PROBES] bucket keys: own first, then the next best; salt parts labels."""
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = x
    out = np.zeros((n, TABLES, 1 + PROBES), U64)
    for t in range(TABLES):
        best, loss = [], []
        for k in range(HASHES):
            y = padded
            for r in range(3):
                y = hadamard(y * signs(width)[t, k, r])
            size = np.abs(y)
            m = min(1 + PROBES, width)
            axes = np.argsort(-size, 1, kind="stable")[:, :m]
            top = np.take_along_axis(size, axes, 1)
            best.append(2 * axes + (np.take_along_axis(y, axes, 1) < 0))
            loss.append(top[:, :1] - top[:, 1:])
        turn = np.argsort(np.concatenate(loss, 1), 1, kind="stable")[:, :PROBES]
        own = np.stack([b[:, 0] for b in best], 1)
        for p in range(1 + PROBES):
            codes = own.copy()
            if p:
                which = turn[:, min(p - 1, turn.shape[1] - 1)]
                step = best[0].shape[1] - 1
                for k in range(HASHES):
                    rows = np.flatnonzero(which // step == k)
                    codes[rows, k] = best[k][rows, 1 + which[rows] % step]
            h = mix64(salt + U64(t + 1))
            with np.errstate(over="ignore"):
                for k in range(HASHES):
                    h = mix64(h * U64(0x9E3779B97F4A7C15) + codes[:, k].astype(U64))
            out[:, t, p] = h
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows in double precision at length one."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def keys_of(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """[rows, TABLES, 1 + PROBES] bucket keys of unit rows, apart by label and length."""
    return buckets(x, mix64(label.astype(np.int64).view(U64) + U64(x.shape[1] << 40)))


@lru_cache(8)
def directions(width: int) -> np.ndarray:
    return np.random.default_rng(77_002).normal(size=(width, BITS))


def spread(classes: DataFrame) -> DataFrame:
    """One row for each bucket that a class stands in: key, place (table * (1 + PROBES) + probe), h, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 1024):
                batch = big.slice(at, 1024)
                size = batch.column(1).value_lengths().to_numpy()
                for d in np.unique(size):
                    part = batch.filter(pa.array(size == d))
                    x = unit(part.column(1).flatten().to_numpy().reshape(-1, d))
                    k = keys_of(x, part.column(2).to_numpy()).reshape(len(x), -1)
                    who = pa.array(np.repeat(np.arange(len(x)), k.shape[1]))
                    sketch = pa.array([r.tobytes() for r in np.packbits(x @ directions(int(d)) > 0, axis=1)], pa.binary()).take(who)
                    place = pa.array(np.tile(np.arange(k.shape[1], dtype=np.int32), len(x)))
                    yield pa.RecordBatch.from_arrays([pa.array(k.reshape(-1).view(np.int64)), place, part.column(0).take(who), sketch], ["key", "place", "h", "sketch"])

    return classes.select("h", "vec", "label").mapInArrow(run, "key long, place int, h long, sketch binary")


def may_link(part: pa.Table) -> np.ndarray:
    """Which pairs of a group may be compared in it: one of the two in its own bucket, and of different halves if there are two."""
    own, half, h = part.column("place").to_numpy() % (1 + PROBES) == 0, part.column("half").to_numpy(), part.column("h").to_numpy()
    pairs = (own[:, None] | own[None, :]) & (h[:, None] != h[None, :])
    return pairs & (half[:, None] != half[None, :]) if half.max() > 0 else pairs


def suspects(groups: DataFrame, threshold: float) -> DataFrame:
    """(g, half, key, place, h): the rows of groups (and sketch) that the sketches bring together with another of their group."""
    apart = np.arccos(threshold) / np.pi
    most = BITS * apart + DEVIATIONS * np.sqrt(BITS * apart * (1 - apart))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "g"):
            bounds = run_bounds(t.column("g").to_numpy())
            bits = np.unpackbits(np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(t), -1), axis=1).astype(np.float32) * 2 - 1
            keep = np.zeros(len(t), bool)
            for s in np.flatnonzero(np.diff(bounds) > 1):
                low, high = bounds[s], bounds[s + 1]
                close = bits[low:high] @ bits[low:high].T >= BITS - 2 * most
                keep[low:high] = (close & may_link(t.slice(low, high - low))).any(1)
            if keep.any():
                yield from t.drop_columns("sketch").filter(pa.array(keep)).to_batches()

    rows = groups.select("g", "half", "key", "place", "h", "sketch")
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(run, "g long, half int, key long, place int, h long")


def first_shared(keys: np.ndarray, a: np.ndarray, b: np.ndarray, table: int, bucket: np.uint64) -> np.ndarray:
    """Of pairs that share bucket of table: whether no earlier bucket has them. keys: [rows, TABLES, 1 + PROBES]."""
    new = np.ones(len(a), bool)
    for t in range(table + 1):
        own_a, own_b = keys[a, t, :1], keys[b, t, :1]
        both = own_a[:, 0] == own_b[:, 0]
        in_a, in_b = (keys[b, t, 1:] == own_a).any(1), (keys[a, t, 1:] == own_b).any(1)
        if t < table:
            new &= ~(both | in_a | in_b)
        else:  # within a table: own buckets, then that of the first of the pair
            new &= np.where(both, own_a[:, 0] == bucket, np.where(in_a, own_a[:, 0] == bucket, own_b[:, 0] == bucket))
    return new


def links_of(part: pa.Table, x: np.ndarray, keys: np.ndarray, threshold: float) -> pa.RecordBatch | None:
    """(id, links, root) of the rows of one group that link, None if none does; x are its unit rows."""
    order = np.argsort(part.column("id").to_numpy(), kind="stable")
    part, x, keys = part.take(pa.array(order)), x[order], keys[order]
    ids, place, weight = (part.column(c).to_numpy() for c in ("id", "place", "weight"))
    table, bucket = int(place[0]) // (1 + PROBES), part.column("key").to_numpy().view(U64)[0]
    near_by = (x @ x.T >= threshold) & may_link(part) & (ids[:, None] != ids[None, :])
    a, b = np.nonzero(np.triu(near_by, 1))
    if not len(a):
        return None
    new = first_shared(keys, a, b, table, bucket)
    names, back = np.unique(ids, return_inverse=True)
    links = np.bincount(back[a[new]], weight[b[new]], len(names)) + np.bincount(back[b[new]], weight[a[new]], len(names))
    root = names.copy()
    adjacent = np.zeros((len(names), len(names)), bool)
    adjacent[back[a], back[b]] = adjacent[back[b], back[a]] = True
    top, under = stars(adjacent, names)
    root[np.searchsorted(names, under)] = top
    use = adjacent.any(1)
    return pa.RecordBatch.from_arrays([pa.array(names[use]), pa.array(links[use].astype(np.int64)), pa.array(root[use])], ["id", "links", "root"])


def compare(rows: DataFrame, threshold: float) -> DataFrame:
    """(id, links, root): weights of the classes that link with id in this group for the first time, and the least id its links reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in runs(batches, "g"):
            width = pc.list_value_length(whole.column("vec"))
            for w in pc.unique(width):  # hashes of different widths may collide
                t = whole.filter(pc.equal(width, w)).combine_chunks()
                x = unit(t.column("vec").combine_chunks().flatten().to_numpy().reshape(len(t), -1))
                label = t.column("label").to_numpy()
                keys = np.concatenate([keys_of(x[at : at + 1024], label[at : at + 1024]) for at in range(0, len(x), 1024)])
                bounds = run_bounds(t.column("g").to_numpy())
                t = t.drop_columns("vec")
                for s in np.flatnonzero(np.diff(bounds) > 1):
                    low, high = bounds[s], bounds[s + 1]
                    found = links_of(t.slice(low, high - low), x[low:high], keys[low:high], threshold)
                    if found is not None:
                        yield found

    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(run, "id long, links long, root long")


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label).

    Only vectors of equal, non-null labels and equal length are compared. A vector that is
    null, empty or zero, or holds a null or non-finite component, links with nothing.
    Equal vectors are one class with a weight; repeated rows count as vectors of their own,
    but different vectors of one vec_id are not compared with each other, and vectors of
    which no copy has an id link with their copies only. Other columns are ignored; an empty
    table gives an empty result.
    """
    single = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    x = F.col("embedding").cast("array<float>" if single else "array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), x.alias("vec"))
    finite = F.coalesce(F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    good = F.col("label").isNotNull() & finite & F.coalesce(F.exists("vec", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("h", F.when(good, F.xxhash64("label", "vec"))).withColumn("h2", F.when(good, F.xxhash64("vec", "label", F.lit(1))))
    classes = park(rows.filter("h is not null").groupBy("h", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.min("vec").alias("vec"), F.min("label").alias("label")))
    named = classes.filter("id is not null")
    placed = spread(named)
    own = F.col("place") % (1 + PROBES) == 0
    sizes = placed.groupBy("key").agg(F.count("*").alias("size"), F.count_if(own).alias("own")).filter("size > 1 and own > 0")
    sizes = park(sizes.select("key", "size"))
    n = sizes.count()
    placed = near(placed, sizes, "key", n, "inner")
    groups = placed.filter(F.col("size") <= BLOCK).withColumn("g", F.col("key")).withColumn("half", F.lit(0))
    if sizes.filter(F.col("size") > BLOCK).limit(1).count():
        count = F.ceil(F.col("size") / BLOCK).cast("long")
        blocks = placed.filter(F.col("size") > BLOCK).withColumn("block", F.pmod(F.xxhash64("h"), count))
        others = F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda o: F.struct(F.least("block", o).alias("low"), F.greatest("block", o).alias("high"), F.when(o == F.col("block"), 0).when(F.col("block") < o, 1).otherwise(2).alias("half")))
        blocks = blocks.withColumn("o", F.explode(others)).withColumn("g", F.xxhash64("key", "o.low", "o.high")).withColumn("half", F.col("o.half"))
        groups = groups.unionByName(blocks.select(groups.columns))
    met = park(suspects(groups, threshold))
    found = park(compare(near(named.drop("h2"), met, "h", met.count(), "inner"), threshold))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = components(found.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
    of_class = classes.select("h", "h2", "id", "weight").join(links, "id", "left").join(parts, "id", "left")
    of_class = of_class.select("h", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "id").alias("component"))
    out = rows.select("vec_id", "h", "h2").join(of_class, ["h", "h2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
