"""Operator 5: near-duplicates by a chosen-path set similarity join.

Documents are sets of word shingles. Texts with equal sets become one class first. Each
class then walks down several random trees: at a node, the node itself chooses which
minwise position sends its members on, and now and then a second one, so that a pair at
the threshold keeps one common child in the mean. Nodes small enough are compared
exhaustively on 64-byte sketches; larger ones are split further and never gathered. A tree
loses more pairs the deeper it goes, so classes in nodes that stay large walk down further
independent trees, as many as the target recall asks for at the depth reached. What the
sketches bring together is checked on full sets, within bounded groups, and verified links
are closed to components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assurance.llm.common import U64, WORDS, components, mix64, near, park, run_bounds, runs, words

POSITIONS = 128
#: Least number of trees, and the share of pairs at the threshold that all trees together are to bring into a common leaf.
TREES, RECALL = 10, 0.99
#: Levels that one round walks down, and rounds before a node that stays large is compared in blocks.
LEVELS, ROUNDS = 3, 12
#: Most classes compared exhaustively in one node or group, and most shingles of a group of full sets.
NODE, WEIGHT = 1600, 2_000_000
#: Estimates below the threshold by more than this are not checked; over three deviations of the sketch.
SLACK = 0.12


@lru_cache(1)
def multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(0, 1 << 32, POSITIONS, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, POSITIONS, np.uint32)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles; of the whole sequence if there are fewer words."""
    found = words(text)
    if not found:
        return np.zeros(0, U64)
    h = np.fromiter(map(WORDS.__getitem__, found), U64, len(found))
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, k, U64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix64(out * U64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def set_hash(s: np.ndarray) -> int | None:
    """Names a set of shingles; None for the empty one."""
    with np.errstate(over="ignore"):
        return int(mix64(s + U64(len(s))).sum(dtype=U64).view(np.int64)) if len(s) else None


def signature(s: np.ndarray) -> np.ndarray:
    """Hashes of the minwise tokens at each position, 16 bits each."""
    a, b = multipliers()
    x = (s >> U64(32)).astype(np.uint32)
    least = np.full(POSITIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        least = np.minimum(least, (a[:, None] * x[None, at : at + 4096] + b[:, None]).min(1))
    return (mix64(least.astype(U64) + (np.arange(POSITIONS).astype(U64) << U64(32))) & U64(0xFFFF)).astype(np.uint16)


def text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string")).alias("t")


def sign(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, t, n_shingles, h, sig): t is a hash of the text, h names the set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 1024):
                batch = big.slice(at, 1024)
                n, h, sig = [], [], []
                for text in batch.column(2).to_pylist():
                    s = shingles(text, k)
                    n.append(len(s))
                    h.append(set_hash(s))
                    sig.append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "t", "n_shingles", "h", "sig"])

    return docs.select(F.col("doc_id").cast("long"), text_hash(), F.col("text").cast("string")).mapInArrow(run, "doc_id long, t long, n_shingles long, h long, sig binary")


@lru_cache(64)
def trees_for(depth: int, threshold: float) -> int:
    """Least number of trees, TREES or more, that holds RECALL of the pairs at the threshold together down to depth.

    Two sets agree at a binomial number of the positions. From a node a pair goes on together
    with the share that agrees, and once more where the node picks a second position: a
    branching process, whose end is reckoned level by level.
    """
    agree = np.arange(POSITIONS + 1)
    logs = np.array([lgamma(POSITIONS + 1) - lgamma(i + 1) - lgamma(POSITIONS - i + 1) for i in agree])
    t = min(threshold, 1 - 1e-9)
    weight = np.exp(logs + agree * log(t) + (POSITIONS - agree) * log(1 - t))
    share, extra, gone = agree / POSITIONS, 1 / threshold - 1, np.zeros(POSITIONS + 1)
    for _ in range(depth):
        apart = 1 - share + share * gone
        gone = apart * (1 - extra + extra * apart)
    n = TREES
    while (weight * gone**n).sum() > 1 - RECALL:
        n += 1
    return n


def walk(node: np.ndarray, sigs: np.ndarray, extra: float) -> tuple[np.ndarray, np.ndarray]:
    """Children reached after LEVELS steps from each row's node, and the row that each belongs to."""
    who = np.arange(len(node))
    with np.errstate(over="ignore"):
        for _ in range(LEVELS):
            second = (mix64(node + U64(3)) >> U64(11)).astype(float) / (1 << 53) < extra
            picks = []
            for salt, rows in ((1, slice(None)), (2, second)):
                at = (mix64(node[rows] + U64(salt)) % U64(POSITIONS)).astype(np.int64)
                token = sigs[who[rows], at].astype(U64) + (at.astype(U64) << U64(16))
                picks.append((mix64(node[rows] * U64(0x9E3779B97F4A7C15) + mix64(token + U64(salt << 32))), who[rows]))
            node, who = (np.concatenate(x) for x in zip(*picks, strict=True))
    return node, who


def descend(rows: DataFrame, extra: float, sketch: bool, trees: tuple[int, int]) -> DataFrame:
    """(node, h, sig) of rows moved LEVELS down, from the roots of the trees from one number up to another if rows have no node.

    With sketch, sig holds four bits of each position instead of sixteen.
    """
    roots = "node" not in rows.columns
    many = max(1, 20_480 // (trees[1] - trees[0])) if roots else 20_480  # a batch of children is as large from any number of trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, many):
                batch = big.slice(at, many)
                h = batch.column(0).to_numpy()
                sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, POSITIONS)
                if roots:
                    node, who = np.repeat(mix64(np.arange(*trees) + 1), len(h)), np.tile(np.arange(len(h)), trees[1] - trees[0])
                else:
                    node, who = batch.column(2).to_numpy().view(U64), np.arange(len(h))
                child, up = walk(node, sigs[who], extra)
                who = who[up]
                if sketch:
                    low = (sigs & 15).astype(np.uint8)
                    kept = low[:, ::2] | low[:, 1::2] << 4
                else:
                    kept = sigs
                width = kept.shape[1] * kept.itemsize
                data = pa.Array.from_buffers(pa.binary(width), len(who), [None, pa.py_buffer(np.ascontiguousarray(kept[who]).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(h[who]), data], ["node", "h", "sig"])

    return rows.select("h", "sig", *([] if roots else ["node"])).mapInArrow(run, "node long, h long, sig binary")


def stars(adjacent: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each component of a small graph with more than one member: its least id beside every other member."""
    n, a, b = len(ids), [], []
    free = np.ones(n, bool)
    for i in np.argsort(ids, kind="stable"):
        if not free[i]:
            continue
        group = np.zeros(n, bool)
        group[i] = True
        new = group
        while new.any():
            reach = adjacent[new].any(0) & free & ~group
            group, new = group | reach, reach
        free &= ~group
        group[i] = False
        b.append(ids[group])
        a.append(np.full(int(group.sum()), ids[i]))
    return np.concatenate(a), np.concatenate(b)


def leaves(rows: DataFrame, least: float) -> DataFrame:
    """(node, a, b): classes that sketches bring together within a node, as stars; rows have at most NODE of a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "node"):
            node = t.column("node").to_numpy()
            h = t.column("h").to_numpy()
            raw = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(h), -1)
            bounds = run_bounds(node)
            out = []
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                if e - s < 2:
                    continue
                ids, first = np.unique(h[s:e], return_index=True)
                if len(ids) < 2:
                    continue
                x = raw[s:e][first]
                x = np.concatenate([x & 15, x >> 4], 1)
                same = np.stack([(x == row).sum(1) for row in x])
                est = (same / POSITIONS - 1 / 16) / (15 / 16)
                a, b = stars(est >= least, ids)
                if len(a):
                    out.append((np.full(len(a), node[s]), a, b))
            if out:
                cols = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, ["node", "a", "b"])

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, "node long, a long, b long")


def grow(classes: DataFrame, threshold: float, trees: tuple[int, int]) -> tuple[DataFrame, DataFrame | None, int]:
    """Candidates (node, a, b) of some trees, the classes in nodes too deep for their number if there are any, and the depth reached.

    The nodes that a round leaves small enough wait, and those of all rounds are compared in one job.
    """
    extra, least = 1 / threshold - 1, threshold - SLACK
    rows, ready, crowded = classes, [], None
    for step in range(ROUNDS):
        depth = (step + 1) * LEVELS
        counts = descend(rows, extra, False, trees).groupBy("node").agg(F.count("*").alias("size"))
        large = park(counts.filter(F.col("size") > NODE))
        n = large.count()
        small = descend(rows, extra, True, trees)
        ready.append(near(small, large.select("node"), "node", n, "left_anti") if n else small)
        if not n:
            break
        if crowded is None and trees_for(depth + LEVELS, threshold) > trees[1]:
            crowded = near(descend(rows, extra, False, trees), large.select("node"), "node", n, "left_semi").select("h", "sig")
            crowded = park(crowded.dropDuplicates(["h"]))
        last = step == ROUNDS - 1
        rows = park(near(descend(rows, extra, last, trees), large, "node", n, "inner"))
        if last:
            ready.append(block_pairs(rows))
    return park(leaves(reduce(DataFrame.unionAll, ready), least)), crowded, depth


def candidates(classes: DataFrame, threshold: float) -> list[DataFrame]:
    """(node, a, b) from the first TREES trees, and from each further set of trees if there are any; classes have h and sig.

    All classes walk down TREES trees. Those of nodes that stay large walk down more of them,
    until there are as many as the depth reached asks for.
    """
    found, had, want = [], 0, TREES
    while want > had and classes is not None:
        pairs, classes, depth = grow(classes, threshold, (had, want))
        found.append(pairs)
        had, want = want, max(want, trees_for(depth, threshold))
    return found


def block_pairs(rows: DataFrame) -> DataFrame:
    """(node, h, sig) with a node for every two blocks of a node that stays large, so that all its pairs meet; rows have node, h, sig and size.

    A row comes once for each other block, so the rows grow with the square of the node's size.
    """
    blocks = F.ceil(F.col("size") / (NODE // 2)).cast("long")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("h"), blocks))
    rows = rows.select(F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("to"), "block", "node", "h", "sig").filter("to <> block")
    return rows.select(F.xxhash64("node", F.least("block", "to"), F.greatest("block", "to")).alias("node"), "h", "sig")


def exact_links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs have 100 * intersection >= percent * union, by products of bit columns that two sets share."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = place[column[keep]], owner[keep]
    both = np.zeros((len(sets), len(sets)), np.float64)
    width = max(256, 4_000_000 // len(sets))
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, (low, low + width))
        m = np.zeros((len(sets), min(width, int(shared.sum()) - low)), np.float32)
        m[owner[a:b], column[a:b] - low] = 1
        both += m @ m.T
    union = sizes[:, None] + sizes[None, :] - both
    return 100 * both >= percent * union


def verify(groups: DataFrame, percent: int) -> DataFrame:
    """(a, b) stars of the components that full sets confirm within each group; groups have g, h and set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "g"):
            g, h, raw = t.column("g").to_numpy(), t.column("h").to_numpy(), t.column("set")
            bounds = run_bounds(g)
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                ids, first = np.unique(h[s:e], return_index=True)
                if len(ids) < 2:
                    continue
                sets = [np.frombuffer(raw[int(s + i)].as_py(), U64) for i in first]
                a, b = stars(exact_links(sets, percent), ids)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return groups.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long")


def bounded(groups: DataFrame) -> DataFrame:
    """groups (g, h, n_shingles) of at most NODE rows, those over WEIGHT shingles as pairs of blocks, so that all their pairs meet."""
    of_group = Window.partitionBy("g")
    block = F.floor(F.sum("n_shingles").over(of_group.orderBy("h")) / (WEIGHT // 2)).cast("long")
    rows = groups.withColumn("block", block).withColumn("last", F.when(F.sum("n_shingles").over(of_group) > WEIGHT, F.max("block").over(of_group)))
    rows = rows.withColumn("to", F.explode(F.coalesce(F.sequence(F.lit(0).cast("long"), F.col("last")), F.array(F.lit(-1).cast("long"))))).filter("to <> block")
    return rows.withColumn("g", F.when(F.col("to") < 0, F.col("g")).otherwise(F.xxhash64("g", F.least("block", "to"), F.greatest("block", "to")))).drop("block", "last", "to")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(g, h, set) of docs (g, h, text): the text's set of shingles; texts that have another set than h names are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 512):
                batch = big.slice(at, 512)
                sets = [shingles(t, k) for t in batch.column(2).to_pylist()]
                own = pa.array([set_hash(s) == h for s, h in zip(sets, batch.column(1).to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s.tobytes() for s in sets], pa.binary())], ["g", "h", "set"]).filter(own)

    return docs.select("g", "h", "text").mapInArrow(run, "g long, h long, set binary")


def resolve(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, t, n_shingles, component_id, kept) for every row of docs; t is the hash of the text, the rest as in near_duplicates."""
    signed = park(sign(docs, k))
    with_set = signed.filter("h is not null")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "sig", "n_shingles")).alias("x")
    classes = park(with_set.groupBy("h").agg(first, F.min("doc_id").alias("rep"), F.count("*").alias("copies")).select("h", "rep", "copies", F.col("x.doc_id").alias("holder"), "x.sig", "x.n_shingles"))
    sets_of_trees = candidates(classes.select("h", "sig"), percent / 100)
    found = reduce(DataFrame.unionAll, sets_of_trees)
    clusters = park(components(found))
    sizes = clusters.join(classes.select(F.col("h").alias("node"), "n_shingles"), "node").groupBy("component").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("weight"))
    large = park(sizes.filter((F.col("size") > NODE) | (F.col("weight") > WEIGHT)).select("component"))
    n = large.count()
    whole = near(clusters, large, "component", n, "left_anti") if n else clusters
    set_of = classes.select("h", "n_shingles", F.col("holder").alias("doc_id"))
    groups = whole.select(F.col("component").alias("g"), F.col("node").alias("h")).join(set_of, "h").select("g", "h", "doc_id")

    def confirm(groups: DataFrame) -> DataFrame:
        groups = park(groups)
        text = near(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), groups, "doc_id", groups.count(), "inner")
        return park(verify(full_sets(text, k), percent))

    if n:
        inside = near(clusters, large, "component", n, "left_semi").select(F.col("node").alias("a"))
        stars_of = [found.join(inside, "a", "left_semi").withColumn("g", F.xxhash64("node", "a")) for found in sets_of_trees]
        parts = [x.select("g", F.explode(F.array("a", "b")).alias("h")).distinct() for x in stars_of]
        groups = groups.unionByName(bounded(parts[0].join(set_of, "h")).drop("n_shingles"))
    pairs = confirm(groups)
    links = components(pairs)
    for more in parts[1:] if n else []:
        # groups of one component add nothing to it
        part = more.join(links.select(F.col("node").alias("h"), "component"), "h", "left").withColumn("component", F.coalesce("component", "h"))
        open_groups = part.groupBy("g").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("g")
        more = more.join(open_groups, "g", "left_semi").join(set_of, "h")
        pairs = pairs.unionAll(confirm(bounded(more).drop("n_shingles").select("g", "h", "doc_id")))
        links = components(pairs)
    moved = links.join(classes.select(F.col("h").alias("node"), "rep"), "node")
    least = moved.groupBy("component").agg(F.min("rep").alias("component_id"))
    moved = moved.join(least, "component").select(F.col("node").alias("h"), "component_id")
    of_class = classes.select("h", "rep", "copies").join(moved, "h", "left").filter("copies > 1 or component_id is not null")
    of_class = park(of_class.select("h", F.coalesce("component_id", "rep").alias("component_id")))
    # rows of a class without links or copies name themselves and meet nothing
    rows = signed.select("doc_id", "t", "n_shingles", "h")
    found = near(rows.filter("h is not null"), of_class, "h", of_class.count(), "left").select("doc_id", "t", "n_shingles", "component_id")
    out = found.unionAll(rows.filter("h is null").select("doc_id", "t", "n_shingles", F.lit(None).cast("long")))
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "t", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text).

    Two documents link if 100 * intersection >= percent * union of their sets of k-word
    shingles. A null or empty text or one of white space has the empty set and links with
    nothing; one of fewer than k words is one shingle. component_id is the least doc_id
    reachable, kept says that it is the row's own. Repeated rows are copies of each other
    and share their result; different texts under one doc_id are compared each on its own
    set. A null doc_id never names a component others are in; texts of which no copy has an
    id link with their copies only. Other columns of docs are ignored. An empty table gives
    an empty result.
    """
    return resolve(docs, k, percent).drop("t")


def dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with the columns of docs: the rows that are kept, repeats of a text under its id, or under none, once."""
    kept = resolve(docs, k, percent).filter("kept").select("doc_id", "t").distinct()
    same = docs["doc_id"].eqNullSafe(kept["doc_id"]) & F.xxhash64(docs["text"]).eqNullSafe(kept["t"])
    return docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"])
