"""Operator 2: language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are added up by Spark. A count c is kept as its level
1 + floor(log2 c): the n-gram enters the filter at every level up to that, and a reader
recovers the level by probing level after level until one is missing (Talbot and Osborne
2007). N-grams are dealt into groups by the first bits of a key, of which 32 more tell them
apart within a group; the number of groups follows the bytes of text, and the task that adds up a group also fills the group's
own part of the filter, as long as its entries need, so every counted word and pair enters
whatever the size of the corpus. A filter of at most SENT_BYTES is sent to every worker; a
larger one stays a table, and texts in blocks ask it by a join on groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assurance.llm.common import U64, WORDS, crc_mod, mix64, park, run_bounds, runs, words

#: Text bytes of a group, and groups at most; bits of the filter for an entry, of which each sets PROBES.
GROUP_BYTES, MOST_GROUPS, BITS_PER_ENTRY, PROBES = 4 << 20, 1 << 20, 12, 4
#: A filter up to this size is sent to every worker: the size up to which Spark itself sends a table.
SENT_BYTES = 10 << 20
#: Tokens that a task counts before it hands them on, and tokens of a block of texts that asks a larger filter.
FLUSH_TOKENS, BLOCK_TOKENS = 2_000_000, 1_000_000
#: Words whose exact counts every worker gets, at most; rarer words are joined.
COMMON_WORDS = 300_000
#: Smoothing of the word model.
ALPHA = 0.5
END = xxhash.xxh64_intdigest(b" end")
MOST_LEVELS = 48


def hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words, and of the end."""
    found = words(text)
    out = np.empty(len(found) + 1, U64)
    out[:-1] = np.fromiter(map(WORDS.__getitem__, found), U64, len(found))
    out[-1] = END
    return out


def word_keys(h: np.ndarray, bits: int) -> np.ndarray:
    return mix64(h + U64(1)) >> U64(32 - bits)


def pair_keys(before: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(before * U64(0x9E3779B97F4A7C15) + h + U64(2)) >> U64(32 - bits)


def group_of(keys: np.ndarray) -> np.ndarray:
    return keys >> U64(32)


def befores(h: np.ndarray, starts: np.ndarray, end: int = END) -> np.ndarray:
    """The word before each token; before the first of a text stands the end."""
    out = np.r_[h[:1], h[:-1]]
    out[starts] = end
    return out


def level_of(c: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(np.maximum(c, 1))).astype(np.int64)


def bit_places(keys: np.ndarray, level: int, k: int, size: np.ndarray | int) -> np.ndarray:
    """Bit, of size ones, that probe k of (n-gram, level) looks at."""
    return (mix64(keys + U64((level * 16 + k + 1) << 52)) % np.asarray(size, U64)).astype(np.int64)


def squeeze(values: np.ndarray) -> bytes:
    """32-bit integers, mostly small, compressed byte by byte place."""
    return pa.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def expand(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * n, "zstd"), np.uint8).reshape(4, n).T.copy().view("<u4").ravel() if n else np.zeros(0, np.uint32)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys of one group as their differences."""
    return squeeze(np.diff(keys & U64(0xFFFFFFFF), prepend=U64(0)))


def unpack_keys(data: bytes, n: int, group: int) -> np.ndarray:
    return np.cumsum(expand(data, n), dtype=U64) + U64(group << 32)


def group_bits(training: DataFrame) -> int:
    """Bits of a key that name its group, from the bytes of text."""
    size = training.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return min(MOST_GROUPS.bit_length() - 1, max(0, -(-size // GROUP_BYTES) - 1).bit_length())


def count_ngrams(docs: DataFrame, bits: int) -> DataFrame:
    """One row for each group: grp, filter, words, word_counts (of exact 64-bit hashes) and stats.

    A task hands on sorted counts of FLUSH_TOKENS tokens, packed by group; a second one adds
    up each group and fills its filter. stats holds n-grams and tokens by order and level.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate(held)
            starts = np.cumsum([0, *map(len, held)])[:-1]
            kinds, n1 = np.unique(h, return_counts=True)
            order = np.argsort(word_keys(kinds, bits))
            kinds, n1 = kinds[order], n1[order]
            pairs, n2 = np.unique(pair_keys(befores(h, starts), h, bits), return_counts=True)
            edges = np.arange(1, 1 << bits).astype(U64) << U64(32)
            cut1, cut2 = (np.r_[0, np.searchsorted(k, edges), len(k)] for k in (word_keys(kinds, bits), pairs))
            use = np.flatnonzero((np.diff(cut1) > 0) | (np.diff(cut2) > 0))
            spans = [(slice(cut1[g], cut1[g + 1]), slice(cut2[g], cut2[g + 1])) for g in use]
            cells = [(kinds[a].tobytes(), squeeze(n1[a]), pack_keys(pairs[b]), squeeze(n2[b])) for a, b in spans]
            sizes = [pa.array(np.diff(c)[use], pa.int64()) for c in (cut1, cut2)]
            return pa.RecordBatch.from_arrays([pa.array(use, pa.int64()), *sizes, *(pa.array(c, pa.binary()) for c in zip(*cells, strict=True))], ["grp", "n1", "n2", "words", "word_counts", "pairs", "pair_counts"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(hashes(text))
                size += len(held[-1])
                if size > FLUSH_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kinds, back = np.unique(keys, return_inverse=True)
        return kinds, np.bincount(back, counts, len(kinds)).astype(np.int64)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "grp"):
            grp = t.column("grp").to_numpy()
            bounds = run_bounds(grp)
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                own = t.slice(s, e - s).to_pydict()
                kinds, n1 = added(np.frombuffer(b"".join(own["words"]), U64), np.concatenate(list(map(expand, own["word_counts"], own["n1"]))))
                pairs, n2 = added(np.concatenate([unpack_keys(x, n, int(grp[s])) for x, n in zip(own["pairs"], own["n2"], strict=True)]), np.concatenate(list(map(expand, own["pair_counts"], own["n2"]))))
                keys, levels = np.concatenate([word_keys(kinds, bits), pairs]), level_of(np.concatenate([n1, n2]))
                size = max(64, -(-int(levels.sum()) * BITS_PER_ENTRY // 64) * 64)
                mine = np.zeros(size, bool)
                for j in range(1, int(levels.max()) + 1):
                    x = keys[levels >= j]
                    for k in range(PROBES):
                        mine[bit_places(x, j, k, size)] = True
                stats = [np.bincount(level_of(c), x, MOST_LEVELS) for c in (n1, n2) for x in (None, c)]
                yield pa.RecordBatch.from_pydict({"grp": pa.array([grp[s]]), "filter": pa.array([np.packbits(mine, bitorder="little").tobytes()]), "words": pa.array([kinds.tobytes()]), "word_counts": pa.array([n1.tobytes()]), "stats": pa.array([np.concatenate(stats).astype(np.int64)], pa.list_(pa.int64()))})

    parts = docs.select(F.col("text").cast("string")).mapInArrow(count, "grp long, n1 long, n2 long, words binary, word_counts binary, pairs binary, pair_counts binary")
    return parts.repartition("grp").sortWithinPartitions("grp").mapInArrow(fill, "grp long, filter binary, words binary, word_counts binary, stats array<long>")


def exact_words(groups: DataFrame) -> DataFrame:
    """(h, c): the exact count of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c in zip(*batch.columns, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_buffer(), np.int64)) for x in (h, c)], ["h", "c"])

    return groups.select("words", "word_counts").mapInArrow(run, "h long, c long")


class Filter:
    """The whole filter in one worker: each group's bits one after another."""

    def __init__(self, bits: int, groups: np.ndarray, parts: list[bytes]):
        self.size, self.at = np.full(1 << bits, 64, np.int64), np.zeros(1 << bits, np.int64)
        lengths = np.array([len(p) for p in parts], np.int64)
        self.size[groups] = lengths * 8
        self.at[groups] = 8 + np.cumsum(lengths) - lengths  # groups without a part read eight zero bytes
        self.flat = np.frombuffer(bytes(8) + b"".join(parts), np.uint8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        group = group_of(keys).astype(np.int64)
        return probe(self.flat, keys, self.size[group], self.at[group])


def probe(flat: np.ndarray, keys: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Levels of n-grams: the filter is asked for level 1, 2, ... until it says no; size in bits and first byte of each one's part."""
    level = np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    for j in range(1, MOST_LEVELS):
        for k in range(PROBES):
            place = bit_places(keys[live], j, k, size[live])
            live = live[(flat[at[live] + (place >> 3)] >> (place & 7).astype(np.uint8)) & 1 == 1]
        if not len(live):
            break
        level[live] = j
    return level


class Numbers:
    """What the whole training set says: tokens, distinct words, each level's mean count, and the weight of the pair model."""

    def __init__(self, groups: DataFrame):
        got = np.zeros(4 * MOST_LEVELS)
        # one row for each level
        for r in groups.select(F.posexplode("stats").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect():
            got[r["i"]] = r["n"]
        n1, t1, n2, t2 = got.reshape(4, -1)
        self.tokens, self.types = int(t1.sum()), int(n1.sum())
        middle = np.r_[0.0, 2.0 ** (np.arange(1, MOST_LEVELS) - 0.5)]
        self.words, self.pairs = np.where(n1 > 0, t1 / np.maximum(n1, 1), middle), np.where(n2 > 0, t2 / np.maximum(n2, 1), middle)
        # pairs seen once are, by Good and Turing, as much as the next text has of unseen ones
        self.weight = float(1 - n2[1] / t2.sum()) if t2.sum() else 0.0


def token_scores(level1: np.ndarray, level2: np.ndarray, codes: np.ndarray, starts: np.ndarray, end: int, numbers: Numbers) -> np.ndarray:
    """log10 probabilities of all tokens; level1 by distinct word, level2 by token.

    p(w | v) = weight * c(v, w) / c(v) + (1 - weight) * p(w) for a known v, else p(w);
    p(w) = (c(w) + ALPHA) / (N + ALPHA * (V + 1)). Counts are their level's mean.
    """
    c1 = numbers.words[level1]
    p1 = (c1 + ALPHA) / (numbers.tokens + ALPHA * (numbers.types + 1))
    context = c1[befores(codes, starts, end)]
    c2 = np.minimum(numbers.pairs[level2], context)
    weight = np.where(context > 0, numbers.weight, 0.0)
    return np.log10(weight * c2 / np.maximum(context, 1e-9) + (1 - weight) * p1[codes])


class Block:
    """Texts whose n-grams are asked together: distinct words, the commonest first, and each token's place among them."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, kinds: np.ndarray, codes: np.ndarray, bits: int):
        self.ids, self.lengths, self.kinds, self.codes = ids, lengths, kinds, codes
        self.starts = np.cumsum(lengths) - lengths
        self.end = int(np.flatnonzero(kinds == U64(END))[0])
        h = kinds[codes]
        pairs, self.back = np.unique(pair_keys(befores(h, self.starts), h, bits), return_inverse=True)
        self.keys = np.concatenate([word_keys(kinds, bits), pairs])

    @classmethod
    def of(cls, ids: pa.Array, texts: list[np.ndarray], bits: int) -> Block:
        kinds, codes, times = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return cls(ids, np.array([len(x) for x in texts]), kinds[order], rank[codes], bits)

    def pack(self) -> bytes:
        codes = squeeze(self.codes)
        head = np.array([len(self.lengths), len(self.kinds), len(self.codes), len(codes)], np.int64)
        ids = self.ids.cast(pa.int64())
        return b"".join([head.tobytes(), ids.is_valid().to_numpy(False).tobytes(), ids.fill_null(0).to_numpy().tobytes(), self.lengths.astype(np.int64).tobytes(), self.kinds.tobytes(), codes])

    @classmethod
    def unpack(cls, data: bytes, bits: int) -> Block:
        rows, n, tokens, size = np.frombuffer(data, np.int64, 4).tolist()
        known = np.frombuffer(data, bool, rows, 32)
        ids = np.frombuffer(data, np.int64, rows, at := 32 + rows)
        lengths = np.frombuffer(data, np.int64, rows, at := at + 8 * rows)
        kinds = np.frombuffer(data, U64, n, at := at + 8 * rows)
        codes = expand(data[at + 8 * n : at + 8 * n + size], tokens).astype(np.int64)
        return cls(pa.array(ids, mask=~known), lengths, kinds, codes, bits)

    def rows(self, first: int, levels: np.ndarray, numbers: Numbers, known_h: np.ndarray, known_c: np.ndarray) -> pa.RecordBatch:
        """SCORED of each text: numbers of tokens and known ones, gains and score, and the words to look up by a join."""
        each = token_scores(levels[: len(self.kinds)], levels[len(self.kinds) :][self.back], self.codes, self.starts, self.end, numbers)
        place = np.minimum(np.searchsorted(known_h, self.kinds), max(0, len(known_h) - 1))
        here = known_h[place] == self.kinds if len(known_h) else np.zeros(len(self.kinds), bool)
        gain = np.where(here, np.log10(known_c[place] + 1.0), 0.0) if len(known_h) else np.zeros(len(self.kinds))
        rare = np.flatnonzero(~here[self.codes])
        ends = np.searchsorted(rare, np.r_[self.starts, len(self.codes)]).astype(np.int32)
        tail = pa.ListArray.from_arrays(pa.array(ends), pa.array(self.kinds[self.codes[rare]].view(np.int64)))
        sums = [np.add.reduceat(x, self.starts) for x in (here[self.codes].astype(np.int64), gain[self.codes], each)]
        return pa.RecordBatch.from_arrays([pa.array(first + np.arange(len(self.lengths))), self.ids, pa.array(self.lengths, pa.int64()), *map(pa.array, sums), tail], ["row", "doc_id", "n_tokens", "n_known", "gain", "score", "tail"])


SCORED = "row long, doc_id long, n_tokens long, n_known long, gain double, score double, tail array<long>"


def as_blocks(docs: DataFrame, bits: int) -> DataFrame:
    """(block, data) of docs (doc_id, text); a number of 16 bits follows the partition's in the name of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 16
        ids, texts, size = [], [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([Block.of(pa.array(ids, pa.int64()), texts, bits).pack()], pa.binary())], ["block", "data"])

        for big in batches:
            for at in range(0, big.num_rows, 256):
                for i, text in zip(*(c.to_pylist() for c in big.slice(at, 256).columns), strict=True):
                    ids.append(i)
                    texts.append(hashes(text))
                    size += len(texts[-1])
                    if size >= BLOCK_TOKENS:
                        yield block()
                        name, ids, texts, size = name + 1, [], [], 0
        if texts:
            yield block()

    return docs.mapInArrow(run, "block long, data binary")


def scored_by_join(docs: DataFrame, groups: DataFrame, bits: int, numbers: Numbers, sent) -> DataFrame:
    """SCORED of docs, asked of a filter too large to be sent.

    A block's distinct keys go to the groups that hold them, one row for each block and
    group; the levels come back in the same order. A task holds the bits of one group, or
    one block with its answers.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys = np.sort(Block.unpack(data.as_py(), bits).keys)
                group = group_of(keys)
                bounds = run_bounds(group)
                n = np.diff(bounds)
                asked = [pack_keys(keys[s:e]) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(group[bounds[:-1]].view(np.int64)), pa.array([block] * len(n), pa.int64()), pa.array(n, pa.int64()), pa.array(asked, pa.binary())], ["grp", "block", "n", "data"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, flat = None, np.zeros(8, np.uint8)
        for batch in batches:
            out = []
            for grp, block, n, data in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3), strict=True):
                if grp != now:
                    now, flat = grp, np.zeros(8, np.uint8)
                if n < 0:
                    flat = np.frombuffer(data.as_py(), np.uint8)
                else:
                    keys = unpack_keys(data.as_py(), n, grp)
                    level = probe(flat, keys, np.full(n, 8 * len(flat)), np.zeros(n, np.int64))
                    out.append((block, grp, n, pa.compress(level.astype(np.uint8).tobytes(), "zstd", asbytes=True)))
            if out:
                block, grp, n, level = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (block, grp, n)), pa.array(level, pa.binary())], ["block", "grp", "n", "data"])

    def score(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        known_h, known_c, _ = sent.value
        name = blocks.column("block")[0].as_py()
        block = Block.unpack(blocks.column("data")[0].as_py(), bits)
        answers = answers.sort_by("grp")
        levels = np.empty(len(block.keys), np.int64)
        parts = [pa.decompress(d, n, "zstd", asbytes=True) for n, d in zip(answers.column("n").to_pylist(), answers.column("data").to_pylist(), strict=True)]
        levels[np.argsort(block.keys, kind="stable")] = np.frombuffer(b"".join(parts), np.uint8)
        return pa.Table.from_batches([block.rows(name << 24, levels, numbers, known_h, known_c)])

    blocks = as_blocks(docs, bits).repartition("block")
    asks = blocks.mapInArrow(ask, "grp long, block long, n long, data binary")
    # the bits of a group come before what is asked of it
    held = groups.select("grp", F.lit(None).cast("long").alias("block"), F.lit(-1).cast("long").alias("n"), F.col("filter").alias("data"))
    answers = held.unionByName(asks).repartition("grp").sortWithinPartitions("grp", F.col("block").asc_nulls_first()).mapInArrow(answer, "block long, grp long, n long, data binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCORED)


def score_texts(docs: DataFrame, training: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of docs (doc_id, text).

    The model is learned from all rows of training (text). A null text counts as empty: its
    only token is the end. Words are split at ASCII white space and A-Z lower-cased; texts
    of any length count whole, repeated rows count again and score alike, rows with equal or
    null ids each have their own. With no training rows nothing is known and every term is that of
    an unseen word; no docs give no rows. Other columns are ignored. Exact counts of common words go
    to every worker; those of all other words come by a join, in which no key is frequent.
    """
    spark = docs.sparkSession
    bits = group_bits(training)
    groups = park(count_ngrams(training, bits))
    numbers = Numbers(groups)
    singles = exact_words(groups)
    # rows of a histogram over quarter powers of two: at most 4 * 63
    bucket = F.floor(4 * F.log2("c") + 1e-9).cast("int")
    least, room = 1 << 30, COMMON_WORDS
    for r in sorted(singles.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["b"]):
        room -= r["n"]
        if room < 0:
            break
        least = r["b"]
    common = singles.filter(bucket >= least).toArrow()
    order = np.argsort(common.column("h").to_numpy().view(U64))
    common_h, common_c = common.column("h").to_numpy().view(U64)[order], common.column("c").to_numpy()[order]
    small = (groups.agg(F.sum(F.octet_length("filter"))).first()[0] or 0) <= SENT_BYTES
    whole = None
    if small:
        held = groups.select("grp", "filter").toArrow()
        whole = Filter(bits, held.column("grp").to_numpy(), held.column("filter").to_pylist())
    sent = spark.sparkContext.broadcast((common_h, common_c, whole))
    total = float(np.log10(numbers.tokens + numbers.types + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_h, known_c, whole = sent.value
        row = TaskContext.get().partitionId() << 40
        for big in batches:
            for at in range(0, big.num_rows, 256):
                batch = big.slice(at, 256)
                block = Block.of(batch.column(0), [hashes(t) for t in batch.column(1).to_pylist()], bits)
                yield block.rows(row, whole.levels(block.keys), numbers, known_h, known_c)
                row += batch.num_rows

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = park(docs.mapInArrow(run, SCORED) if small else scored_by_join(docs, groups, bits, numbers, sent))
    rare = singles.filter(bucket < least)
    tails = scored.select("row", F.explode("tail").alias("h")).join(rare, "h").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("more_gain"))
    out = scored.drop("tail").join(tails, "row", "left")
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(numbers.tokens).cast("long").alias("train_tokens"),
        (F.col("gain") + F.coalesce("more_gain", F.lit(0.0)) - F.col("n_tokens") * total).alias("base_score"),
        "score",
    )


def op2(docs: DataFrame) -> DataFrame:
    held_out = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))
    out = score_texts(docs.select("doc_id", "text"), docs.filter(~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
