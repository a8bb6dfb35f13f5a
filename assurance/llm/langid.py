"""Operator 1: language identification by interpolated Kneser-Ney character models.

Four-symbol counts of each language come from one Spark aggregation; the lower orders are
continuation counts, so they follow from the distinct four-grams. For every gram that any
language has seen, the model keeps its log probability under all languages beside its
64-bit hash in one sorted array, so a text is scored by one binary search for each symbol
and, for unseen grams, back-off weights from the sorted arrays of contexts. The language
of least cross-entropy per symbol wins; rows of the training set that were not counted
set the temperature of the score and the rejection limit: the excess of a text over its
language's mean, in deviations expected at its length, that a stated share of them exceeds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assurance.llm.common import crc_mod, mix64, park, plus

ORDER = 4
START, BLANK = 1, 32
#: Labelled rows of each language that the model learns from, at most in expectation; whole texts.
SAMPLE_ROWS = 3000
#: Share of the rows kept for calibration that the rejection limit leaves out.
REJECT_RATE = 0.0005
TEMPERATURES = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)
UNKNOWN = "und"


@lru_cache(1)
def symbol_table() -> np.ndarray:
    """Symbol of each code point: letters of the first plane stand for themselves, later ones share 0xFFFF, the rest is blank."""
    table = np.full(0x110000, BLANK, np.uint16)
    for i in range(0x110000):
        if chr(i).isalpha():
            table[i] = min(i, 0xFFFF)
    table[START] = START
    return table


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased symbols of all texts in one array, and the place where each text begins.

    Before each text stand three start symbols; runs of other characters are one blank.
    """
    joined = "".join("\x01\x01\x01 " + (t or "").lower().replace("\x01", " ") + " " for t in texts)
    s = symbol_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
    s = s[np.r_[True, (s[1:] != BLANK) | (s[:-1] != BLANK)]]
    starts = np.flatnonzero(s == START)[::3]
    return s, starts


def keys(s: np.ndarray, n: int) -> np.ndarray:
    """The n symbols that end at each place from ORDER - 1 on, 16 bits each."""
    out = np.zeros(len(s) - ORDER + 1, np.uint64)
    for k in range(n):
        out |= s[ORDER - 1 - k : len(s) - k] << np.uint64(16 * k)
    return out


def low(k: np.ndarray, n: int) -> np.ndarray:
    return k & np.uint64((1 << (16 * n)) - 1)


class Language:
    """Exact interpolated Kneser-Ney probabilities of one language."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        order = np.argsort(grams)
        k, c = grams[order], counts[order].astype(float)
        self.orders = {}
        for n in range(ORDER, 0, -1):
            ctx, place = np.unique(k >> np.uint64(16), return_inverse=True)
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            d = float(np.clip(n1 / max(1, n1 + 2 * n2), 0.1, 0.9))
            total, types = np.bincount(place, c), np.bincount(place)
            self.orders[n] = (k, c, ctx, total, np.log(d * types / total), d)
            k, c = np.unique(low(k, n - 1), return_counts=True)
            c = c.astype(float)
        self.floor = 1.0 / (len(self.orders[1][0]) + 1)

    @staticmethod
    def find(sorted_keys: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(sorted_keys, k), len(sorted_keys) - 1)
        return at, sorted_keys[at] == k

    def back_off(self, n: int, contexts: np.ndarray) -> np.ndarray:
        """log weight that a context of order n leaves to the lower order; 0 if it was never seen."""
        _, _, ctx, _, weight, _ = self.orders[n]
        at, seen = self.find(ctx, contexts)
        return np.where(seen, weight[at], 0.0)

    def prob(self, n: int, k: np.ndarray) -> np.ndarray:
        if n == 0:
            return np.full(len(k), self.floor)
        grams, c, ctx, total, _, d = self.orders[n]
        lower = self.prob(n - 1, low(k, n - 1))
        at, seen = self.find(ctx, k >> np.uint64(16))
        own, here = self.find(grams, k)
        mass = np.where(here, np.maximum(c[own] - d, 0), 0.0) / np.where(seen, total[at], 1.0)
        return mass + np.exp(self.back_off(n, k >> np.uint64(16))) * lower


class Model:
    """Sorted hash arrays over all languages."""

    def __init__(self, names: list[str], parts: list[tuple[np.ndarray, np.ndarray]]):
        self.names = names
        langs = [Language(*p) for p in parts]
        self.grams, self.contexts = {}, {}
        for n in range(ORDER, 0, -1):
            k = np.unique(np.concatenate([x.orders[n][0] for x in langs]))
            self.grams[n] = self.sorted(k, np.stack([np.log(x.prob(n, k)) for x in langs], 1))
            ctx = np.unique(np.concatenate([x.orders[n][2] for x in langs]))
            self.contexts[n] = self.sorted(ctx, np.stack([x.back_off(n, ctx) for x in langs], 1))
        self.floor = np.log(np.array([x.floor for x in langs], np.float32))

    @staticmethod
    def sorted(k: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix64(k)
        order = np.argsort(h)
        return h[order], values[order].astype(np.float32)

    @staticmethod
    def look(table: tuple[np.ndarray, np.ndarray], k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix64(k)
        at = np.minimum(np.searchsorted(table[0], h), len(table[0]) - 1)
        return table[1][at], table[0][at] == h

    def log_prob(self, k: np.ndarray, n: int = ORDER) -> np.ndarray:
        """[places, languages] log probabilities of grams of order n."""
        if n == 0:
            return np.broadcast_to(self.floor, (len(k), len(self.floor)))
        out, seen = self.look(self.grams[n], k)
        miss = np.flatnonzero(~seen)
        if len(miss):
            part = k[miss]
            weight, known = self.look(self.contexts[n], part >> np.uint64(16))
            out[miss] = np.where(known[:, None], weight, 0) + self.log_prob(low(part, n - 1), n - 1)
        return out

    def cross_entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per symbol under each language, and the number of symbols, of each text."""
        s, starts = symbols(texts)
        k = keys(s, ORDER)
        real = s[ORDER - 1 :] != START
        doc = np.searchsorted(starts, np.arange(ORDER - 1, len(s)), "right") - 1
        sums = np.zeros((len(texts), len(self.names)))
        for at in range(0, len(k), 200_000):
            use = np.flatnonzero(real[at : at + 200_000]) + at
            if not len(use):
                continue
            lp, d = self.log_prob(k[use]), doc[use]
            first = np.r_[0, np.flatnonzero(d[1:] != d[:-1]) + 1]
            sums[d[first]] += np.add.reduceat(lp, first, axis=0, dtype=np.float64)
        n = np.bincount(doc[real], minlength=len(texts))
        return -sums / np.maximum(n, 1)[:, None], n


def count_grams(train: DataFrame) -> DataFrame:
    """(lang, gram, n) over the whole texts of (lang, text); each batch is added up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 512):
                batch = big.slice(at, 512)
                langs, texts = np.array(batch.column(0).to_pylist(), object), np.array(batch.column(1).to_pylist(), object)
                for lang in dict.fromkeys(langs.tolist()):
                    s, _ = symbols(texts[langs == lang].tolist())
                    k, n = np.unique(keys(s, ORDER)[s[ORDER - 1 :] != START], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(k), pa.string()), "gram": k.view(np.int64), "n": n})

    return train.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Identifier:
    """A trained model, its calibration, and the job that applies both."""

    def __init__(self, spark, model: Model | None, temperature: float = 1.0, limits: dict[str, tuple[float, float, float, float]] | None = None):
        self.model, self.temperature, self.limits = model, temperature, limits or {}
        self.sent = spark.sparkContext.broadcast((model, temperature, self.limits))

    def entropies(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs with cross_entropy array<double> (in the order of the model's names) and n_symbols long."""
        sent = self.sent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = sent.value[0]
            for big in batches:
                for at in range(0, big.num_rows, 256):
                    batch = big.slice(at, 256)
                    ce, n = model.cross_entropy(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(ce), pa.list_(pa.float64())), pa.array(n, pa.int64())], [*batch.schema.names, "cross_entropy", "n_symbols"])

        docs = docs.drop("cross_entropy", "n_symbols")
        return docs.mapInArrow(run, plus(docs, "cross_entropy array<double>, n_symbols long"))

    def predict(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs with lang_pred, score, nats and rejected; clashing columns give way.

        A text that is null or has no letter is "und" with score 0 and rejected; if nothing
        was learned, every text is "und" with score 0 and those with a letter are not rejected. Ties go to the name that sorts first. Texts of
        any length are read whole; equal texts get equal results.
        """
        docs = docs.drop("lang_pred", "score", "nats", "rejected")
        sent = self.sent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, temperature, limits = sent.value
            for big in batches:
                for at in range(0, big.num_rows, 256):
                    batch = big.slice(at, 256)
                    texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                    if model is None:
                        n_rows = len(texts)
                        more = [[UNKNOWN] * n_rows, [0.0] * n_rows, [None] * n_rows, [not any(map(str.isalpha, t or "")) for t in texts]]
                    else:
                        ce, n = model.cross_entropy(texts)
                        best = ce.argmin(1)
                        least = ce[np.arange(len(ce)), best]
                        p = 1 / np.exp(-temperature * (ce - least[:, None])).sum(1)
                        letters = [bool(t) and any(map(str.isalpha, t)) for t in texts]
                        mean, base, slope, most = np.array([limits.get(x, (0.0, 1.0, 0.0, np.inf)) for x in model.names])[best].T
                        limit = mean + most * np.sqrt(base + slope / np.maximum(n, 1))
                        more = [
                            [model.names[b] if y else UNKNOWN for b, y in zip(best, letters, strict=True)],
                            [float(x) if y else 0.0 for x, y in zip(p, letters, strict=True)],
                            [float(x) if y else None for x, y in zip(least, letters, strict=True)],
                            [not y or bool(a > b) for y, a, b in zip(letters, least, limit, strict=True)],
                        ]
                    more = [pa.array(v, t) for v, t in zip(more, (pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "lang_pred", "score", "nats", "rejected"])

        return docs.mapInArrow(run, plus(docs, "lang_pred string, score double, nats double, rejected boolean"))


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Identifier:
    """Fit on labelled (doc_id, text, lang).

    The classifier is fitted on a sample of about sample_rows rows of each language, drawn
    by a hash of doc_id; of these, one quarter (doc_id hash) is kept from the counts to
    calibrate. Rows with a null lang or a text without letters teach nothing. What reaches
    the driver is the table of the sample's grams, whole, and one row for each language.
    """
    spark = labelled.sparkSession
    rows = labelled.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    # one small row for each language
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Identifier(spark, None)
    rate = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(int(min(1.0, sample_rows / n) * 1_000_000)))))
    drawn = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1_000_000)) < rate[F.col("lang")])
    drawn = drawn.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(4)) == 3)
    counts = park(count_grams(drawn.filter("not held")))
    got = counts.toArrow()
    names = sorted(set(got.column("lang").to_pylist()))
    if not names:
        return Identifier(spark, None)
    langs = np.array(got.column("lang").to_pylist(), object)
    grams, n = got.column("gram").to_numpy().view(np.uint64), got.column("n").to_numpy()
    model = Model(names, [(grams[langs == x], n[langs == x]) for x in names])
    return calibrate(Identifier(spark, model), drawn.filter("held"))


def calibrate(found: Identifier, held: DataFrame) -> Identifier:
    """Temperature of least log loss and each language's limit, as sums over the held rows."""
    names = found.model.names
    rows = found.entropies(held.filter(F.col("lang").isin(names)).select("lang", "text"))
    place = F.create_map(*(x for i, k in enumerate(names) for x in (F.lit(k), F.lit(i))))
    rows = rows.filter("n_symbols > 0").withColumn("own", F.col("cross_entropy")[place[F.col("lang")]])
    least = F.array_min("cross_entropy")

    def loss(t: float):
        terms = F.transform("cross_entropy", lambda x: F.exp((least - x) * t))
        return F.sum(F.log(F.aggregate(terms, F.lit(0.0), lambda total, x: total + x)) + (F.col("own") - least) * t)

    losses = [loss(t).alias(f"t{i}") for i, t in enumerate(TEMPERATURES)]
    means = rows.groupBy("lang").agg(F.avg("own").alias("mean"), *losses).collect()
    if not means:
        return found
    total = [sum(r[f"t{i}"] for r in means) for i in range(len(TEMPERATURES))]
    mean = F.create_map(*(x for r in means for x in (F.lit(r["lang"]), F.lit(r["mean"]))))
    # squared excess as a line over 1 / length
    rows = rows.withColumn("excess", F.col("own") - mean[F.col("lang")]).withColumn("x", 1 / F.col("n_symbols")).withColumn("y", F.col("excess") ** 2)
    lines = rows.groupBy("lang").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("xx")).collect()
    spread = {}
    for r in lines:
        slope = max(0.0, r["xy"] / r["xx"]) if r["xx"] else 0.0
        spread[r["lang"]] = (max(r["y"] - slope * r["x"], 0.05 * r["y"], 1e-4), slope)
    base, slope = (F.create_map(*(x for k, v in spread.items() for x in (F.lit(k), F.lit(v[i]))))[F.col("lang")] for i in (0, 1))
    # at most the rows of the sample
    limit = rows.select((F.col("excess") / F.sqrt(base + slope * F.col("x"))).alias("z")).agg(F.percentile("z", F.lit(1 - REJECT_RATE))).first()[0]
    limits = {r["lang"]: (r["mean"], *spread[r["lang"]], float(limit)) for r in means}
    return Identifier(held.sparkSession, found.model, TEMPERATURES[int(np.argmin(total))], limits)


def filter_language(docs: DataFrame, training: DataFrame) -> DataFrame:
    """The rows of docs whose language is recognised, with the columns of docs."""
    return train(training).predict(docs).filter("not rejected").select(docs.columns)


def op1(docs: DataFrame) -> DataFrame:
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    found = train(docs.filter(~held_out))
    out = found.predict(docs.select("doc_id", "text"))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "nats", "rejected")
