"""Operator 13: document fingerprints by I-Match with randomised lexicon subsets.

The lexicon holds the terms whose inverse document frequency lies in a band: in no more than
one of COMMON documents and in at least one of RARE, or more where that is needed to bound
it: with `total` the documents of all these terms together, fewer than MOST terms can be in
total / MOST documents each. So it fits every worker, however many documents there are. Of a
document's terms in the lexicon, sorted and distinct, SUBSETS randomised parts of the lexicon
are hashed on each of LEVELS levels. A part of level l holds each term with chance 2^-l; a
document takes the levels that leave it about one term a part or less, so that an edit
changes only the hashes of the parts it touches. Likeness is the share of equal hashes among the parts in
which either document has a term.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assurance.llm.common import U64, mix64, park, slices

#: The band: at least one document in RARE, at most one in COMMON. Texts with fewer terms of the band than LEAST use all their terms.
RARE, COMMON, LEAST = 1000, 10, 4
SUBSETS, LEVELS = 12, 3
#: Most terms of the lexicon, 8 bytes each.
MOST = 1_000_000
APART = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text of one step; terms counted in a task before they are passed on.
TEXT, HELD = 4 << 20, 2_000_000
NONE = "-" * 8


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code) of the distinct terms of each text, sorted, and the sorted terms that the codes stand for."""
    found = pc.split_pattern_regex(pc.ascii_lower(texts.fill_null("")), APART)
    flat, row = found.flatten(), pc.list_parent_indices(found).to_numpy()
    use = pc.not_equal(flat, "")
    flat, row = flat.filter(use).dictionary_encode(), row[use.to_numpy(zero_copy_only=False)].astype(np.int64)
    order = pc.sort_indices(flat.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    n = max(1, len(order))
    pair = np.unique(row * n + place[flat.indices.to_numpy()])
    return pair // n, pair % n, flat.dictionary.take(order)


def hashes(terms: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in terms.cast(pa.binary()).to_pylist()), U64, len(terms))


def frequencies(docs: DataFrame) -> DataFrame:
    """(term, docs): the hash of every term and the number of documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts = np.zeros(0, U64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts)], ["term", "docs"])

        for big in batches:
            for batch in slices(big, 0, TEXT):
                _, code, names = terms_of(batch.column(0))
                both = np.concatenate([terms, hashes(names)])
                n = np.concatenate([counts, np.bincount(code, minlength=len(names))])
                terms, back = np.unique(both, return_inverse=True)
                counts = np.bincount(back, n, len(terms)).astype(np.int64)
                if len(terms) > HELD:
                    yield out()
                    terms, counts = np.zeros(0, U64), np.zeros(0, np.int64)
        if len(terms):
            yield out()

    each = docs.select(F.col("text").cast("string")).mapInArrow(run, "term long, docs long")
    return each.groupBy("term").agg(F.sum("docs").alias("docs"))


def lexicon(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the terms in the band of docs, MOST at most."""
    n = docs.count()
    chosen = park(frequencies(docs).filter((F.col("docs") * RARE >= n) & (F.col("docs") * COMMON <= n)))
    total = chosen.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    terms = chosen.filter(F.col("docs") * MOST >= total).select("term").toPandas()["term"]
    return np.sort(np.asarray(terms, np.int64).view(U64))


def levels(h: np.ndarray) -> np.ndarray:
    """[SUBSETS, terms]: up to which level each randomised part holds each term."""
    out = np.zeros((SUBSETS, len(h)), np.uint8)
    for j in range(SUBSETS):
        x = mix64(h ^ mix64(np.array([j + 1], U64)))
        out[j] = 64 - np.ceil(np.log2(np.maximum(x, U64(1)).astype(np.float64))).astype(np.uint8)
    return out


def fingerprints(texts: pa.Array, band: np.ndarray) -> list[str]:
    """One string for each text: kind (b: terms of the band, w: all terms), level, and the hashes of SUBSETS parts of it and of each of the next levels; "" without terms."""
    row, code, names = terms_of(texts)
    h = hashes(names)
    at = np.searchsorted(band, h)
    known = (at < len(band)) & (band[np.minimum(at, len(band) - 1)] == h) if len(band) else np.zeros(len(h), bool)
    n = len(texts)
    in_band = np.bincount(row[known[code]], minlength=n)
    whole = in_band < LEAST
    use = known[code] | whole[row]
    row, code = row[use], code[use]
    size = np.bincount(row, minlength=n)
    level = np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)
    depth = levels(h)
    parts = np.full((n, LEVELS * SUBSETS), NONE, "U8")
    for j in range(SUBSETS):
        reach = depth[j][code]
        for more in range(LEVELS):
            held = reach >= level[row] + more
            who, data = row[held], h[code[held]].tobytes()
            starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, np.int64)
            ends = np.r_[starts[1:], len(who)] if len(who) else starts
            for r, a, b in zip(who[starts].tolist(), starts.tolist(), ends.tolist(), strict=True):
                parts[r, more * SUBSETS + j] = xxhash.xxh32_hexdigest(data[8 * a : 8 * b])
    return [f"{'w' if w else 'b'}{lv:02x}:{'.'.join(p)}" if s else "" for w, lv, p, s in zip(whole, level.tolist(), parts.tolist(), size, strict=True)]


def likeness(a: str, b: str) -> float:
    """Share of equal hashes among the parts of common levels in which either has a term; 1 for equal fingerprints, 0 without a common level."""
    if a == b:
        return 1.0
    if not a or not b or a[0] != b[0]:
        return 0.0
    x, y = a[4:].split("."), b[4:].split(".")
    skip = SUBSETS * (int(a[1:3], 16) - int(b[1:3], 16))  # parts of b below a's first level
    x, y = (x, y[skip:]) if skip >= 0 else (x[-skip:], y)
    both = [(p, q) for p, q in zip(x, y, strict=False) if p != NONE or q != NONE]
    return sum(p == q for p, q in both) / len(both) if both else 0.0


def imatch(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row of docs (doc_id, text), under the lexicon of all of them; rows as in op13."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, 1, TEXT):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1), sent.value), pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def bucket_of(ids: np.ndarray, h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Buckets that ascend with (id, h); an id that stands at several cuts is spread over their buckets by h."""
    low, high = np.searchsorted(cuts, ids, "left"), np.searchsorted(cuts, ids, "right")
    part = (h.view(U64) ^ U64(1 << 63)).astype(np.float64) / 2.0**64
    return low + np.minimum(high - low, np.floor(part * (high - low + 1)).astype(np.int64))


def followed(docs: DataFrame) -> DataFrame:
    """Rows (bucket, guest, id, h, doc_id, data) of docs; the first row of each bucket is also the guest behind the last of the bucket before, the very first behind the very last."""
    top = (1 << 63) - 1
    h = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(top)).alias("id"), h, F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n = max(1, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = np.array(docs.select(F.expr(f"percentile_approx(coalesce(cast(doc_id as long), {top}), array({', '.join(str(k / n) for k in range(1, n))}), 10000)")).first()[0] or [], np.int64)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = bucket_of(b.column(0).to_numpy(), b.column(1).to_numpy(), cuts)
            order = np.lexsort((b.column(1).to_numpy(), b.column(0).to_numpy(), at))
            first = order[np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])] if len(order) else order
            yield pa.RecordBatch.from_arrays([pa.array(at[first]), b.column(0).take(pa.array(first)), b.column(1).take(pa.array(first))], ["bucket", "id", "h"])

    heads = rows.select("id", "h").mapInArrow(least, "bucket long, id long, h long").groupBy("bucket").agg(F.min(F.struct("id", "h")).alias("x")).select("bucket", "x.id", "x.h").collect()
    heads = sorted((r["bucket"], r["id"], r["h"]) for r in heads)  # one a bucket: as many as partitions
    before = {(i, h): heads[k - 1][0] for k, (_, i, h) in enumerate(heads)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for b in batches:
            ids, h = b.column(0).to_numpy(), b.column(1).to_numpy()
            at = bucket_of(ids, h, cuts)
            guests = np.fromiter(((i, x) in before for i, x in zip(ids.tolist(), h.tolist(), strict=True)), bool, len(ids))
            to = np.fromiter((before[(i, x)] for i, x in zip(ids[guests].tolist(), h[guests].tolist(), strict=True)), np.int64, int(guests.sum()))
            data = pa.array([squeeze.compress((t or "").encode()) for t in b.column(3).to_pylist()], pa.binary())
            take = pa.array(np.concatenate([np.arange(len(ids)), np.flatnonzero(guests)]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, to])), pa.array(np.arange(len(take)) >= len(ids)), b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), data.take(take)], ["bucket", "guest", "id", "h", "doc_id", "data"])

    kind = "bucket long, guest boolean, id long, h long, doc_id long, data binary"
    return rows.mapInArrow(run, kind).repartition(n, "bucket").sortWithinPartitions("bucket", "guest", "id", "h")


def op13(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of docs (doc_id, text).

    Null texts are empty. The next document is the next row by doc_id, then by the hash of
    the text; null ids come last, repeated rows are rows of their own, a single row follows
    itself. Texts with fewer than LEAST terms of the band are printed by all their terms;
    those without a term have the fingerprint "". Equal fingerprints have the likeness 1.
    Other columns are ignored; an empty table gives an empty result. Words are those of
    operator 12. The lexicon covers all texts of docs; edited texts are not part of it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(lexicon(docs))

    def results(ids: list, texts: list[str], more: str) -> pa.RecordBatch:
        edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, [*texts[1:], more], strict=True)]
        own = fingerprints(pa.array([*texts, more], pa.string()), sent.value)
        new = fingerprints(pa.array(edited, pa.string()), sent.value)
        digest = [hashlib.sha256(e.encode()).hexdigest() for e in edited]
        close = [likeness(a, b) for a, b in zip(own, new, strict=False)]
        following = [likeness(a, b) for a, b in zip(own[:-1], own[1:], strict=True)]
        columns = [pa.array(ids, pa.int64()), pa.array(list(map(len, texts)), pa.int64()), *(pa.array(c, pa.string()) for c in (digest, own[:-1], new)), pa.array(close, pa.float64()), pa.array(following, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        ids, texts, size, bucket = [], [], 0, None
        for batch in batches:
            for b, guest, doc_id, data in zip(*(batch.column(c).to_pylist() for c in (0, 1, 4, 5)), strict=True):
                if guest and b != bucket:
                    continue  # another row equal to the guest that has closed this bucket
                text = open_.decompress(data).decode()
                if texts and (guest or size > TEXT):
                    yield results(ids, texts, text)
                    ids, texts, size = [], [], 0
                if guest:
                    bucket = None
                else:
                    ids.append(doc_id)
                    texts.append(text)
                    size, bucket = size + len(text), b

    return followed(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
