"""Operators 11 to 13: vector codes, source divergence and fingerprints."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assurance.llm import codebooks, divergence, imatch
from assurance.llm.queries import oracle_sql, queries
from .helpers import SCHEMA, corpus, odd_rows

VECTORS = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("name", ["op11_cover_tree_codes", "op12_divergence_skyband"])
def test_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    theirs = con.execute(oracle_sql()[name])
    columns = [c[0] for c in theirs.description]
    mine = sorted(map(tuple, queries()[name](spark, sf).select(*columns).collect()))
    assert mine == sorted(theirs.fetchall())
    assert len(mine) > 400


# operator 11


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 60), st.integers(0, 5), st.integers(0, 6), st.integers(0, 2**31))
def test_tree_assigns_like_all_comparisons(n, width, spread, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-spread, spread + 1, (n, width))
    book = np.concatenate([x[: max(1, n // 3)], rng.integers(-spread, spread + 1, (4, width))])
    tree = codebooks.Tree.unpacked(codebooks.build(x).packed(), width)
    sums, counts, entry = codebooks.assign(tree, book, True)
    nearest = ((x[:, None] - book[None]) ** 2).sum(2).argmin(1)
    expect = np.zeros_like(sums)
    np.add.at(expect, nearest, x)
    assert (entry[tree.owner] == nearest).all()
    assert (sums == expect).all() and (counts == np.bincount(nearest, minlength=len(book))).all()


def test_whole_subtrees_go_at_once(monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.integers(-5000, 5000, (8, 4))
    x = np.concatenate([c + rng.integers(-20, 20, (100, 4)) for c in centres])
    seen = []
    plain = codebooks.squared
    tree = codebooks.build(x)
    monkeypatch.setattr(codebooks, "squared", lambda a, b: seen.append(len(a)) or plain(a, b))
    codebooks.assign(tree, centres, False)
    assert sum(seen) < len(x) / 10


def brute_codes(rows):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 4) * 4
    x = np.array([[int(np.floor(1024 * c)) for c in v] + [0] * (width - len(v)) for _, v, _ in kept]).reshape(len(kept), 4, -1)
    books = x[:256].copy().transpose(1, 0, 2)
    near = lambda: np.array([[int(((p - b) ** 2).sum(1).argmin()) for p, b in zip(row, books, strict=True)] for row in x])
    for _ in range(4):
        at = near()
        for p in range(4):
            for e in range(len(books[p])):
                if (at[:, p] == e).any():
                    books[p][e] = x[at[:, p] == e, p].sum(0) // int((at[:, p] == e).sum())
    at = near()
    error = [int(sum(((row[p] - books[p][a[p]]) ** 2).sum() for p in range(4))) for row, a in zip(x, at, strict=True)]
    by_label = Counter()
    for (_, _, lab), e in zip(kept, error, strict=True):
        by_label[lab] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return Counter((i, "".join(f"{c:02x}" for c in a), e, by_label[lab], digest) for (i, _, lab), a, e in zip(kept, at, error, strict=True))


def odd_vectors():
    rng = random.Random(4)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(8)], k % 3) for k in range(330)]
    rows += [(k, rows[5][1], 1) for k in (400, 400, 401)]
    rows += [(500, None, 1), (501, [0.1, None] + [0.0] * 6, 1), (502, [float("nan")] * 8, 0), (503, [float("inf")] + [0.0] * 7, 0)]
    return rows + [(504, [0.5] * 8, None), (505, [-0.5] * 8, None), (None, [0.25] * 8, 2), (506, [], 2), (507, [0.3] * 5, 2), (508, [0.0] * 8, 2), (2, rows[7][1], 0)]


@pytest.mark.parametrize("block", [2048, 16])
def test_codes_equal_brute_force_on_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(codebooks, "BLOCK", block)
    rows = odd_vectors()
    df = spark.createDataFrame(rows, VECTORS).withColumn("code", F.lit("other")).withColumn("error", F.lit(1)).repartition(3)
    assert Counter(map(tuple, codebooks.op11(df).collect())) == brute_codes(rows)


def test_codes_of_few_and_of_no_rows(spark):
    few = [(3, [0.1, 0.2, 0.3, 0.4], None), (1, [0.1, 0.2, 0.3, 0.4], 4)]
    assert Counter(map(tuple, codebooks.op11(spark.createDataFrame(few, VECTORS)).collect())) == brute_codes(few)
    for rows in ([], [(1, None, 1)], [(1, [float("nan")], None)]):
        assert codebooks.op11(spark.createDataFrame(rows, VECTORS)).collect() == []


def test_large_components_are_held_where_longs_suffice(spark):
    got = codebooks.op11(spark.createDataFrame([(1, [1e300, -1e300, 0.0, 0.0], 1), (2, [0.0] * 4, 1)], VECTORS)).collect()
    assert sorted((r["vec_id"], r["error"]) for r in got) == [(1, 0), (2, 0)]
    assert int(codebooks.most(64)) == 1 << 27


def test_components_of_any_size_count_exactly(spark):
    """Components far beyond 2^17, among the first rows and after them, in codes, errors and codebooks by Python's integers."""
    rng = random.Random(8)
    rows = [(k, [rng.uniform(-2, 2) * 10.0 ** rng.choice([0, 0, 0, 5, 5.5, 6]) for _ in range(8)], k % 3) for k in range(330)]
    rows[3] = (3, [1e300, -1e300] + [0.0] * 6, 5)
    ints = {k: [int(v // (1 / 1024)) if abs(v) < 1e200 else int(v) * 1024 for v in vec] for k, vec, _ in rows}
    parts = {k: [tuple(v[2 * p : 2 * p + 2]) for p in range(4)] for k, v in ints.items()}
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    books = [[parts[k][p] for k in range(256)] for p in range(4)]
    near = lambda p, part: min(range(256), key=lambda e: (gap(part, books[p][e]), e))
    for _ in range(4):
        for p in range(4):
            groups = defaultdict(list)
            for k in parts:
                groups[near(p, parts[k][p])].append(parts[k][p])
            for e, own in groups.items():
                books[p][e] = tuple(sum(c) // len(own) for c in zip(*own, strict=True))
    codes = {k: [near(p, v[p]) for p in range(4)] for k, v in parts.items()}
    error = {k: sum(gap(parts[k][p], books[p][e]) for p, e in enumerate(c)) for k, c in codes.items()}
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    held = lambda e: e if e < 1 << 63 else None
    expect = {(k, bytes(c).hex(), held(error[k]), held(sum(e for i, e in error.items() if rows[i][2] == rows[k][2])), digest) for k, c in codes.items()}
    assert set(map(tuple, codebooks.op11(spark.createDataFrame(rows, VECTORS)).collect())) == expect


# operator 12


def brute_audit(rows):
    docs = [(lang or "", source or "", [t.lower() if t.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]) for _, text, lang, source, _ in rows]
    in_docs, count, groups = Counter(), Counter(), set()
    for lang, source, terms in docs:
        groups.add((lang, source))
        in_docs.update((lang, t) for t in set(terms))
        count.update((lang, source, t) for t in terms)
    kept = defaultdict(list)
    for (lang, t), n in in_docs.items():
        if n >= 10:
            kept[lang].append(t)
    out = set()
    share = lambda c, n, v: 1 + 10**9 * (c + 2) // (n + 2 * v)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, source in groups:
        terms, mates = kept[lang], sorted(s for g, s in groups if g == lang)
        n = {s: sum(count[lang, s, t] for t in terms) for s in mates}
        p = {s: {t: share(count[lang, s, t], n[s], len(terms)) for t in terms} for s in mates}
        pairs = [(-sum(f(p[source][t], p[s][t]) for t in terms), s.encode(), s) for s in mates if s != source]
        q = {t: share(sum(count[lang, s, t] for s in mates), sum(n.values()), len(terms)) for t in terms}
        best = [(-f(p[source][t], q[t]), t.encode(), t) for t in terms if count[lang, source, t] and p[source][t] > q[t]]
        out |= {(lang, source, "pair", s, -v, k + 1) for k, (v, _, s) in enumerate(sorted(pairs))}
        out |= {(lang, source, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(sorted(best)[:10])}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_audit_equals_brute_force(spark, monkeypatch, small):
    if small:  # several blocks of sources, cells of a language, cuts of a band and steps of a matrix
        for name, value in {"SOURCES": 2, "CELL": 40, "HELD": 60, "MATRIX": 16, "TEXT": 500}.items():
            monkeypatch.setattr(divergence, name, value)
    rows = odd_rows() + corpus(150) + [(900 + k, "Ünique ALPHA alpha beta\x00gamma É é K", None, f"only{k % 2}", None) for k in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("term", F.lit("x")).withColumn("rank", F.lit(0)).withColumn("count", F.lit(1)).repartition(3)
    got = [tuple(r) for r in divergence.op12(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_audit(rows)
    assert sum(r[2] == "term" for r in got) > 20


def test_audit_without_kept_terms_and_without_rows(spark):
    rows = [(1, "one two", "en", "a", 7), (2, None, "en", "b", None), (3, "", None, None, 0)]
    assert {tuple(r) for r in divergence.op12(spark.createDataFrame(rows, SCHEMA)).collect()} == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
    assert divergence.op12(spark.createDataFrame([], SCHEMA)).collect() == []


def test_share_is_exact_beyond_long_products():
    rng = random.Random(1)
    for _ in range(200):
        whole = rng.randrange(1, 9 * 10**15)
        c = rng.randrange(0, whole)
        assert int(divergence.share(np.array([c]), np.array([whole]))[0]) == 1 + 10**9 * (c + 2) // whole


def test_band_keeps_what_fewer_than_k_dominate():
    rng = random.Random(2)
    rows = [(f"t{i:04d}", (c := rng.randint(1, 30)), c + rng.randint(0, 30)) for i in range(1500)]
    t = pa.table({"term": [r[0] for r in rows], "count": [r[1] for r in rows], "lang_count": [r[2] for r in rows]})
    kept = set(divergence.band(t, 4).column("term").to_pylist())
    assert kept == {b[0] for b in rows if sum(a[1] >= b[1] and a[2] <= b[2] and a[0] < b[0] for a in rows) < 4}


# operator 13


def mixed(x):
    """common.mix64 of one integer."""
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % 2**64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def brute_print(text, lexicon):
    terms = sorted({t.lower() if t.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)}, key=str.encode)
    hashed = {t: int(imatch.xxhash.xxh3_64_intdigest(t.encode())) for t in terms}
    inside = [t for t in terms if hashed[t] in lexicon]
    kind, used = ("b", inside) if len(inside) >= imatch.LEAST else ("w", terms)
    if not used:
        return ""
    level = len(used).bit_length() - 1
    parts = []
    for more in range(imatch.LEVELS):
        for j in range(imatch.SUBSETS):
            salt = mixed(j + 1)
            drawn = [t for t in used if float(mixed(hashed[t] ^ salt)) <= 2.0 ** (64 - level - more)]
            parts.append(imatch.xxhash.xxh32_hexdigest(b"".join(hashed[t].to_bytes(8, "little") for t in drawn)) if drawn else imatch.NONE)
    return f"{kind}{level:02x}:{'.'.join(parts)}"


@pytest.mark.parametrize("step", [4 << 20, 300])
def test_fingerprints_equal_brute_force(spark, monkeypatch, step):
    monkeypatch.setattr(imatch, "TEXT", step)
    rows = [r for r in odd_rows() + corpus(90) if r[0] is None or r[0] > 0]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("bucket", F.lit(1)).withColumn("h", F.lit(2)).repartition(3)
    hashed = {(r["doc_id"], r["text"]): r["h"] for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, hashed[r[0], r[1]]))
    texts = [r[1] or "" for r in rows]
    words = Counter(w for t in texts for w in set(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))))
    lexicon = {imatch.xxhash.xxh3_64_intdigest(w.encode()) for w, n in words.items() if n * imatch.RARE >= len(rows) and n * imatch.COMMON <= len(rows)}
    expect = []
    for k, (r, t) in enumerate(zip(rows, texts, strict=True)):
        following = texts[(k + 1) % len(rows)]
        edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        own, new, after = brute_print(t, lexicon), brute_print(edited, lexicon), brute_print(following, lexicon)
        expect.append((r[0], len(t), hashlib.sha256(edited.encode()).hexdigest(), own, new, imatch.likeness(own, new), imatch.likeness(own, after)))
    assert Counter(map(tuple, imatch.op13(docs).collect())) == Counter(expect)
    assert {tuple(r) for r in imatch.imatch(docs).collect()} == {(e[0], e[3]) for e in expect}
    near = [e for e in expect if e[1] > 200]
    assert np.mean([e[5] for e in near]) > 0.35 > 0.1 > np.median([e[6] for e in near])


def test_a_hot_id_is_spread_in_order_and_followed(spark):
    rows = [(5, f"text {k} of the hot id", None, None, None) for k in range(200)] + [(k, f"other {k}", None, None, None) for k in range(10)]
    got = imatch.op13(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(got) == len(rows)
    hashed = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", F.xxhash64("text").alias("h")).orderBy("doc_id", "h").collect()
    texts = [r["text"] for r in hashed]
    edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, texts[1:] + texts[:1], strict=True)]
    assert Counter(r["edited_sha256"] for r in got) == Counter(hashlib.sha256(e.encode()).hexdigest() for e in edited)
    cuts = np.array([3, 5, 5, 5, 5, 9])
    ids, h = np.array([1, 5, 5, 5, 7, 9, 10]), np.array([0, -(1 << 63), 0, (1 << 63) - 1, 0, 0, 0])
    at = imatch.bucket_of(ids, h, cuts)
    assert (np.diff(at) >= 0).all() and len(set(at[1:4])) == 3


def test_lexicon_is_bounded_and_no_rows(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(60), SCHEMA)
    whole = imatch.lexicon(docs)
    monkeypatch.setattr(imatch, "MOST", len(whole) // 2)
    assert 0 < len(imatch.lexicon(docs)) <= len(whole) // 2
    empty = spark.createDataFrame([], SCHEMA)
    assert imatch.op13(empty).collect() == [] and imatch.imatch(empty).collect() == []


def test_likeness():
    a = imatch.fingerprints(pa.array(["a b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o q r s", "z y x w v u", "", None]), np.zeros(0, np.uint64))
    assert imatch.likeness(a[0], a[0]) == 1 and 0.4 < imatch.likeness(a[0], a[1]) < 1
    assert imatch.likeness(a[0], a[2]) == imatch.likeness(a[2], a[3]) == 0 and a[3] == a[4] == "" and imatch.likeness("", "") == 1
