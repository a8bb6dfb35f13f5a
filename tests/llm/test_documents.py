"""Operators on documents against brute force, the library, or held-out accuracy, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assurance.llm import bpe, langid, licences, mixing, neardup, ngram_lm, quality, token_files
from assurance.llm.common import words
from assurance.llm.queries import tokenizer_path

from .helpers import SCHEMA, corpus, odd_rows, prose


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def test_op3_equals_the_library(spark, docs, odd, empty):
    t = library("word_bpe_49k.json")
    extra = ["<|endoftext|> a", "it's 12,5% naïve CAFÉ ﬁ İ Σίσυφος ΟΔΟΣ", "a" * 5000, "x y\x1cz"]
    rows = [*odd_rows(), *((100 + i, x, None, None, None) for i, x in enumerate(extra))]
    for r in bpe.encode_decode(spark.createDataFrame(rows, SCHEMA), tokenizer_path("word_bpe_49k.json")).collect() + bpe.encode_decode(docs, tokenizer_path("word_bpe_49k.json")).collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert r.bpe_ids == ids
        assert r.bpe_decoded == t.decode(ids, skip_special_tokens=False)
    got = bpe.op3(docs, tokenizer_path("word_bpe_49k.json")).filter("doc_id = 5").first()
    ids = t.encode(corpus()[5][1], add_special_tokens=False).ids
    assert got.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and got.n_tokens == len(ids)
    assert bpe.op3(empty, tokenizer_path("word_bpe_49k.json")).count() == 0


def test_op3_clashing_columns_give_way(docs):
    out = bpe.encode_decode(docs.withColumn("bpe_ids", F.lit("old")), tokenizer_path("word_bpe_49k.json"))
    assert out.columns.count("bpe_ids") == 1 and dict(out.dtypes)["bpe_ids"] == "array<int>"


def test_op3_long_words_take_no_longer_than_their_length(spark):
    """A word of many letters merges by a heap, as the library does it."""
    import time

    code, t = bpe.codec(tokenizer_path("word_bpe_49k.json")), library("word_bpe_49k.json")
    rng = random.Random(1)
    for word in ("ab" * 20_000, "a" * 30_001, "".join(rng.choice("etaoinshr") for _ in range(40_000)), "é" * 5000):
        assert np.frombuffer(code.encode(word), np.int32).tolist() == t.encode(word, add_special_tokens=False).ids
    start = time.monotonic()
    code.encode("abcdefghij" * 20_000)
    assert time.monotonic() - start < 10


def test_op3_words_merged_side_by_side_equal_the_library():
    """Words of a batch share the rounds of merges; lengths around SHORT, one letter, bytes of no letter and repeats of a pair among them."""
    code, t = bpe.ForcedBoundaryBPE(tokenizer_path("word_bpe_49k.json")), library("word_bpe_49k.json")
    rng = random.Random(5)
    some = ["".join(rng.choice("etaoinshrdlu\u00e9\u00e8'0.-") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    texts = [" ".join(some[:1500]), None, "", " ".join(some), *("ab" * n for n in (49, 50, 51)), "a", "\u4e2d\u6587 \ud55c", "aaaa aaaaaaa", "x<|endoftext|>y"]
    for text, ids in zip(texts, code.encode_all(texts), strict=True):
        assert np.frombuffer(ids, np.int32).tolist() == t.encode(text or "", add_special_tokens=False).ids


def test_op3_every_cut_is_forced():
    codec = bpe.codec(tokenizer_path("word_bpe_49k.json"))
    whole = {codec.suffix}
    for token in codec.vocab:
        whole.add(token.removesuffix(codec.suffix))
    assert all(pair in codec.inside for t in random.Random(1).sample(sorted(whole), 500) for pair in zip(t, t[1:], strict=False))


def brute_quality(text):
    w = words(text)
    lines = (text or "").split("\n")
    seen, dup = set(), 0
    for x in lines:
        if words(x):
            dup += x in seen
            seen.add(x)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)


def test_op7_base_rules(spark, docs, odd, empty):
    texts = ["a b c d e f\na b c d e f\n\n \na b", "x | y < z > # % & $ *" * 4, "word " * 40, "a b c d e a b c d e f"]
    more = spark.createDataFrame([(200 + i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    model = tokenizer_path("piece_bpe_32k.model")
    for r in quality.score_quality(docs.unionByName(odd).unionByName(more), model).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(r.text)
        assert not (r.base_failed and r.kept)
    assert quality.score_quality(docs, model).filter("base_failed").count() == 0
    assert quality.filter_quality(docs, model).count() == 120
    assert quality.op7(empty, model).count() == 0


def test_op7_repeats_are_sought_as_written(spark):
    """Windows that differ in case are different ones; the contract lower-cases nothing here."""
    texts = ["The cat sat down here the cat sat down here and left", "The cat sat down here The cat sat down here and left", "ONE two three four five one two three four five ONE two three four five"]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_words, r.n_repeat_words, r.base_failed) for r in quality.op7(spark.createDataFrame(rows, SCHEMA), tokenizer_path("piece_bpe_32k.model")).collect()}
    assert got == {0: (12, 0, False), 1: (12, 10, True), 2: (15, 10, True)}


def test_op7_fertility_rejects_symbols(spark):
    rng = random.Random(2)
    text = " ".join(w + rng.choice(["***", "$$$", "&&&", "###"]) for w in prose(rng, 100).split())
    r = quality.score_quality(spark.createDataFrame([(1, text, None, None, None)], SCHEMA), tokenizer_path("piece_bpe_32k.model")).first()
    assert not r.base_failed and not r.kept


@pytest.mark.parametrize(
    ("script", "text", "kept"),
    [
        ("latin", "the house stands near the river and the people walk there every morning to buy bread and fruit", True),
        ("cyrillic", "дом стоит около реки и люди каждое утро идут туда чтобы купить хлеб молоко и свежие фрукты", True),
        ("greek", "το σπίτι είναι κοντά στο ποτάμι και οι άνθρωποι πηγαίνουν εκεί κάθε πρωί για ψωμί και φρούτα", True),
        ("arabic", "البيت قريب من النهر والناس يذهبون إلى هناك كل صباح لشراء الخبز والحليب والفواكه الطازجة من السوق", True),
        ("cjk", "房子 在 河边 人们 每天 早上 都 去 那里 买 面包 牛奶 和 新鲜 的 水果 然后 回家", True),
        ("latin", "q### w*** e$$$ r&&& t### y*** u$$$ i&&& o### p*** a$$$ s&&& d### f***", False),
        ("cyrillic", "ы### щ*** ъ$$$ э&&& ж### ш*** ц$$$ ф&&& ю### й*** х$$$ ч&&& я### ё***", False),
        ("greek", "ϰ### ψ*** ξ$$$ ζ&&& φ### χ*** β$$$ γ&&& δ### θ*** λ$$$ μ&&& ν### π***", False),
        ("arabic", "ڭ### ڢ*** ڥ$$$ ڧ&&& ڨ### ڪ*** ڬ$$$ ڮ&&& ڰ### ڲ*** ڴ$$$ ڵ&&& ڶ### ڷ***", False),
        ("cjk", "龘### 靐*** 齉$$$ 爩&&& 龗### 灪*** 龖$$$ 厵&&& 滟### 爨*** 癵$$$ 驫&&& 麷### 鱻***", False),
        ("other", " ".join(c + "#*$%&|#*$%" for c in "აბგდევზთიკლმნ"), False),
    ],
)
def test_op7_bands_of_each_script(spark, script, text, kept):
    r = quality.score_quality(spark.createDataFrame([(1, text, None, None, None)], SCHEMA), tokenizer_path("piece_bpe_32k.model")).first()
    assert (r.script, r.base_failed, r.kept) == (script, False, kept), r


def test_op7_fertility_equals_brute_force(spark, docs, odd):
    """Letters per token, byte share and entropy from the library's pieces, word by word; ties and clashing columns."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    rows = quality.score_quality(docs.limit(20).unionByName(odd).withColumn("kept", F.lit(7)), tokenizer_path("piece_bpe_32k.model")).collect()
    for r in rows:
        ids = [i for w in words(r.text) for i in model.encode(w.decode())]
        if not ids:
            assert r.chars_per_token is None and not r.kept
            continue
        own = [i for i in ids if model.id_to_piece(i).strip("\u2581") and not model.id_to_piece(i).strip("\u2581").isdigit()]
        count = Counter(ids)
        assert math.isclose(r.chars_per_token, sum(c.isalpha() for c in r.text) / max(1, len(own)))
        assert math.isclose(r.byte_share, sum(model.is_byte(i) for i in ids) / len(ids))
        assert math.isclose(r.token_entropy, -sum(n / len(ids) * math.log2(n / len(ids)) for n in count.values()), abs_tol=1e-9)
    tie = quality.score_quality(spark.createDataFrame([(1, "аб ab", None, None, None)], SCHEMA), tokenizer_path("piece_bpe_32k.model")).first()
    assert tie.script == "latin"


def test_op1_held_out_accuracy(spark, odd, empty):
    docs = spark.createDataFrame(corpus(400, 11), SCHEMA)
    out = {r.doc_id: r for r in langid.op1(docs).collect()}
    truth = {r[0]: r[2] for r in corpus(400, 11)}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    held = [i for i, r in out.items() if r.held_out]
    assert len(held) > 50 and sum(out[i].lang_pred == truth[i] for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in out.values())
    found = langid.train(docs)
    rows = {r.doc_id: r for r in found.predict(odd).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3, 7)] == ["und"] * 4 and rows[1].rejected
    assert rows[5].lang_pred == "en" and not rows[5].rejected
    assert langid.op1(empty).count() == 0
    assert {r.lang_pred for r in langid.train(empty).predict(docs).collect()} == {"und"}


def test_op1_probabilities_sum_to_one(docs):
    texts = [r.text for r in docs.filter("lang = 'en'").limit(20).collect()]
    s, _ = langid.symbols(texts)
    k, n = np.unique(langid.keys(s, langid.ORDER)[s[langid.ORDER - 1 :] != langid.START], return_counts=True)
    language = langid.Language(k, n)
    seen = np.append(language.orders[1][0], np.uint64(ord("\u0416")))  # and one symbol for all that were not seen
    unseen = np.uint64(ord("\u0416")) << np.uint64(16)
    for context in [*(k[::50] >> np.uint64(16)), unseen]:
        assert abs(language.prob(langid.ORDER, (context << np.uint64(16)) | seen).sum() - 1) < 1e-9
    model = langid.Model(["en"], [(k, n)])
    assert np.allclose(model.log_prob(k)[:, 0], np.log(language.prob(langid.ORDER, k)), atol=1e-4)


def brute_kneser_ney(texts):
    """A function that gives the cross-entropy of a text by dictionaries alone."""

    def spelt(text):
        out = []
        for c in " " + (text or "").lower() + " ":
            x = min(ord(c), 0xFFFF) if c.isalpha() else 32
            if x != 32 or not out or out[-1] != 32:
                out.append(x)
        return [1, 1, 1, *out]

    counts = {4: Counter()}
    for t in texts:
        x = spelt(t)
        counts[4].update(tuple(x[i - 3 : i + 1]) for i in range(3, len(x)))
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    total, kinds, discount = {}, {}, {}
    for n in counts:
        total[n], kinds[n] = Counter(), Counter()
        for g, c in counts[n].items():
            total[n][g[:-1]] += c
            kinds[n][g[:-1]] += 1
        once, twice = (sum(c == x for c in counts[n].values()) for x in (1, 2))
        discount[n] = min(0.9, max(0.1, once / max(1, once + 2 * twice)))

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / (len(counts[1]) + 1)
        if not total[n][g[:-1]]:
            return p(g[1:])
        mass = total[n][g[:-1]]
        return max(counts[n][g] - discount[n], 0) / mass + discount[n] * kinds[n][g[:-1]] / mass * p(g[1:])

    def entropy(text):
        x = spelt(text)
        return -sum(math.log(p(tuple(x[i - 3 : i + 1]))) for i in range(3, len(x))) / (len(x) - 3)

    return entropy


def test_op1_cross_entropies_and_predictions_equal_brute_force(spark, docs):
    rows = docs.collect()
    names = ["de", "en", "fr"]
    parts, brute = [], []
    for lang in names:
        texts = [r.text for r in rows if r.lang == lang][:15]
        s, _ = langid.symbols(texts)
        parts.append(np.unique(langid.keys(s, langid.ORDER)[s[langid.ORDER - 1 :] != langid.START], return_counts=True))
        brute.append(brute_kneser_ney(texts))
    model = langid.Model(names, parts)
    asked = [r.text for r in rows[60:100]] + ["Straße", "x", "Ж щ", "the the the 12 !!", "a\x01b", "\U00020000 \U00020001"]
    got, _ = model.cross_entropy(asked)
    want = np.array([[f(t.replace("\x01", " ")) for f in brute] for t in asked])
    assert np.allclose(got, want, atol=2e-4)
    frame = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(asked[:40])], SCHEMA)
    said = {r.doc_id: r.lang_pred for r in langid.Identifier(spark, model).predict(frame).collect()}
    assert said == {k: names[int(w.argmin())] for k, w in enumerate(want[:40])}


def test_op2_exact_base_and_order(spark, odd, empty):
    docs = spark.createDataFrame(corpus(150, 5), SCHEMA).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 1000))
    rows = docs.collect()
    held = {r.doc_id: r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows}
    count = Counter(w for r in rows if not held[r.doc_id] for w in [*words(r.text), None])
    n, v = sum(count.values()), len(count)
    for common in (300_000, 10):
        old, ngram_lm.COMMON_WORDS = ngram_lm.COMMON_WORDS, common
        got = {r.doc_id: r for r in ngram_lm.op2(docs).collect()}
        ngram_lm.COMMON_WORDS = old
        assert len(got) == len({r.doc_id for r in rows})
        for r in rows:
            t, g = [*words(r.text), None], got[r.doc_id]
            assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[r.doc_id], len(t), sum(count[w] > 0 for w in t), n)
            assert math.isclose(g.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
            assert g.score < 0 and math.isfinite(g.score)
    out = ngram_lm.score_texts(docs.filter("doc_id < 5"), empty).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in out)
    assert ngram_lm.op2(empty).count() == 0


def brute_scores(texts, training):
    """The model's log10 probability of each text from exact counts, levels and their means."""
    one, two = Counter(), Counter()
    for t in training:
        w = [*words(t), None]
        one.update(w)
        two.update(zip([None, *w], w, strict=False))

    def means(count):
        held = {}
        for c in count.values():
            held.setdefault(c.bit_length(), []).append(c)
        return {level: sum(x) / len(x) for level, x in held.items()}

    m1, m2 = means(one), means(two)
    n, v = sum(one.values()), len(one)
    weight = 1 - sum(c == 1 for c in two.values()) / sum(two.values())
    out = []
    for t in texts:
        w, total = [*words(t), None], 0.0
        for a, b in zip([None, *w], w, strict=False):
            c1, ctx = (m1[one[x].bit_length()] if one[x] else 0 for x in (b, a))
            c2 = m2[two[a, b].bit_length()] if two[a, b] else 0
            k = weight if ctx else 0.0
            total += math.log10((k * min(c2, ctx) / ctx if ctx else 0) + (1 - k) * (c1 + ngram_lm.ALPHA) / (n + ngram_lm.ALPHA * (v + 1)))
        out.append(total)
    return out


@pytest.mark.parametrize("sent", [ngram_lm.SENT_BYTES, 0])
def test_op2_score_equals_brute_force(spark, odd, monkeypatch, sent):
    """Sent to every worker, and asked by a join; with bits to spare, so that no false positive moves a score."""
    monkeypatch.setattr(ngram_lm, "BITS_PER_ENTRY", 96)
    monkeypatch.setattr(ngram_lm, "SENT_BYTES", sent)
    monkeypatch.setattr(ngram_lm, "GROUP_BYTES", 20_000)
    monkeypatch.setattr(ngram_lm, "FLUSH_TOKENS", 3000)
    monkeypatch.setattr(ngram_lm, "BLOCK_TOKENS", 5000)
    docs = spark.createDataFrame(corpus(300, 8), SCHEMA)
    rows = docs.unionByName(odd)
    got = ngram_lm.score_texts(rows, docs).collect()
    texts = [r.text for r in rows.collect()]
    want = brute_scores(texts, [r.text for r in docs.collect()])
    assert len(got) == len(want)
    assert np.allclose(sorted(r.score for r in got), sorted(want), rtol=1e-4)
    ids = {r.doc_id: r.score for r in got if r.doc_id is not None}
    assert all(math.isclose(ids[r.doc_id], x, rel_tol=1e-4) for r, x in zip(rows.collect(), want, strict=True) if r.doc_id is not None and r.doc_id > 8)


def test_op2_filter_holds_every_ngram(docs):
    """No word or pair is left out or under-counted, pairs seen once included, and few are over-counted."""
    groups = ngram_lm.count_ngrams(docs, 3).toPandas()
    whole = ngram_lm.Filter(3, groups["grp"].to_numpy(), groups["filter"].tolist())
    one, two = Counter(), Counter()
    for r in docs.collect():
        h = ngram_lm.hashes(r.text).tolist()
        one.update(h)
        two.update(zip([ngram_lm.END, *h], h, strict=False))
    h, c = (np.array(x, np.uint64) for x in zip(*one.items(), strict=True))
    pairs, c2 = (np.array(x, np.uint64) for x in zip(*two.items(), strict=True))
    keys = np.concatenate([ngram_lm.word_keys(h, 3), ngram_lm.pair_keys(pairs[:, 0], pairs[:, 1], 3)])
    want = ngram_lm.level_of(np.concatenate([c, c2]).astype(np.int64))
    level = whole.levels(keys)
    assert (level >= want).all() and (level == want).mean() > 0.98
    assert sum(len(x) // 8 for x in groups["words"]) == len(one)


def test_op2_clashing_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "a b a", 5), (1, "a b a", 6), (None, "c", 7)], "doc_id long, text string, score long")
    got = ngram_lm.op2(rows)
    assert got.columns.count("score") == 1
    found = got.collect()
    assert len(found) == 3 and len({(r.n_tokens, r.score) for r in found if r.doc_id == 1}) == 1


def test_op4_weights_and_budget(spark, docs, odd, empty):
    rows = mixing.op4(docs).toPandas()
    assert len(rows) == 120
    rows["used"] = rows.n_tokens * rows.mix_copies
    g = rows.groupby("source").agg(tokens=("n_tokens", "sum"), weight=("weight", "first"), used=("used", "sum"), most=("n_tokens", "max"))
    total = g.tokens.sum()
    a = rows.exponent.iloc[0]
    p = g.tokens / total
    assert np.allclose(g.weight, p**a / (p**a).sum()) and (g.weight * total / g.tokens).max() <= 1.3 + 1e-6
    assert (g.used <= g.weight * total + 1).all() and (g.used >= g.weight * total - g.most - 1).all()
    again = mixing.op4(docs.repartition(7)).toPandas().sort_values("doc_id").mix_copies.tolist()
    assert again == rows.sort_values("doc_id").mix_copies.tolist()
    kept = mixing.mixed(docs)
    assert kept.columns == docs.columns and kept.select("doc_id").distinct().count() == 120
    assert mixing.mix(odd).count() == 10 and mixing.mix(empty).count() == 0 and mixing.op4(empty).count() == 0
    assert mixing.mix(docs, 100.0, None, 0.5).agg(F.sum(F.col("n_tokens") * F.col("mix_copies"))).first()[0] <= 100


def test_op4_copies_equal_a_walk_through_the_blocks(spark):
    """Each source: whole epochs, then documents in the order of the next epoch's block permutation while the tokens last."""
    docs = spark.createDataFrame(corpus(300, 14), SCHEMA)
    rows = mixing.mix(docs.withColumn("weight", F.lit("old")), None, 3.0)
    order = [mixing.visit(mixing.digits(1)[0], F.floor(F.col("due") / F.col("total")).cast("long"), 1), *mixing.digits(1)[1:]]
    total = rows.agg(F.sum("n_tokens")).first()[0]
    sizes = rows.groupBy("source").agg(F.sum("n_tokens").alias("total"))
    p = {r.source: r.total / total for r in sizes.collect()}
    a = rows.first().exponent
    z = sum(x**a for x in p.values())
    budget = total * z * max(x ** (1 - a) for x in p.values())
    rows = rows.join(sizes, "source").withColumn("due", F.round(F.col("weight") * budget).cast("long"))
    got = rows.select("doc_id", "source", "n_tokens", "mix_copies", "due", "total", *(c.alias(f"o{i}") for i, c in enumerate(order))).collect()
    for source in p:
        own = sorted((r for r in got if r.source == source), key=lambda r: tuple(r[f"o{i}"] for i in range(len(order))))
        epochs, rest = divmod(own[0].due, own[0].total)
        for r in own:
            rest -= r.n_tokens
            assert r.mix_copies == epochs + (rest >= 0), (source, r)
            if rest < 0:
                rest = -(10**9)


def test_op4_exponent_meets_the_entropy(docs):
    s = mixing.park(docs.withColumn("n_tokens", mixing.word_count()).groupBy("source").agg(F.sum("n_tokens").alias("tokens")))
    total = s.agg(F.sum("tokens")).first()[0]
    s = s.withColumn("p", F.col("tokens") / total)
    a, _ = mixing.exponent(s, float(total), None, 1.2)
    p = np.array([r.p for r in s.collect()])
    w = p**a / (p**a).sum()
    assert 0 < a < 1 and abs(-(w * np.log(w)).sum() - 1.2) < 1e-3


def brute_components(rows, k, percent):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, frozenset(tuple(w[j : j + k]) for j in range(len(w) - min(k, len(w)) + 1)) if w else frozenset()))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize(("k", "percent", "node"), [(3, 85, 800), (5, 80, 800), (3, 85, 4)])
def test_op5_equals_brute_force(spark, odd, k, percent, node):
    """Also with tiny nodes, so that the walk goes deep and clusters are checked leaf by leaf."""
    rng = random.Random(5)
    rows = [(r[0], r[1]) for r in corpus(100, 9)]
    seed = prose(rng, 150).split()
    for i in range(60):
        w = list(seed)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(50)}"
        rows.append((200 + i, " ".join(w)))
    rows += [(r[0] + 1000, r[1]) for r in odd_rows() if r[0] and r[0] != 6] + [(2000, "one"), (2001, "ONE"), (2002, "one two")]
    want = brute_components(rows, k, percent)
    old, neardup.NODE = neardup.NODE, node
    try:
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    finally:
        neardup.NODE = old
    assert len(got) == len(rows)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    if node > 100:
        assert found == want
    else:  # nodes this small lose some links at the very threshold; nothing may be merged that is apart
        assert sum(found[i] == x for i, x in want.items()) >= 0.97 * len(want)
        assert all(want[i][1] == want[c][1] for i, (_, c) in found.items())
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_op5_blocks_of_a_large_node_all_meet(spark, monkeypatch):
    monkeypatch.setattr(neardup, "NODE", 8)
    rows = spark.range(60).select(F.lit(1).cast("long").alias("node"), F.col("id").alias("h"), F.lit(b"x").alias("sig"), F.lit(60).cast("long").alias("size"))
    met = {frozenset((a, b)) for r in neardup.block_pairs(rows).groupBy("node").agg(F.collect_list("h").alias("h")).collect() for a in r.h for b in r.h if a != b}
    assert len(met) == 60 * 59 // 2


@pytest.mark.parametrize("depth", [9, 24])
def test_op5_trees_hold_the_recall_at_any_depth(depth):
    """Pairs at the threshold, walked down by all trees: RECALL of them share a node, within three deviations."""
    rng, pairs, t = np.random.default_rng(3), 400, 0.85
    left = rng.integers(0, 1 << 16, (pairs, neardup.POSITIONS)).astype(np.uint16)
    right = np.where(rng.random(left.shape) < t, left, rng.integers(0, 1 << 16, left.shape).astype(np.uint16))
    sigs, met = np.concatenate([left, right]), np.zeros(pairs, bool)
    trees = neardup.trees_for(depth, t)
    for tree in range(trees):
        node, who = np.repeat(neardup.mix64(np.array([tree + 1])), 2 * pairs), np.arange(2 * pairs)
        for _ in range(depth // neardup.LEVELS):
            node, up = neardup.walk(node, sigs[who], 1 / t - 1)
            who = who[up]
        a, b = {(n, w) for n, w in zip(node, who) if w < pairs}, {(n, w - pairs) for n, w in zip(node, who) if w >= pairs}
        met[[w for _, w in a & b]] = True
    assert met.mean() >= neardup.RECALL - 3 * (neardup.RECALL * (1 - neardup.RECALL) / pairs) ** 0.5
    assert trees > neardup.TREES if depth > 9 else trees == neardup.TREES


def test_op5_heavy_groups_meet_in_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "WEIGHT", 100)
    rows = [(g, h, 9 + h % 3) for g in (1, 2) for h in range(40)] + [(3, h, 10) for h in range(9)]
    got = neardup.bounded(spark.createDataFrame(rows, "g long, h long, n_shingles long")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.g, []).append((r.h, r.n_shingles))
    assert all(sum(n for _, n in x) <= 100 + 2 * 11 for x in groups.values()) and {h for h, _ in groups[3]} == set(range(9))
    met = [frozenset((a, b)) for g, x in groups.items() if g != 3 for a, _ in x for b, _ in x if a < b]
    assert len(set(met)) == 40 * 39 // 2


def test_op5_texts_under_one_id_are_compared_apart(spark):
    """A repeated id with different texts, copies of which some have no id, and texts without any."""
    rng = random.Random(8)
    a, b, c, d = (prose(rng, 80) for _ in range(4))
    near_a = " ".join(a.split()[:-1])
    rows = [(1, a), (1, b), (5, near_a), (7, b + " more"), (None, a), (None, c), (None, c), (9, d)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in neardup.near_duplicates(docs).collect())
    assert got == [(0, 0), (0, 0), (0, 1), (1, 1), (1, 1), (5, 1), (7, 1), (9, 9)]
    assert sorted((r.doc_id or 0, r.text) for r in neardup.dedup(docs).collect()) == sorted([(0, c), (1, a), (1, b), (9, d)])


def test_op5_odd_rows(odd, empty):
    assert neardup.near_duplicates(odd).count() == 10
    kept = neardup.dedup(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 5, 7, 8, None}
    assert neardup.near_duplicates(empty).count() == 0


def wrapped(text, width, start):
    import textwrap

    return "\n".join(start + x for x in textwrap.wrap(text, width))


def test_op6_finds_notices(spark, odd, empty):
    mit, bsd, apache = licences.TEMPLATES["MIT"][3], licences.TEMPLATES["BSD-3-Clause"][1], licences.TEMPLATES["Apache-2.0"][1]
    code = "\n\ndef f(x):\n    return x + 1  # of the first of the last\n" * 30
    rows = [
        (1, "Some prose.\nReleased under the MIT License.\nMore.", "MIT"),
        (2, mit.replace("hereby ", ""), "MIT"),
        (3, "# Copyright (c) 2020 A. Writer\n" + wrapped(mit, 72, "# ") + code, "MIT"),
        (4, "/*\n" + wrapped(bsd, 80, " * ") + "\n */" + code, "BSD-3-Clause"),
        (5, code + wrapped(apache, 60, "// ") + code, "Apache-2.0"),
        (6, "The licence of a poet is not the MIT building.", None),
        (7, "x" * 100_000 + "\nLicensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        (8, "This long line of prose says that this work is licensed under the GNU General Public License, version 3, and goes on.", "GPL-3.0"),
        (9, "SPDX-License-Identifier: Zlib", None),
        (10, wrapped(licences.TEMPLATES["BSD-2-Clause"][0], 70, ""), "BSD-2-Clause"),
    ]
    table = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumn("licence", F.lit("old"))
    got = {r.doc_id: r for r in licences.scan(table).collect()}
    assert {i: r.licence for i, r in got.items()} == {r[0]: r[2] for r in rows}
    assert all((r.licence_dice is None) == (r.licence is None) and r.licences == ([r.licence] if r.licence else []) for r in got.values())
    assert (got[1].licence_start, got[1].licence_words, got[1].licence_dice) == (3, 5, 1_000_000) and got[8].licence_start == 8
    both = licences.scan(spark.createDataFrame([(1, "Released under the MIT License. " + "word " * 40 + "Licensed under CC BY-SA 4.0.")], "doc_id long, text string")).first()
    assert both.licences == ["CC-BY-SA-4.0", "MIT"] and both.licence == "CC-BY-SA-4.0"  # a tie goes to the name that sorts first
    found = licences.op6(odd).collect()
    assert len(found) == 10 and all(r.licence is None and r.licences == "" for r in found) and licences.op6(empty).count() == 0
    plan = licences.op6(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def brute_passage(bigrams_of_text, template):
    """The largest Dice coefficient of any stretch, from all stretches."""
    own = set(template)
    best = 0
    for i in range(len(bigrams_of_text)):
        seen = set()
        for x in bigrams_of_text[i:]:
            seen.add(x)
            best = max(best, 2_000_000 * len(seen & own) // (len(seen) + len(own)))
    return best


def test_op6_threshold_equals_all_stretches(spark):
    """A template is found exactly if some stretch of the text, of all there are, reaches the threshold."""
    rng = random.Random(4)
    (_, template), = licences.known({"X": ["one two three four five six seven eight nine ten eleven twelve"]})
    base = "one two three four five six seven eight nine ten eleven twelve".split()
    texts = []
    for _ in range(150):
        w = [x for x in base if rng.random() > 0.12]
        for _ in range(rng.randint(0, 4)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(["zz", "yy", "xx"]))
        texts.append(" ".join(["aa"] * rng.randint(0, 5) + w + ["bb"] * rng.randint(0, 5)))
    got = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), {"X": [" ".join(base)]}).collect()
    want = {i: brute_passage([f"{a} {b}" for a, b in zip(t.split(), t.split()[1:], strict=False)], template) >= 800_000 for i, t in enumerate(texts)}
    assert {r.doc_id: r.licence is not None for r in got} == want and 20 < sum(want.values()) < 130


def test_op10_round_trip(spark, docs, odd, empty):
    t = library("byte_bpe_50k.json")
    rows = docs.unionByName(odd.filter("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 500))
    manifest = token_files.write_files(rows, tokenizer_path("byte_bpe_50k.json"), 2, seq_len=64, rows=8)
    got = token_files.read_files(manifest).orderBy("start").collect()
    start = 0
    for r, (i, text) in zip(got, sorted(((r.doc_id, r.text) for r in rows.collect()), key=lambda x: (x[0], x[1] is not None, x[1] or "")), strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    from pyarrow import fs

    first = manifest.orderBy("part").first()
    store, _ = fs.FileSystem.from_uri(first.folder)
    ids, mask = token_files.sequence(store, first.path, 0)
    assert len(ids) == len(mask) == 64 and mask.all()
    assert token_files.read_files(token_files.write_files(empty, tokenizer_path("byte_bpe_50k.json"), 2)).count() == 0


def test_op10_encodes_a_word_once_and_keeps_the_words_in_use(monkeypatch):
    code = token_files.ByteLevelEncoder(tokenizer_path("byte_bpe_50k.json"))
    t, given = library("byte_bpe_50k.json"), []

    class Counted:
        def encode(self, text, **more):
            given.append(text)
            return t.encode(text, **more)

        def encode_batch_fast(self, texts, **more):
            given.extend(texts)
            return t.encode_batch_fast(texts, **more)

    code.library = Counted()
    monkeypatch.setattr(token_files, "CACHE", 20)
    odd = [None, "", " ", "a\n\nb  c", "l’\xe9t\xe9, \xab mot \xbb", "x\xa0 y　 z  q\x1c w\x85 e", "it's !'s (a,b) 3,5% don't", "\xd7, \xf7. Ж! 日本。 ok", "a<|endoftext|>, b", "n" * 90 + ", end"]
    words = [f"word{chr(97 + i)}lo" for i in range(26)]
    texts = [*odd, *(" ".join(words[i:] + words[:i]) + "." for i in range(26))]
    for again in (False, True):
        given.clear()
        ids, lengths = code.encode(pa.array(texts, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]
        assert sum(x.count("word") for x in given) == (0 if again else 52)  # with and without a space; none anew when the table is full
    assert len(code.known.lengths) > 20
    code.encode(pa.array(["other words"]))
    assert len(code.known.lengths) == 2


def test_op10_lots_are_bounded_and_whole():
    texts = [None, "", "a" * 30, "b" * 5, "c" * 6, None, "d" * 4, "e" * 25, ""]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(9)), "text": pa.array(texts, pa.string())})
    parts = [part.column(1).to_pylist() for part in token_files.lots(batch, 10)]
    assert sum(parts, []) == texts and all(parts)
    assert all(sum(len(x or "") for x in part[1:]) < 10 for part in parts)
    assert list(token_files.lots(batch.slice(0, 0))) == []
