"""Page text against a naive suffix array, vectors against all pairs, and the pipeline."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from assurance.llm import html_text, vectors

from .helpers import SCHEMA, corpus, odd_rows, prose

PAGE = "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>Home</li></ul></nav><div class='ad'>Buy</div><article><h1>Title &amp; more</h1><p>First  line<br>goes\non.<p>Second&nbsp;one</p><script>var x='</p>'</script></article><div id=comments>hi</div><footer>&copy; x</footer></body></html>"


def test_article_without_the_rest():
    texts, zones = html_text.blocks(PAGE)
    assert html_text.main_text(texts, zones, "", set()) == "Title & more\nFirst line goes on.\nSecond one"
    for cut in range(len(PAGE)):
        html_text.blocks(PAGE[:cut])


def test_marked_paragraphs_are_boilerplate_up_to_the_next_block():
    page = "<article><p>One.<p class='ad'>Buy <b>now<p>Two</b> more.</p><p class=notice>Note</p><p hidden>x</p>Three<p id='sponsor'>y<h2>Four</h2></article><p>after"
    texts, zones = html_text.blocks(page)
    assert html_text.main_text(texts, zones, "", set()) == "One.\nTwo more.\nThree\nFour"


def naive_cover(streams: list[tuple[int, list[str]]], least: int) -> dict[tuple[int, int], bool]:
    """Covered places by a full suffix array over all streams: neighbours' common prefixes, for distinct pages."""
    suffixes = sorted((tuple(s[i:]), n, i) for n, (_, s) in enumerate(streams) for i in range(len(s)))
    covered: dict[tuple[int, int], bool] = {}
    for a in range(len(suffixes)):
        for step in (-1, 1):
            b, common = a + step, len(suffixes[a][0])
            while 0 <= b < len(suffixes):
                x, y = suffixes[b - step][0], suffixes[b][0]
                lcp = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
                common = min(common, lcp)
                if common < least:
                    break
                if streams[suffixes[b][1]][0] != streams[suffixes[a][1]][0]:
                    for i in range(common):
                        covered[suffixes[a][1], suffixes[a][2] + i] = True
                    break
                b += step
    return covered


def test_marks_are_whole_names():
    page = """<article class="post wide"><div class="related-work"><p>Work that is related.</p></div><section id="share-prices"><p>Prices fell.</p></section>
    <h2 id="comments-on-method">Comments on method</h2><h2 class="notice-title" id="notice">A notice of birds</h2><p>End.</p>
    <div class="cookieBanner">Cookies!</div><div id="site-footer-2">Foot</div><div class="related-posts">More</div><label>Name</label><article class="comment">Nice read.</article></article>
    <article class="comment">I agree.</article><article class="teaser">Next story</article>"""
    texts, zones = html_text.blocks(page)
    assert [t for t, z in zip(texts, zones, strict=True) if z == 2] == ["Work that is related.", "Prices fell.", "Comments on method", "A notice of birds", "End."]


def test_suffix_keys_cover_what_a_suffix_array_covers(spark):
    rng = random.Random(4)
    menu = prose(rng, 14)
    pages, streams = [], []
    for i in range(12):
        own = prose(rng, 30)
        body = f"<body><div>{menu if i % 3 else menu[: len(menu) // 2]}</div><p>{own}</p><div>{menu if i % 2 else ''} {prose(rng, 3)}</div></body>"
        pages.append((i, "http://h.example/x", body))
        texts, zones = html_text.blocks(body)
        streams.append((i, html_text.stream(texts, zones, inside=False)))
    want = naive_cover(streams, html_text.WINDOW)
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    for n, (i, s) in enumerate(streams):
        assert got[i].split() == [t for j, t in enumerate(s) if not want.get((n, j))]
    assert menu not in got[1]


def test_neighbours_of_the_suffix_array_give_the_runs(spark):
    """Suffixes in sorted order, compared with the one before: counts of pages by brute force, over batches of two rows and hosts with the same text."""
    rng = random.Random(12)
    words_ = ["w0", "w1"]  # few words, so that long prefixes are shared
    rows, want = [], {}
    for i in range(40):
        tokens = [rng.choice(words_) for _ in range(rng.randrange(0, 25))]
        host = f"h{i % 2}.example"
        rows.append((i, i if i else None, f"http://{host}/x", [" ".join(tokens)], [html_text.NEUTRAL]))
        for k in {tuple(tokens[j : j + html_text.WINDOW]) for j in range(len(tokens) - html_text.WINDOW + 1)}:
            want.setdefault((host, k), []).append(i if i else None)
    df = spark.createDataFrame(rows, "row long, page_id long, url string, texts array<string>, zones array<int>").repartition(3)
    one = lambda host, k: int(html_text.suffix_keys(host, list(k)).view("int64")[0])
    expected = {one(h, k): (len(p), min((x for x in p if x is not None), default=None), max((x for x in p if x is not None), default=None)) for (h, k), p in want.items()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        got = html_text.neighbour_runs(html_text.sorted_suffixes(df)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(expected) and {r.key: (r.n, r.low, r.high) for r in got} == expected
    assert max(r.n for r in got) > 2


def full_runs(streams: list[tuple[int, list[str]]], least: int, many: int, share: float) -> set[tuple[int, int]]:
    """Places of a host's streams under a substring of any length from least that many distinct pages and a share of them hold, by whole suffixes and their whole common prefixes."""
    suffixes = sorted((tuple(s[i:]), n, i) for n, (_, s) in enumerate(streams) for i in range(len(s)))
    common = [0] + [next((k for k, (x, y) in enumerate(zip(a[0], b[0], strict=False)) if x != y), min(len(a[0]), len(b[0]))) for a, b in zip(suffixes, suffixes[1:], strict=False)]
    need, covered = max(many, share * len({p for p, _ in streams})), set()
    for length in sorted({c for c in common if c >= least}):
        at = 0
        for end in range(1, len(suffixes) + 1):
            if end == len(suffixes) or common[end] < length:
                if len({streams[n][0] for _, n, _ in suffixes[at:end]}) >= need:
                    covered |= {(n, i + k) for _, n, i in suffixes[at:end] for k in range(length)}
                at = end
    return covered


def test_whole_suffixes_and_distinct_pages_give_the_same_text(spark, monkeypatch):
    """Whole suffixes of every length find no place that those to the depth of WINDOW leave out; rows with one page_id are one page, in lots and batches of any size."""
    rng = random.Random(21)
    menus = [prose(rng, n) for n in (9, 16, 40)]
    rows, streams, hosts = [], {}, ("h.example", "g.example")
    for i in range(36):
        page, host = i // 3 if i < 18 else i, hosts[i % 2 if i >= 18 else 0]  # ids of the first rows stand three times
        said = rng.sample(menus, rng.randrange(0, 3)) + ([menus[2][: len(menus[2]) // 2]] if i % 5 == 0 else [])
        said += ["alone {0} rows of two {0} pages say {0} so".format(page // 2)] * (i < 18)  # six rows, fewer than MANY pages
        body = "".join(f"<div>{t}</div>" for t in (*said, prose(rng, 45)))  # more than LEAST_LEFT of its text is its own
        rows.append((page, f"http://{host}/{i}", f"<body>{body}</body>"))
        texts, zones = html_text.blocks(rows[-1][2])
        streams.setdefault(host, []).append((page, html_text.stream(texts, zones, inside=False), i))
    want = {}
    for found in streams.values():
        covered = full_runs([(p, s) for p, s, _ in found], html_text.WINDOW, html_text.MANY, html_text.SHARE)
        want |= {i: [t for j, t in enumerate(s) if (n, j) not in covered] for n, (_, s, i) in enumerate(found)}
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size, together in ((10_000, 300_000), (2, 30)):
        monkeypatch.setattr(html_text, "TOGETHER", together)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = {int(r.url.rsplit("/", 1)[1]): r.text.split() for r in html_text.extract(table).collect()}
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        assert got == want
    assert all("say" in got[i] for i in range(18)) and any(len(got[i]) < len(s) for found in streams.values() for _, s, i in found)


def test_copies_and_quotes_keep_their_text(spark):
    """Without an article: a menu on many pages goes; copies, near copies and a quote on two pages stay."""
    rng = random.Random(9)
    menu, quote, body = prose(rng, 12), prose(rng, 15), prose(rng, 80)
    own = [prose(rng, 40) for _ in range(20)]
    near = [body.replace(" ", f" changed{i} ", 1) for i in range(4)]
    texts = [*own[:18], *(f"{o} {quote}" for o in own[18:]), body, body, *near]
    rows = [(i, "http://h.example/x", f"<body><div>{menu}</div><p>{t}</p></body>") for i, t in enumerate(texts)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(t in got[i] for i, t in enumerate(texts))
    assert all(got[i] == t for i, t in enumerate(texts[:20]))


def test_repeats_decide_inside_articles(spark):
    """What footers of the host say goes from articles too; a headline that menus repeat and a quote among articles stay."""
    rng = random.Random(3)
    notice, quote, headline = prose(rng, 12), prose(rng, 15), prose(rng, 10)
    own = [prose(rng, 40) for _ in range(12)]
    rows = []
    for i, t in enumerate(own):
        head = f"<h1>{headline if i == 0 else prose(rng, 9)}</h1>"
        inner = f"{head}<p>{t}</p>" + (f"<p>{notice}</p>" if i % 3 else "") + (f"<p>{quote}</p>" if i > 7 else "")
        rows.append((i, "http://h.example/x", f"<body><div>{headline}</div><article>{inner}</article><div>{notice}</div></body>"))
    rows.append((12, rows[0][1], rows[0][2]))
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", html_text.F.lit("old"))
    got = {r.page_id: r.text for r in html_text.op8(table).collect()}
    assert all(t in got[i] and notice not in got[i] and (quote in got[i]) == (i > 7) for i, t in enumerate(own))
    assert headline in got[0] and got[12] == got[0]


def test_pages_odd_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p"), (4, "u", "plain"), (4, "u", "plain"), (None, None, PAGE), (5, "http://a/x", "<article>" + "word " * 50_000)]
    out = html_text.op8(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == 7
    text = {r.page_id: r.text for r in out}
    assert text[1] == text[2] == text[3] == "" and text[4] == "plain" and text[None].startswith("Title")
    assert all(r.n_chars == len(r.text) for r in out)
    assert html_text.op8(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_hadamard_keeps_length():
    x = np.random.default_rng(1).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(vectors.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(vectors.hadamard(vectors.hadamard(x)), x)


def test_op9_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows, at = [], 0
    for g in range(30):
        centre = rng.normal(size=48)
        for _ in range(1 + g % 7):
            v = centre + rng.normal(size=48) * 0.2
            rows.append((at, v.tolist(), g % 3))
            at += 1
    rows += [(at + i, rows[3][1], rows[3][2]) for i in range(40)]
    at += 40
    rows += [(at, None, 1), (at + 1, [0.0] * 48, 1), (at + 2, [math.nan] + [1.0] * 47, 1), (at + 3, [None] + [1.0] * 47, 1), (at + 4, rows[0][1], None), (at + 5, [], 1), (at + 6, [1.0, 2.0], 1), (at + 7, [2.0, 4.0], 1)]
    want_links, edges = dict.fromkeys((r[0] for r in rows), 0), []
    good = [(i, np.array(v), x) for i, v, x in rows if x is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    for n, (i, a, x) in enumerate(good):
        for j, b, y in good[:n]:
            if x == y and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                want_links[i] += 1
                want_links[j] += 1
                edges.append((j, i))
    part = {r[0]: r[0] for r in rows}
    for _ in rows:
        for a, b in edges:
            part[a] = part[b] = min(part[a], part[b])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for block in (1000, 8):
        old, vectors.BLOCK = vectors.BLOCK, block
        got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
        vectors.BLOCK = old
        found = sum(r.n_links for r in got.values())
        assert found >= 0.97 * sum(want_links.values()) and all(got[i].n_links <= n for i, n in want_links.items())
        assert [got[i].n_links for i in range(at, at + 6)] == [0] * 6 and got[at + 6].n_links == 1
        assert sum(got[i].component_id == p for i, p in part.items()) >= 0.97 * len(part)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_op9_vectors_under_one_id_or_none(spark):
    """Vectors of an id that comes twice, and of none, stay apart from each other and link by what they are."""
    rng = np.random.default_rng(6)
    a, b, c = (rng.normal(size=32) for _ in range(3))
    rows = [(1, a), (1, b), (2, a * 1.001 + b * 0.01), (None, c), (None, c), (None, a), (4, b + a * 0.01), (9, c * -1)]
    for kind in ("float", "double"):
        df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in rows], f"vec_id long, embedding array<{kind}>, label int")
        got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in vectors.near_vectors(df).collect())
        assert [x for x in got if x[0] in (2, 4, 9)] == [(2, 2, 1), (4, 1, 1), (9, 0, 9)]
        assert [x for x in got if x[0] == 0 and x[2] == 0] == [(0, 1, 0), (0, 1, 0)] and len(got) == len(rows)


@pytest.mark.parametrize("width", [64, 768])
def test_op9_recall_at_the_threshold(spark, width):
    """Planted pairs of cosine 0.93 to 0.95, among vectors of their own: nine tenths at least are found, and nothing else."""
    rng = np.random.default_rng(width)
    n = 400
    a, noise = rng.normal(size=(n, width)), rng.normal(size=(n, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise -= (noise * a).sum(1, keepdims=True) * a
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    c = rng.uniform(0.9301, 0.95, (n, 1))
    both = np.concatenate([a, c * a + np.sqrt(1 - c * c) * noise])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(both)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    found = sum(got[i].n_links == 1 and got[i + n].component_id == i for i in range(n))
    assert found >= 0.9 * n and all(r.n_links <= 1 and r.component_id in (r.vec_id, r.vec_id - n) for r in got.values())


def test_op9_clashing_columns_and_null_ids(spark):
    rows = [(None, [1.0, 0.0], 1, 7), (5, [1.0, 0.0], 1, 8), (5, [1.0, 0.0], 1, 9), (6, [0.0, 1.0], 1, 9)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links long")).collect()
    assert len(got) == 4 and sorted((r.vec_id or 0, r.n_links, r.component_id) for r in got) == [(0, 2, 5), (5, 2, 5), (5, 2, 5), (6, 0, 6)]


@pytest.mark.parametrize("kind", ["empty", "unlabelled", "odd"])
def test_pipeline_takes_any_corpus(spark, tmp_path, kind):
    import corpus_pipeline

    rows = corpus(60, 4)
    table = {"empty": [], "unlabelled": [(*r[:2], None, *r[3:]) for r in rows], "odd": odd_rows() + [(None, r[1], None, None, None) for r in rows[:9]] + rows + rows[:5]}[kind]
    spark.createDataFrame(table, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert [f[0] for f in docs.dtypes] == [f[0] for f in spark.createDataFrame([], SCHEMA).dtypes]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {r[0] for r in rows}
    assert (len(got) == 0) == (kind == "empty")
    assert kind == "empty" or len({r.doc_id for r in got} & texts) > 40


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rows = [r for r in corpus(150, 21)]
    junk = [(900, "short", "en", "hot", 5), (901, "same line here now\n" * 30, "en", "hot", 500), (902, None, "en", "s1", 0)]
    spark.createDataFrame(rows + junk, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "MinHash near-dedup", "mixing sources", "BPE encoding"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        if k == 0:
            assert {r.doc_id for r in out.collect()} == {r[0] for r in rows}
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert 90 < got.doc_id.nunique() < 150 and got.doc_id.max() < 900


def test_pipeline_decodes_what_it_encodes(spark):
    import hashlib

    from tokenizers import Tokenizer

    import corpus_pipeline
    from assurance.llm.queries import tokenizer_path

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    docs = spark.createDataFrame([*corpus(3, 2), (90, None, None, None, None)], SCHEMA)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in corpus_pipeline.bpe_tokens(spark, docs, "").collect():
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.bpe_ids == ids and r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_no_module_of_the_library_imports_this_subpackage():
    import re
    from pathlib import Path

    root = Path(__file__).parents[2] / "assurance"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and re.search(r"assurance\.llm|from \.+llm|import llm", p.read_text())]
