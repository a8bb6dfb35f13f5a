"""Retrieval: inverted index, BM25, citations, catalogue and the scope of systems."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assurance.functions import text as T

# Fixed values of the ranking and of scope.
K1, B, TOP_K = 1.5, 0.75, 6
DISTINCTIVE, DECLARED_WEIGHT = 0.55, 3.0


#: Rows of a small side up to which it is sent to every task; they are counted first.
FEW = 200_000


def few(df: DataFrame) -> DataFrame:
    """df, to be sent to every task if its rows, counted now, are at most FEW."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def chunks_by_line(docs: DataFrame) -> DataFrame:
    """(system_id, doc_id, chunk_id, ord, text): one chunk for each line that is not blank."""
    lines = docs.select("system_id", "doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text")).filter(F.trim("text") != "")
    return lines.withColumn("chunk_id", F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.lpad(F.col("ord").cast("string"), 3, "0")))


def index(chunks: DataFrame, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """postings (system_id, term, chunk_id, tf, n_tokens), document frequencies, and sizes of each system.

    With only (term), postings of other terms are left out before anything is shuffled;
    frequencies and sizes stay those of the whole corpus.
    """
    tokens = chunks.select("system_id", "chunk_id", T.bm25_tokens(F.col("text")).alias("tokens")).withColumn("n_tokens", F.size("tokens"))
    terms = tokens.select("system_id", "chunk_id", "n_tokens", F.explode("tokens").alias("term"))
    if only is not None:
        terms = terms.join(few(only.distinct()), "term", "left_semi")
    postings = terms.groupBy("system_id", "term", "chunk_id").agg(F.count("*").alias("tf"), F.max("n_tokens").alias("n_tokens"))
    df = postings.groupBy("system_id", "term").agg(F.count("*").alias("df"))
    stats = tokens.groupBy("system_id").agg(F.count("*").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"))
    return postings, df, stats


#: Slots that kept postings are dealt into by term; sizes of chunks, and ids that several chunks of a system have, stand in slots of their own.
SLOTS, SIZES, SHARED = 16, -1, -2


def entries(chunks: DataFrame, sign: int = 1, amended: bool = False) -> DataFrame:
    """(system_id, chunk_id, term, tf, n_tokens, sign, amended, slot) of chunks with one reading: a posting for each term, and a row without a term for the chunk itself.

    A chunk stands in one row, so its terms are counted there, as runs of its sorted tokens: nothing is shuffled.
    """
    tokens = chunks.select("system_id", "chunk_id", F.array_sort(F.array_append(T.bm25_tokens(F.col("text")), F.lit(""))).alias("tokens"))
    first = lambda i: (i == 0) | (F.get("tokens", i) != F.get("tokens", i - 1))
    runs = tokens.select("*", F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), first).alias("starts"))
    run = lambda at, i: F.struct(F.get("tokens", at).alias("term"), (F.coalesce(F.get("starts", i + 1), F.size("tokens")) - at).cast("long").alias("tf"))
    rows = runs.select("system_id", "chunk_id", (F.size("tokens") - 1).alias("n_tokens"), F.inline(F.transform("starts", run)))
    return rows.withColumns({"sign": F.lit(sign), "amended": F.lit(amended), "slot": F.when(F.col("term") == "", SIZES).otherwise(slot_of("term"))})


def slot_of(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SLOTS)).cast("int")


def write_index(chunks: DataFrame, path: str) -> None:
    """Keep the index of chunks (system_id, chunk_id, text) under path.

    Chunks of a system may have one id (lines from the thousandth on, documents given twice); such ids are written down,
    so that reading puts their postings together and leaves all others as they are.
    """
    rows = entries(chunks)
    rows.write.partitionBy("slot").parquet(path)
    sizes = chunks.sparkSession.read.schema(rows.schema).parquet(path).filter(F.col("slot") == SIZES)
    shared = sizes.groupBy("system_id", "chunk_id").agg(F.count("*").alias("n")).filter("n > 1")
    shared.select("system_id", "chunk_id", F.lit(False).alias("amended"), F.lit(SHARED).alias("slot")).write.mode("append").partitionBy("slot").parquet(path)


def amend_index(gone: DataFrame, come: DataFrame, path: str) -> None:
    """Take chunks out of a kept index and put others in (R4, R5): rows with a sign are added, nothing that stands is written again."""
    entries(gone, -1, True).unionByName(entries(come, amended=True)).write.mode("append").partitionBy("slot").parquet(path)


def read_index(spark: SparkSession, path: str, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What index() gives, from a kept index; with only (term), from the slots of its terms.

    Chunks with one id are one in a posting, with the sum of tf and the greatest n_tokens, and each for itself in sizes.
    Rows of an amended index are netted, then put together, in one shuffle.
    """
    raw = spark.read.schema("system_id string, chunk_id string, n_tokens int, term string, tf long, sign int, amended boolean, slot int").parquet(path)
    posting = ["system_id", "term", "chunk_id"]
    as_written = raw.filter("amended").isEmpty()  # decided by the files' own statistics

    def net(rows: DataFrame) -> DataFrame:
        """Rows with n, how many of them are left."""
        key = [*posting, "tf", "n_tokens"]
        return rows.select(*key, F.lit(1).alias("n")) if as_written else rows.groupBy(*key).agg(F.sum("sign").alias("n")).filter("n > 0")

    def whole(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*posting).agg(F.sum(F.col("tf") * F.col("n")).alias("tf"), F.max("n_tokens").alias("n_tokens"))

    postings = raw.filter(F.col("slot") >= 0)
    if only is not None:
        postings = postings.join(few(only.distinct().withColumn("slot", slot_of("term"))), ["slot", "term"], "left_semi")
    shared = raw.filter(F.col("slot") == SHARED).select(F.col("system_id").alias("s"), F.col("chunk_id").alias("c"))
    if not as_written:
        postings = whole(net(postings.repartition(*posting)))
    elif shared.isEmpty():
        postings = net(postings).drop("n")
    else:
        shared, same = few(shared), F.col("system_id").eqNullSafe(F.col("s")) & F.col("chunk_id").eqNullSafe(F.col("c"))
        alone, together = (net(postings.join(shared, same, how)) for how in ("left_anti", "left_semi"))
        postings = alone.drop("n").unionByName(whole(together))
    df = postings.groupBy("system_id", "term").agg(F.count("*").alias("df"))
    stats = net(raw.filter(F.col("slot") == SIZES)).groupBy("system_id").agg(F.sum("n").alias("n_chunks"), F.sum(F.col("n_tokens") * F.col("n")).alias("n_tokens"))
    return postings, df, stats


#: Chunks of a system that are scored at once, and questions that they meet at once.
CHUNKS_AT_ONCE, QUESTIONS_AT_ONCE = 16_384, 20_000
BEST = pa.schema([("item_id", pa.int64()), ("system_id", pa.string()), ("chunk_id", pa.string()), ("score", pa.float64())])


def best_of(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best chunks for each question (item_id, terms), from the weighted postings (system_id, chunk_id, term, w) of some chunks of one system; ties go to the chunk id, one that is null last."""

    def run(postings: pa.Table, questions: pa.Table) -> pa.Table:
        if not postings.num_rows or not questions.num_rows:
            return BEST.empty_table()
        chunk, term = (postings.column(c).combine_chunks().dictionary_encode("encode") for c in ("chunk_id", "term"))
        ids = np.array(chunk.dictionary.to_pylist(), object)
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or "")), np.int64)
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))  # so that equal scores stand in the order of chunk ids
        of = term.indices.to_numpy()
        by_term = np.argsort(of, kind="stable")
        at, w = place[chunk.indices.to_numpy()][by_term], postings.column("w").to_numpy()[by_term]
        ends = np.cumsum(np.bincount(of)).tolist()
        span = {t: slice(i, j) for t, i, j in zip(term.dictionary.to_pylist(), [0, *ends], ends, strict=False)}
        items, places, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for item, terms in zip(questions.column("item_id").to_pylist(), questions.column("terms").to_pylist(), strict=True):
            mine = [span[t] for t in terms if t in span]
            if not mine:
                continue
            score = np.round(np.bincount(np.concatenate([at[x] for x in mine]), np.concatenate([w[x] for x in mine])), 6)
            top = np.flatnonzero(score > 0)
            if len(top) > k:
                top = top[score[top] >= -np.partition(-score[top], k - 1)[k - 1]]
                top = top[np.argsort(-score[top], kind="stable")][:k]
            items.append(np.full(len(top), item))
            places.append(top)
            scores.append(score[top])
        found = ids[order][np.concatenate(places)]
        return pa.table([pa.array(np.concatenate(items)), pa.array([postings.column("system_id")[0].as_py()] * len(found), pa.string()), pa.array(found, pa.string()), pa.array(np.concatenate(scores))], schema=BEST)

    return run


def bm25(questions: DataFrame, chunks: DataFrame | None, k: int = TOP_K, kept: str | None = None) -> DataFrame:
    """(item_id, system_id, chunk_id, score, rank): the best k chunks of each system for each question (R2), of chunks or of an index kept under a path.

    Every question meets every chunk that shares a term with it, so the sums grow with the
    product of both. Only terms of some question are counted, and every system answers in its
    own corpus. The weighted postings of CHUNKS_AT_ONCE chunks of a system form a group, which meets
    QUESTIONS_AT_ONCE questions: a task sums arrays and keeps k chunks, so no pair of a question and
    a chunk is shuffled but the k best of each group. Ties go to the chunk id.
    """
    asked = questions.select(F.col("item_id").cast("long").alias("item_id"), F.array_distinct(T.bm25_tokens(F.col("text"))).alias("terms"))
    q = asked.select(F.explode("terms").alias("term"))
    postings, df, stats = read_index(questions.sparkSession, kept, q) if kept else index(chunks, q)
    n, average = F.col("n_chunks"), F.col("total") / F.col("n_chunks")
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_tokens") / average))
    groups = F.ceil(n / CHUNKS_AT_ONCE)
    parts = max(1, -(-questions.count() // QUESTIONS_AT_ONCE))
    weighted = postings.join(few(df), ["system_id", "term"]).join(few(stats.withColumnRenamed("n_tokens", "total")), "system_id")
    weighted = weighted.select("system_id", "chunk_id", "term", (idf * tf).alias("w"), F.pmod(F.xxhash64("chunk_id"), groups).alias("group"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    every = stats.select(F.col("system_id").alias("system_id"), F.explode(F.sequence(F.lit(0).cast("long"), groups - 1)).alias("group"))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int")).crossJoin(every)
    keys = ["system_id", "group", "part"]
    scores = weighted.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(best_of(k), "item_id long, system_id string, chunk_id string, score double")
    w = Window.partitionBy("item_id", "system_id").orderBy(F.desc("score"), F.asc_nulls_last("chunk_id"))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("item_id", "system_id", "chunk_id", "score", "rank")


def catalogue(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents, chunks and characters of each system."""
    d = docs.groupBy("system_id").agg(F.count("*").alias("n_docs"), F.sum(F.char_length("text")).alias("n_chars"))
    c = chunks.groupBy("system_id").agg(F.count("*").alias("n_chunks"))
    return d.join(c, "system_id", "left").select("system_id", "n_docs", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "n_chars")


def upsert(docs: DataFrame, updates: DataFrame, key: str, version: str) -> DataFrame:
    """Documents after updates of the same key took their place (R4): the newest version of each key, in one shuffle."""
    both = docs.unionByName(updates)
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))
    return both.withColumn("place", newest).filter("place = 1").drop("place")


def scope_lexicon(docs: DataFrame, declared: DataFrame | None = None, questions: DataFrame | None = None) -> DataFrame:
    """(system_id, term, weight) of terms that belong to one system (Q10); with questions (text), of their terms only.

    Documents count once for each term, declared words three times; a term stays with a
    system that holds at least 0.55 of its mass in all systems. The shares are fleet-wide,
    so a change in one corpus recounts them.
    """
    terms = docs.select("system_id", F.explode(T.subject_terms(F.col("text"))).alias("term"))
    if questions is not None:
        terms = terms.join(few(questions.select(F.explode(T.subject_terms(F.col("text"))).alias("term")).distinct()), "term", "left_semi")
    mass = terms.groupBy("system_id", "term").agg(F.count("*").cast("double").alias("mass"))
    if declared is not None:
        mass = mass.unionByName(declared.select("system_id", "term", F.lit(DECLARED_WEIGHT).alias("mass"))).groupBy("system_id", "term").agg(F.sum("mass").alias("mass"))
    total = mass.groupBy("term").agg(F.sum("mass").alias("total"))
    m = mass.join(total, "term").withColumn("share", F.col("mass") / F.col("total")).filter(F.col("share") >= DISTINCTIVE)
    return m.select("system_id", "term", F.bround(F.log1p("mass") * F.col("share"), 5).alias("weight"))


def scope_scores(questions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(item_id, system_id, score, place): weights of a question's distinct terms over the root of its length (Q11)."""
    q = questions.withColumn("terms", T.subject_terms(F.col("text"))).withColumn("n", F.size("terms"))
    hits = q.select("item_id", "n", F.explode(F.array_distinct("terms")).alias("term")).join(lexicon, "term")
    s = hits.groupBy("item_id", "system_id").agg(F.bround(F.sum("weight") / F.sqrt(F.max("n")), 6).alias("score"))
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "system_id")
    return s.withColumn("place", F.row_number().over(w))


def scope_verdict(scores: DataFrame, asked: DataFrame, coverage: DataFrame) -> DataFrame:
    """Where a question asked of a system belongs (Q13).

    asked: (item_id, system_id, n_terms); coverage: (item_id, system_id, cover). Foreign if the
    best other system scores clearly higher and its documents cover the question clearly
    better: both signals must name the same one. A question of fewer than two subject terms
    stays in scope.
    """
    mine = scores.select("item_id", "system_id", F.col("score").alias("mine"))
    ranked = scores.join(asked.select("item_id", F.col("system_id").alias("own")), "item_id").filter("system_id <> own")
    best = ranked.groupBy("item_id", F.col("own").alias("system_id")).agg(F.min_by(F.struct("score", F.col("system_id").alias("other")), "place").alias("o")).select("item_id", "system_id", "o.*")
    theirs = coverage.select("item_id", F.col("system_id").alias("other"), F.col("cover").alias("other_cover"))
    best = best.join(theirs, ["item_id", "other"], "left")
    j = asked.join(mine, ["item_id", "system_id"], "left").join(best, ["item_id", "system_id"], "left").join(coverage, ["item_id", "system_id"], "left")
    m, o, c, t = (F.coalesce(x, F.lit(0.0)) for x in ("mine", "score", "cover", "other_cover"))
    enough = F.col("n_terms") >= 2
    foreign = F.coalesce(enough & (o >= 0.42) & (o >= 2.6 * F.greatest(m, F.lit(0.02))) & (t >= F.greatest(1.35 * c, F.lit(0.5))), F.lit(False))
    verdict = F.when(foreign, "foreign").when(~enough | (c >= 2.0) | (m >= 0.14), "in_scope").otherwise("uncovered")
    return j.select("item_id", "system_id", m.alias("mine"), c.alias("cover"), t.alias("other_cover"), verdict.alias("verdict"), F.when(foreign, F.col("other")).alias("redirect_to"))
