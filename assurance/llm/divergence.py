"""Operator 12: which terms and which other sources set a source apart from its language.

Counts of terms are made in the tasks that read the texts and summed by (lang, term), so that
one shuffle serves the sums of a group and of its language. A share is an integer,
p = 1 + floor(10^9 * (count + 2) / (N + 2 * V)).

The foremost terms of a group come from a dominance skyband: the divergence of a term grows
with its count in the group and falls with its count in the language, so a term that TOP
others dominate (count no lower, language count no higher, earlier in UTF-8) has no place
among the first TOP. Each partition retains the terms dominated by fewer than TOP others,
these bands are merged and cut again, and what is left is ranked exactly.

Pairs of sources are summed over all terms in cells: a cell has some terms of a language,
the sources of two blocks, and a matrix of counts in which absent terms count too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assurance.llm.common import near, park, runs, slices

SCALE, LEAST_DOCS, TOP = 1_000_000_000, 10, 10
#: What separates terms, after A-Z are lower-cased.
APART = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows held before counts are summed or a band is cut; rows of a cell; sources of a block; numbers of a matrix.
HELD, CELL, SOURCES, MATRIX = 1_000_000, 20_000, 256, 1 << 20
#: Bytes of text that one step counts.
TEXT = 8 << 20


def counted(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, count, docs) of a batch (lang, source, text)."""
    lang, source = (batch.column(c).fill_null("").dictionary_encode() for c in (0, 1))
    names = np.stack([lang.indices.to_numpy(), source.indices.to_numpy()], 1)
    groups, group = np.unique(names, axis=0, return_inverse=True)
    found = pc.split_pattern_regex(pc.ascii_lower(batch.column(2).fill_null("")), APART)
    flat, row = found.flatten(), pc.list_parent_indices(found).to_numpy()
    use = pc.not_equal(flat, "")
    flat, row = flat.filter(use).dictionary_encode(), row[use.to_numpy(zero_copy_only=False)].astype(np.int64)
    n = max(1, len(flat.dictionary))
    pair, times = np.unique(row * n + flat.indices.to_numpy(), return_counts=True)
    at = group.reshape(-1)[pair // n] * n + pair % n
    order = np.argsort(at, kind="stable")
    at, times = at[order], times[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    g, term = at[first] // n, at[first] % n
    count = np.add.reduceat(times, first) if len(first) else np.zeros(0, np.int64)
    docs = np.diff(np.r_[first, len(at)]) if len(first) else np.zeros(0, np.int64)
    columns = [lang.dictionary.take(pa.array(groups[g, 0])), source.dictionary.take(pa.array(groups[g, 1])), flat.dictionary.take(pa.array(term)), pa.array(count), pa.array(docs)]
    return pa.table(columns, ["lang", "source", "term", "count", "docs"])


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs), summed within a task; a term may still stand in many tasks."""

    def summed(held: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("count", "sum"), ("docs", "sum")])
        return t.select(["lang", "source", "term", "count_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "count", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for big in batches:
            for batch in slices(big, 2, TEXT):
                held.append(counted(batch))
                if sum(map(len, held)) > HELD:
                    held = [summed(held)]
                    if len(held[0]) > HELD // 2:
                        yield from held[0].to_batches()
                        held = []
        if held:
            yield from summed(held).to_batches(max_chunksize=100_000)

    return docs.select(*(F.col(c).cast("string") for c in ("lang", "source", "text"))).mapInArrow(run, "lang string, source string, term string, count long, docs long")


def share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / whole), for a whole of 1 at least; by long division three digits at a time, so that longs hold it."""
    rest, whole = count + 2, np.maximum(whole, 1)
    out = rest // whole
    for _ in range(3):
        rest = rest % whole * 1000
        out = out * 1000 + rest // whole
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def share_of(count: str, total: str) -> str:
    """share() as SQL."""
    return f"1 + (({count} + 2BD) * {SCALE}BD) div ({total} + 2BD * n_terms)"


def band(t: pa.Table, k: int) -> pa.Table:
    """The rows of one group (term, count, lang_count) that fewer than k others dominate."""
    t = t.take(pc.sort_indices(t, [("count", "descending"), ("lang_count", "ascending"), ("term", "ascending")]))
    lang = t.column("lang_count").to_numpy()
    rank = np.empty(len(t), np.int64)  # places of terms in UTF-8
    rank[pc.sort_indices(t.column("term")).to_numpy()] = np.arange(len(t))
    kept = np.zeros(0, np.int64)
    for at in range(0, len(t), 512):  # whatever dominates a row stands before it
        new = np.arange(at, min(at + 512, len(t)))
        before = np.concatenate([kept, new])
        over = (lang[before][:, None] <= lang[new]) & (rank[before][:, None] <= rank[new]) & (before[:, None] < new)
        kept = np.concatenate([kept, new[over.sum(0) < k]])
    return t.take(pa.array(kept))


def banded(rows: DataFrame, k: int) -> DataFrame:
    """rows (lang, source, term, count, lang_count) cut to the skyband of each group within each partition."""

    def cut(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        both = [t.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source")]
        codes = np.stack([(c.chunk(0) if isinstance(c, pa.ChunkedArray) else c).indices.to_numpy() for c in both], 1)
        _, group = np.unique(codes, axis=0, return_inverse=True)
        order = np.argsort(group.reshape(-1), kind="stable")
        ends = np.cumsum(np.bincount(group.reshape(-1)))
        return pa.concat_tables(band(t.take(pa.array(x)), k) for x in np.split(order, ends[:-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = most = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n > max(HELD // 4, 2 * most):  # each cut halves at least, or the next one waits for twice as many
                held = cut(pa.Table.from_batches(held)).to_batches()
                n = most = sum(b.num_rows for b in held)
        if n:
            yield from cut(pa.Table.from_batches(held)).to_batches(max_chunksize=100_000)

    return rows.select("lang", "source", "term", "count", "lang_count").mapInArrow(run, "lang string, source string, term string, count long, lang_count long")


def paired(cells: DataFrame) -> DataFrame:
    """(lang, source, item, value): sums of a cell's terms for pairs of its sources; a cell's rows without term name the sources, and count its terms."""

    def of_cell(t: pa.Table) -> pa.RecordBatch | None:
        head = t.filter(pc.is_null(t.column("term"))).combine_chunks()
        names, whole, side = head.column("source").to_pylist(), head.column("whole").to_numpy(), head.column("side").to_numpy()
        rows = t.filter(pc.is_valid(t.column("term")))
        if len(names) < 2:
            return None
        at = {s: i for i, s in enumerate(names)}
        source = np.fromiter((at[s] for s in rows.column("source").to_pylist()), np.int64, len(rows))
        term = rows.column("term").combine_chunks().dictionary_encode()
        term = (term.chunk(0) if isinstance(term, pa.ChunkedArray) else term).indices.to_numpy()
        count = rows.column("count").to_numpy()
        step, n = max(1, MATRIX // len(names)), int(term.max(initial=-1)) + 1
        order = np.argsort(term, kind="stable")
        source, term, count = source[order], term[order], count[order]
        total = np.zeros((len(names), len(names)), np.int64)
        for low in range(0, n, step):
            a, b = np.searchsorted(term, (low, low + step))
            matrix = np.zeros((len(names), min(step, n - low)), np.int64)
            matrix[source[a:b], term[a:b] - low] = count[a:b]
            p = share(matrix, whole[:, None])
            for i in range(len(names)):
                total[i, i + 1 :] += divergence(p[i], p[i + 1 :]).sum(1)
        none = share(np.zeros(len(names), np.int64), whole)  # of the language's terms that no source of this cell holds
        total += np.triu(divergence(none[:, None], none), 1) * (head.column("count")[0].as_py() - n)
        total += total.T
        i, j = np.nonzero((side[:, None] != side[None, :]) if side.max() > 0 else ~np.eye(len(names), dtype=bool))
        name = pa.array(names, pa.string())
        return pa.RecordBatch.from_arrays([pa.repeat(head.column("lang")[0], len(i)), name.take(pa.array(i)), name.take(pa.array(j)), pa.array(total[i, j])], ["lang", "source", "item", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "cell"):
            key = t.column("cell").to_numpy()
            for cell in np.unique(key):
                one = t.filter(pa.array(key == cell))
                for lang in pc.unique(one.column("lang")):  # hashes of two cells may be equal
                    found = of_cell(one.filter(pc.equal(one.column("lang"), lang)))
                    if found is not None:
                        yield found

    dealt = cells.select("cell", "lang", "source", "term", "count", "whole", "side").repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "lang string, source string, item string, value long")


def audit(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(terms, groups) of docs, both written once: counts of kept terms by group, and totals of every group."""
    by_term = Window.partitionBy("lang", "term")
    summed = counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    summed = summed.withColumn("in_docs", F.sum("docs").over(by_term)).filter(F.col("in_docs") >= LEAST_DOCS)
    terms = park(summed.withColumn("lang_count", F.sum("count").over(by_term)).withColumn("first", F.row_number().over(by_term.orderBy("source")) == 1).drop("docs", "in_docs"))
    every = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    langs = terms.groupBy("lang").agg(F.sum("count").alias("lang_total"), F.count_if("first").alias("n_terms"))
    totals = terms.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = every.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = park(groups.select("lang", "source", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "lang_total", "n_terms"))))
    return terms, groups


def foremost(terms: DataFrame, groups: DataFrame, k: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the first k terms of each group by divergence from its language."""
    merged = terms
    for salts in (64, 8, 1):  # bands are merged by fewer and fewer tasks for each group
        merged = banded(merged, k)
        merged = merged.repartition("lang", "source", F.pmod(F.xxhash64("term"), F.lit(salts)))
    rows = banded(merged, k).withColumn("group", F.struct("lang", "source"))
    named = groups.select(F.struct("lang", "source").alias("group"), "total", "lang_total", "n_terms")
    rows = near(rows, named, "group", groups.count(), "inner")
    rows = rows.select("lang", "source", F.col("term").alias("item"), F.expr(share_of("count", "total")).alias("p"), F.expr(share_of("lang_count", "lang_total")).alias("q")).filter("p > q")
    rows = rows.withColumn("value", F.expr("(p - q) * (p - q) div (p + q)")).drop("p", "q")
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def apart(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): every other source of the language by divergence summed over all its kept terms."""
    sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") / F.lit(SOURCES)).cast("long").alias("blocks"))
    cells = terms.groupBy("lang").agg(F.ceil(F.count("*") / F.lit(CELL)).cast("long").alias("cells"))
    sizes = park(sizes.join(cells, "lang", "left").select("lang", "blocks", F.coalesce("cells", F.lit(1).cast("long")).alias("cells")))
    few = sizes.count()
    block, zero = F.pmod(F.xxhash64("source"), F.col("blocks")), F.lit(0).cast("long")
    # a source goes to the cells of its block with every block, and its name to all of them
    pair = lambda o: F.struct(F.least("block", o).alias("low"), F.greatest("block", o).alias("high"), F.when(o == F.col("block"), 0).when(F.col("block") < o, 1).otherwise(2).alias("side"))
    pairs = F.explode(F.transform(F.sequence(zero, F.col("blocks") - 1), pair))
    names = near(groups, sizes, "lang", few, "inner").withColumn("block", block).withColumn("o", pairs).withColumn("at", F.explode(F.sequence(zero, F.col("cells") - 1)))
    rows = near(terms, sizes, "lang", few, "inner").withColumn("block", block).withColumn("at", F.pmod(F.xxhash64("term"), F.col("cells")))
    held = rows.filter("first").groupBy("lang", "at").agg(F.count("*").alias("here"))
    names = names.join(held, ["lang", "at"], "left")
    names = names.select("at", "o", "lang", "source", F.lit(None).cast("string").alias("term"), F.coalesce("here", zero).alias("count"), (F.col("total") + 2 * F.col("n_terms")).alias("whole"))
    rows = rows.withColumn("o", pairs)
    rows = rows.select("at", "o", "lang", "source", "term", "count", F.lit(None).cast("long").alias("whole"))
    rows = rows.unionAll(names).select(F.xxhash64("lang", "at", "o.low", "o.high").alias("cell"), "lang", "source", "term", "count", "whole", F.col("o.side").alias("side"))
    values = paired(rows).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return values.withColumn("rank", F.row_number().over(best))


def op12(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group of docs (text, lang, source).

    Null text, lang and source count as empty. Every (lang, source) that occurs is a group,
    whether or not it holds a term. Part "pair" has every other source of the language, 0
    where the language keeps no term; a language with one source has no such rows. Part
    "term" has at most TOP terms, of those with a share above the language's. Ties go by the
    UTF-8 order of the item. Repeated rows count each; a very long text is counted whole.
    Other columns are ignored; an empty table gives an empty result. Exact for up to 9 * 10^15
    terms of a group.
    """
    terms, groups = audit(docs)
    parts = [apart(terms, groups).withColumn("part", F.lit("pair")), foremost(terms, groups).withColumn("part", F.lit("term"))]
    out = parts[0].unionByName(parts[1])
    return out.select("lang", "source", "part", "item", F.col("value").cast("long"), F.col("rank").cast("int"))


def op12_sql() -> str:
    """The same in DuckDB: all shares of all groups side by side."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    f = "((p - q) * (p - q) // (p + q))"
    return rf"""WITH d AS MATERIALIZED (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
      kept AS MATERIALIZED (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY ALL HAVING count(*) >= {LEAST_DOCS}),
      counted AS MATERIALIZED (SELECT w.lang, w.source, w.term, count(*) AS c FROM (SELECT lang, source, unnest(terms) AS term FROM d) AS w JOIN kept USING (lang, term) GROUP BY ALL),
      grp AS (SELECT DISTINCT lang, source FROM d),
      sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
      totals AS (SELECT lang, source, sum(c) AS n FROM counted GROUP BY ALL),
      wide AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
          1 + (coalesce(c.c, 0) + 2)::HUGEINT * {SCALE} // (coalesce(t.n, 0) + 2 * s.v) AS p
        FROM grp AS g JOIN kept AS k ON g.lang = k.lang JOIN sizes AS s ON s.lang = g.lang
        LEFT JOIN totals AS t ON t.lang = g.lang AND t.source = g.source
        LEFT JOIN counted AS c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
      pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM grp AS a JOIN grp AS b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN (SELECT lang, source, item, sum({f}) AS value FROM (SELECT a.lang, a.source, b.source AS item, a.p, b.p AS q
          FROM wide AS a JOIN wide AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source) GROUP BY ALL) AS x
        ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
      whole AS (SELECT c.lang, c.term, 1 + (sum(c.c) + 2)::HUGEINT * {SCALE} // (any_value(n.n) + 2 * any_value(s.v)) AS q FROM counted AS c
        JOIN (SELECT lang, sum(c) AS n FROM counted GROUP BY lang) AS n ON n.lang = c.lang JOIN sizes AS s ON s.lang = c.lang GROUP BY c.lang, c.term),
      terms AS (SELECT lang, source, term AS item, {f} AS value FROM wide JOIN whole USING (lang, term) WHERE c > 0 AND p > q),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
        FROM (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms))
      SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}"""
