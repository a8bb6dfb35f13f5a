"""Operator 4: mixing sources to target weights.

A source with token share p gets weight p**a / sum(p**a). The exponent a lies between 0
(uniform) and 1 (as found); it is bisected to the least value that keeps the entropy of
the weights and the most repeated source within their limits. A source's tokens are then
its budget times its weight: whole epochs, and a part of one more that walks through the
source's blocks in that epoch's own permutation until the tokens are spent.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assurance.llm.common import park

#: Blocks of a source; the boundary block is divided by so many bits of a document's hash, again and again.
BLOCKS, DIGITS, DIGIT_BITS = 4096, 4, 8
#: Exponents tried at once, and rounds: each narrows the interval by STEPS.
STEPS, ROUNDS = 32, 5


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\t-\r ]+")), F.lit(0)).cast("long")


def exponent(sources: DataFrame, budget: float | None, most_repeats: float | None, target_entropy: float | None) -> tuple[float, float]:
    """The exponent and the token budget, from sources (share p > 0, tokens). One row for each exponent tried reaches the driver.

    budget None: the least budget at which every source is used once, for each exponent.
    """
    low, high = 0.0, 1.0
    total = float(sources.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        return 1.0, 0.0

    def tried(values: list[float]) -> list[dict]:
        rows = sources.withColumn("a", F.explode(F.array(*map(F.lit, values))))
        power = F.pow("p", F.col("a"))
        sums = rows.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("s"), F.max(F.pow("p", F.col("a") - 1)).alias("most"), F.max(F.pow("p", 1 - F.col("a"))).alias("cover"))
        return sorted((r.asDict() for r in sums.collect()), key=lambda r: r["a"])

    def tokens(r: dict) -> float:
        return total * r["z"] * r["cover"] if budget is None else budget

    def fits(r: dict) -> bool:
        entropy = math.log(r["z"]) - r["a"] * r["s"] / r["z"]
        repeats = tokens(r) / total * r["most"] / r["z"]
        return (most_repeats is None or repeats <= most_repeats * (1 + 1e-12)) and (target_entropy is None or entropy <= target_entropy + 1e-12)

    for _ in range(ROUNDS):  # both quantities fall as a rises
        found = tried([low + (high - low) * i / STEPS for i in range(STEPS + 1)])
        first = next((i for i, r in enumerate(found) if fits(r)), len(found) - 1)
        if first == 0:
            return found[0]["a"], tokens(found[0])
        low, high = found[first - 1]["a"], found[first]["a"]
    return high, tokens(found[first])


def digits(seed: int) -> list[Column]:
    """A document's block, and further digits of its hash."""
    h = F.xxhash64("doc_id", F.lit(seed))
    block = F.pmod(h, F.lit(BLOCKS))
    rest = [F.shiftrightunsigned(h, 16 + DIGIT_BITS * i).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)) for i in range(DIGITS)]
    return [block, *rest]


def visit(block: Column, epoch: Column, seed: int) -> Column:
    """A block's place in the permutation of an epoch, as a 62-bit order value; the block itself breaks ties."""
    return F.shiftrightunsigned(F.xxhash64("source", block, epoch, F.lit(seed)), 14) * BLOCKS + block


def plan_sources(docs: DataFrame, budget: float | None, most_repeats: float | None, target_entropy: float | None, seed: int) -> DataFrame:
    """One row for each source: weight, tokens, epochs (whole ones), and the bounds d0, d1, ... of the last part.

    docs: (doc_id, source, n_tokens).
    """
    sums = park(docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens")))
    total = float(sums.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        bounds = [F.lit(0).cast("long").alias(f"d{i}") for i in range(DIGITS + 1)]
        return sums.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("epochs"), *bounds, F.lit(1.0).alias("exponent"))
    sources = sums.filter("tokens > 0").withColumn("p", F.col("tokens") / total)
    a, spend = exponent(sources, budget, most_repeats, target_entropy)
    z = float(sources.agg(F.sum(F.pow("p", F.lit(a)))).first()[0])
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / total, F.lit(a)) / z).otherwise(0.0)
    plan = sums.withColumn("weight", weight).withColumn("exponent", F.lit(a))
    due = F.round(F.col("weight") * spend).cast("long")
    whole = F.when(F.col("tokens") > 0, F.floor(due / F.col("tokens"))).otherwise(0).cast("long")
    state = plan.withColumn("epochs", whole).withColumn("rest", due - F.col("epochs") * F.col("tokens"))
    n = sums.count()
    hashed = docs.select("source", "n_tokens", *(c.alias(f"h{i}") for i, c in enumerate(digits(seed))))
    for i in range(DIGITS + 1):  # the cell of the boundary, one digit after another
        state = park(state)
        inside = near_source(hashed, state, n)
        digit = visit(F.col("h0"), F.col("epochs"), seed) if i == 0 else F.col(f"h{i}")
        for k in range(i):
            inside = inside.filter((visit(F.col("h0"), F.col("epochs"), seed) if k == 0 else F.col(f"h{k}")) == F.col(f"d{k}"))
        cells = inside.filter("rest > 0").groupBy("source", digit.alias("digit")).agg(F.sum("n_tokens").alias("cell"))
        # at most BLOCKS cells, or 2 ** DIGIT_BITS, for a source
        before = F.coalesce(F.sum("cell").over(Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cells = near_source(cells.withColumn("before", before), state.select("source", "rest"), n)
        cut = cells.filter("before <= rest").groupBy("source").agg(F.max("before").alias("spent"), F.max("digit").alias("last"))
        state = state.join(cut.select(F.col("source").alias("s"), F.col("last").alias(f"d{i}"), F.col("spent")), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        state = state.withColumn(f"d{i}", F.coalesce(f"d{i}", F.lit(-1).cast("long")).cast("long")).withColumn("rest", F.col("rest") - F.coalesce("spent", F.lit(0))).drop("spent")
    return park(state.drop("rest"))


def near_source(df: DataFrame, plan: DataFrame, n: int) -> DataFrame:
    """df joined with the rows of plan on source, null with null; plan is sent to every task if its counted rows are few."""
    right = plan.withColumnRenamed("source", "plan_source")
    right = F.broadcast(right) if n <= 100_000 else right
    return df.join(right, df["source"].eqNullSafe(right["plan_source"])).drop("plan_source")


def copies(docs: DataFrame, plan: DataFrame, n: int, seed: int) -> DataFrame:
    """docs with weight, exponent and mix_copies: whole epochs, and one more if the row comes before the boundary."""
    kept = docs.columns
    rows = near_source(docs, plan, n)
    places = [visit(digits(seed)[0], F.col("epochs"), seed), *digits(seed)[1:]]
    before = F.lit(False)
    for i in reversed(range(DIGITS + 1)):
        before = (places[i] < F.col(f"d{i}")) | ((places[i] == F.col(f"d{i}")) & before)
    return rows.select(*kept, "weight", "exponent", (F.col("epochs") + before.cast("long")).alias("mix_copies"))


def mix(docs: DataFrame, budget: float | None = None, most_repeats: float | None = 4.0, target_entropy: float | None = None, seed: int = 1) -> DataFrame:
    """docs (doc_id, source, text and more) with n_tokens, weight, exponent and mix_copies, the number of times to use the row.

    Tokens are words. budget counts tokens; None covers every source once. A null source
    is a source of its own; a null or empty text has no tokens and goes wherever its hash
    puts it; rows with equal doc_ids of a source are used alike. The tokens used of a
    source differ from its due by less than those of the documents in one cell of the
    hash. An empty table gives an empty result. Clashing columns of docs give way.
    """
    docs = docs.drop("n_tokens", "weight", "exponent", "mix_copies")
    counted = docs.withColumn("n_tokens", word_count())
    small = park(counted.select("doc_id", "source", "n_tokens"))
    plan = plan_sources(small, budget, most_repeats, target_entropy, seed)
    return copies(counted, plan, plan.count(), seed)


def mixed(docs: DataFrame, most_repeats: float = 2.0) -> DataFrame:
    """The rows of docs as often as the mixture takes them, none left out, with the columns of docs."""
    rows = mix(docs, None, most_repeats)
    return rows.withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("mix_copies"), F.lit(1))))).select(docs.columns)


def op4(docs: DataFrame) -> DataFrame:
    """Temperature mixing with the corpus's own tokens as budget and no source used over 1.3 times."""
    small = park(docs.select("doc_id", "source", word_count().alias("n_tokens")))
    total = float(small.agg(F.sum("n_tokens")).first()[0] or 0)
    plan = plan_sources(small, total, 1.3, None, 1)
    return copies(small, plan, plan.count(), 1)
