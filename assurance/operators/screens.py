"""Screens of questions: rules, intents, errands, harm and the order of the gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assurance.functions import patterns as P
from assurance.functions import text as T
from assurance.operators.corpus import few


def hits(text: Column, pattern: str) -> Column:
    """Whether a literal pattern, compiled once for each task, hits without regard to case; one that begins with (?U) is left to Java."""
    return F.coalesce(text.rlike("(?is)" + (pattern if pattern.startswith("(?U)") else T.re2(pattern))), F.lit(False))


def first_true(cases: list[tuple[Column, str]]) -> Column:
    out = F.lit(None).cast("string")
    for condition, value in reversed(cases):
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out


def ingress_findings(q: Column) -> Column:
    """Array of (check, what, quote): the first rule of each check that hits, with ten characters around it (Q1)."""
    found = []
    for check in dict.fromkeys(c for c, _, _ in P.INGRESS):
        case = F.lit(None).cast("struct<check:string,what:string,quote:string>")
        for c, what, pattern in reversed(P.INGRESS):
            if c == check:
                quote = F.regexp_extract(q, f"(?is)(.{{0,10}}(?:{T.re2(pattern)}).{{0,10}})", 1)
                case = F.when(hits(q, pattern), F.struct(F.lit(c).alias("check"), F.lit(what).alias("what"), quote.alias("quote"))).otherwise(case)
        found.append(case)
    return F.array_compact(F.array(*found))


def intent(q: Column) -> Column:
    """struct(intent, confidence): most hits win, action beats all, ties go to the larger name (Q3)."""
    counts = {k: F.regexp_count(q, F.lit("(?i)" + T.re2(p))) for k, p in P.INTENTS.items()}
    action = counts.pop("action_request")
    total = action
    for c in counts.values():
        total = total + c
    best = F.array_max(F.array(*(F.struct(c.alias("n"), F.lit(k).alias("k")) for k, c in counts.items())))
    return (
        F.when(total == 0, F.struct(F.lit("general_question").alias("intent"), F.lit(0.0).alias("confidence")))
        .when(action > 0, F.struct(F.lit("action_request").alias("intent"), F.bround(action / total, 3).alias("confidence")))
        .otherwise(F.struct(best["k"].alias("intent"), F.bround(best["n"] / total, 3).alias("confidence")))
    )


def errand(q: Column) -> Column:
    """Family of a private errand, null if a word of work or nothing hits (Q9)."""
    private = hits(q, P.PERSONAL_MARK)
    cases = [(hits(q, p) & (private if needs else F.lit(True)), family) for family, needs, p in P.ERRANDS]
    return F.when(~hits(q, P.WORK), first_true(cases))


def harms(q: Column) -> Column:
    """Array of (family, severity) that a text asks for or holds (Q8).

    Exclusions come first; guards must hit too. Stated hostility comes last and is medium,
    but first and high beside any high finding.
    """
    excused = F.lit(False)
    for _, pattern in P.HARM_EXCLUSIONS:
        excused = excused | hits(q, pattern)
    policy = hits(q, P.POLICY_CONTEXT)
    found = []
    for family, severity, guard, excusable, pattern in P.HARMS:
        ok = hits(q, pattern) & hits(q, guard)
        ok = ok & ~policy if excusable else ok
        found.append(F.when(ok, F.struct(F.lit(family).alias("family"), F.lit(severity).alias("severity"))))
    *methods, hostile = found
    methods, hostile = F.array_compact(F.array(*methods)), F.array_compact(F.array(hostile))
    worse = F.exists(methods, lambda h: h["severity"] == "high")
    raised = F.transform(hostile, lambda h: F.struct(h["family"].alias("family"), F.lit("high").alias("severity")))
    return F.when(excused, F.slice(methods, 1, 0)).when(worse, F.concat(raised, methods)).otherwise(F.concat(methods, hostile))


def blocklist(questions: DataFrame, terms: DataFrame, most: int = 4) -> DataFrame:
    """(request_id, n, term): the first blocked terms, in their configured order, that a question holds as whole words (Q7).

    terms: (system_id, ord, term). A term may have several words and other signs; it counts
    from three characters on, without regard to case. Terms meet questions by an equi-join on
    their rarest word; only those pairs are compared in full, at any place where no letter or
    digit touches the term. A term without a word meets all questions of its system.
    """
    word = r"(?U)\w+"
    asked = questions.select("request_id", "system_id", "question", F.explode(F.array_append(F.array_distinct(T.found(F.lower("question"), word)), F.lit(""))).alias("word"))
    t = terms.withColumn("term", F.trim("term")).filter(F.char_length("term") >= 3)
    parts = t.withColumn("word", F.explode(F.when(F.col("term").rlike(word), F.array_distinct(T.found(F.lower("term"), word))).otherwise(F.array(F.lit("")))))
    seen = asked.join(few(parts.select("word").distinct()), "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
    rarest = parts.join(seen, "word", "left").groupBy("system_id", "ord", "term").agg(F.min(F.struct(F.coalesce("df", F.lit(0)), "word")).alias("x")).select("system_id", "ord", "term", F.col("x.word").alias("word"))
    whole = F.concat(F.lit(r"(?iU)(?<!\w)\Q"), F.replace("term", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))
    found = asked.join(few(rarest), ["system_id", "word"]).filter(F.rlike("question", whole))
    n = F.row_number().over(Window.partitionBy("request_id").orderBy("ord", "term"))
    return found.withColumn("n", n).filter(F.col("n") <= most).select("request_id", "n", "term")


def screen(questions: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """questions with outcome, the first gate that refuses: blocked terms, harm, errand, ingress, else allow (Q6, Q14).

    blocked: (request_id) of blocklist(), which no exclusion of the harm screen excuses. Later gates are computed only for rows that the earlier ones let through, since CASE
    stops at the first branch that holds.
    """
    q = F.col("question")
    blank = T.trimmed(q) == ""
    checks = F.size(ingress_findings(q)) > 0
    if blocked is not None:
        questions = questions.join(blocked.select("request_id").distinct().withColumn("blocked", F.lit(True)), "request_id", "left")
    else:
        questions = questions.withColumn("blocked", F.lit(None).cast("boolean"))
    outcome = (
        F.when(F.coalesce(blank, F.lit(True)), "refused_empty")
        .when(F.coalesce("blocked", F.lit(False)), "refused_blocked")
        .when(F.size(harms(q)) > 0, "refused_harmful")
        .when(errand(q).isNotNull(), "out_of_purpose")
        .when(checks | (F.char_length(q) > 4000), "held")
        .otherwise("allow")
    )
    return questions.withColumn("outcome", outcome).drop("blocked")
