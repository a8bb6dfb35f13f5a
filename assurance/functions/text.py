"""Text functions as Spark columns: tokens, sentences, figures, identifiers and digests."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from assurance.functions import patterns as P

# Stop words, token patterns and shapes.
BM25_STOP = """a an the and or but if then than that this these those is are was were be been being am do does did doing have has had having i me my we us our you your he him his she her
it its they them their what which who whom when where why how all any both each few more most other some such no nor not only own same so too very s t can will just don should now of to in
for on with as at by from up out about into over after""".split()
CLAIM_STOP = "the a an is are was were be to of and or in on for with that this it as at by from will can may your you we our i am please all".split()
SUBJECT_STOP = """the a an and or of to in for on at is are was were be been being this that these those with as by from it its you your we our i me my they their he she his her
will shall can may might must should would could do does did done has have had not no nor if but then than so such when where which who whom whose what how why all any each every both few more most
other some only own same too very just about above after again against below between during into once over under until up down out off again further here there both
policy policies procedure procedures process must required requires requirement requirements approved approval approvals guide guideline guidelines section version effective supersedes applies apply
applicable document documented note notes example examples general standard standards rule rules must never always system systems team teams used use using user users work working
page pages line lines item items list lists table tables""".split()
STEM_STOP = """a an the and or of to in for on at is are was were be been being this that these those with as by from it its you your we our i me my they their will shall would
should could do does did have has had not no but if then than so such when where which who what how why any some more most other each both very just about into""".split()
BM25_TOKEN, CLAIM_TOKEN, SUBJECT_TOKEN, STEM_TOKEN = "[a-z0-9][a-z0-9'_-]*", "[a-z0-9%.₹]+", "[a-z][a-z0-9-]{2,}", "[a-z][a-z0-9-]*"
DIGIT_RUN, EMAIL, PHONE = r"(?<!\d)(?:\d[ -]?){11,19}\d(?!\d)", r"\b[\w.+-]+@[\w-]+\.[A-Za-z]{2,}\b", r"(?<!\d)(?:\+91[\s-]?)?[6-9]\d{9}(?!\d)"
FIGURE = r"(?<![\w.])(?:₹|[Rr][Ss]\.?\s*)?\d[\d,]*(?:\.\d+)?%?"
SENTENCE_END = r"(?<=[.!?])\s+"
MASK = "•" * 12
#: The space separators that trim() of SQL takes off; tabs and line ends stay.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def re2(pattern: str) -> str:
    r"""A pattern that Java reads as RE2 does: \b goes by ASCII letters, digits and _ alone, \s has no \x0b."""
    either = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
    tokens, out, inside = re.findall(r"\\[pP]\{\w+\}|\\.|\(\?<?[a-zA-Z=!]*[:>]?|.", pattern, re.S), [], False
    for i, t in enumerate(tokens):
        before, after, then = tokens[i - 1] if i else "", tokens[i + 1] if i + 1 < len(tokens) else "", tokens[i + 2] if i + 2 < len(tokens) else ""
        if t == "\\b" and not inside:
            t = r"(?<!\w)" if re.fullmatch(r"\w", after, re.A) and then not in ("?", "*", "{") else r"(?!\w)" if re.fullmatch(r"\w", before, re.A) else either
        elif t == "\\s":
            t = r" \t\n\f\r" if inside else r"[ \t\n\f\r]"
        inside = (inside or t == "[") and t != "]"
        out.append(t)
    return "".join(out)


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def _without(tokens: Column, stop: list[str], least: int) -> Column:
    words = sorted(set(stop))  # a set that Spark hashes once
    return F.filter(tokens, lambda w: (F.char_length(w) > least) & ~w.isin(*words))


def bm25_tokens(text: Column) -> Column:
    """Tokens for retrieval in text order, repeats kept (TX2)."""
    return _without(found(F.lower(text), BM25_TOKEN), BM25_STOP, 1)


def claim_words(text: Column) -> Column:
    """Set of content words of a claim (TX3)."""
    return F.array_distinct(_without(found(F.lower(text), CLAIM_TOKEN), CLAIM_STOP, 1))


def subject_terms(text: Column) -> Column:
    """Terms that can name a subject (TX4)."""
    return _without(found(F.lower(text), SUBJECT_TOKEN), SUBJECT_STOP, 2)


def stem(word: Column) -> Column:
    n = F.char_length(word)
    out = word
    for suffix, put in (("s", ""), ("es", ""), ("ed", ""), ("ing", ""), ("ies", "y")):
        out = F.when((n > len(suffix) + 2) & word.endswith(suffix), F.concat(F.substr(word, F.lit(1), n - len(suffix)), F.lit(put))).otherwise(out)
    return out


def stems(text: Column) -> Column:
    """Stemmed content words, repeats kept (TX5)."""
    return F.transform(_without(found(F.lower(text), STEM_TOKEN), STEM_STOP, 2), stem)


def sentences(text: Column) -> Column:
    """Sentences of a text, trimmed, empty ones left out (TX6)."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), trimmed), lambda s: s != "")


def figures(text: Column) -> Column:
    """Figures of a text with value and shape (TX7)."""

    def one(raw: Column) -> Column:
        low = F.lower(raw)
        shape = F.when(low.endswith("%"), "percent").when(low.startswith("₹") | low.startswith("rs"), "money").otherwise("plain")
        return F.struct(raw.alias("raw"), F.regexp_replace(low, r"[₹,\s]|rs\.?", "").alias("value"), shape.alias("shape"))

    return F.transform(found(text, FIGURE), one)


def digest(text: Column) -> Column:
    """Digest that reordered and repeated words do not change (TX12)."""
    return F.substring(F.sha2(F.array_join(F.array_sort(claim_words(text)), " "), 256), 1, 16)


def redact(text: Column) -> Column:
    """Identifiers masked (TX13): long digit runs keep their last four characters."""
    runs = found(text, DIGIT_RUN)
    out = F.aggregate(runs, text, lambda s, r: F.replace(s, r, F.concat(F.lit(MASK), F.right(r, F.lit(4)))))
    return F.regexp_replace(F.regexp_replace(out, EMAIL, "[redacted-email]"), PHONE, "[redacted-phone]")


def slug(title: Column, limit: int = 40) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, limit), "-+$", "")
    return F.when(s == "", "document").otherwise(s)


def document_id(title: Column, content: Column) -> Column:
    """Id that follows from title and content (TX11)."""
    return F.concat(slug(title), F.lit("-"), F.substring(F.sha2(content, 256), 1, 8))


def luhn(digits: Column) -> Column:
    """Mod-10 checksum of a string of digits (M5)."""
    n = F.char_length(digits)

    def part(i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), part), F.lit(0), lambda s, x: s + x) % 10 == 0


# Fixed values of the Verhoeff check: multiplication in the dihedral group of order ten, and the permutation of digits.
DIHEDRAL = ["0123456789", "1234067895", "2340178956", "3401289567", "4012395678", "5987604321", "6598710432", "7659821043", "8765932104", "9876543210"]
PERMUTE = ["0123456789", "1576283094", "5803796142", "8916043527", "9453126870", "4286573901", "2793806415", "7046913258"]


def verhoeff(digits: Column) -> Column:
    """Dihedral checksum of a string of digits (M6), as a fold over two constant strings."""
    n = F.char_length(digits)
    d, p = F.lit("".join(DIHEDRAL)), F.lit("".join(PERMUTE))

    def at(table: Column, row: Column, column: Column) -> Column:
        return F.substr(table, row * 10 + column + 1, F.lit(1)).cast("int")

    def step(c: Column, i: Column) -> Column:
        return at(d, c, at(p, i % 8, F.substr(digits, n - i, F.lit(1)).cast("int")))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) == 0


def asking_terms(text: Column) -> Column:
    """Words of a question or an answer that can carry an objective, in order."""
    return _without(found(F.lower(text), P.ASKING_TOKEN), P.ASKING_STOP, 2)


def concepts(words: Column) -> Column:
    """Words with each member of a concept family replaced by the family's name (TX14), so that related ones are equal."""
    family = F.create_map(*(F.lit(x) for n, members in enumerate(P.FAMILIES) for w in members for x in (w, f"#{n}")))
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(family, w), w))


def related(a: Column, b: Column, prefix: int = 5) -> Column:
    """Words that are equal, a plain plural of each other, or of which one of at least prefix letters begins the other (TX14)."""
    plural = (a == F.concat(b, F.lit("s"))) | (b == F.concat(a, F.lit("s")))
    return (a == b) | plural | ((F.char_length(a) >= prefix) & b.startswith(a)) | ((F.char_length(b) >= prefix) & a.startswith(b))
