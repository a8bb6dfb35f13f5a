"""Rows that every operator must take: nulls, empty, white, very long, repeated, and columns with clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int, lang: str = "en") -> str:
    syllables = {"en": "the er on an re he in ed nd ha at en es of or".split(), "de": "ein sch der ung ich und lich keit ver ge zu ß ü".split(), "fr": "eau les que tre oi é è ment ou aux".split()}[lang]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_rows() -> list[tuple]:
    rng = random.Random(7)
    long = prose(rng, 30_000)
    return [
        (1, None, "en", "a", None),
        (2, "", None, None, 0),
        (3, " \t\n\x0b ", "de", "a", 5),
        (4, "one", "en", "b", 3),
        (5, long, "en", "b", len(long)),
        (6, long, "en", "b", len(long)),
        (6, long, "en", "b", len(long)),
        (7, "12345 !!! ###", "en", None, 13),
        (8, "ÄÖ ß é \U0001f642 中文 \x1c x", "fr", "c", 20),
        (None, "a row without an id", None, "c", 19),
    ]


def corpus(n: int = 120, seed: int = 3) -> list[tuple]:
    """Documents in three languages with exact copies, near copies and a hot source."""
    rng = random.Random(seed)
    out: list[tuple] = []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        if i % 10 == 4 and out:
            text, lang = out[i - 3][1], out[i - 3][2]
        elif i % 10 == 7 and len(out) > 5:
            w = out[i - 5][1].split()
            w[rng.randrange(len(w))] = "changed"
            text, lang = " ".join(w), out[i - 5][2]
        else:
            text = prose(rng, rng.randint(60, 160), lang)
        out.append((i, text, lang, "hot" if i % 3 else f"s{i % 4}", len(text)))
    return out
