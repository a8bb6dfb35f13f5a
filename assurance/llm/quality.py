"""Operator 7: quality rules with tokeniser fertility.

Every word of a text is cut by a public piece vocabulary with byte fallback. Letters per
token, the share of byte-fallback tokens and the entropy of the text's tokens are held
against bands of the text's script; texts outside a band are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assurance.llm.common import Kept, plus

#: Words whose pieces a worker keeps: about 25 MB.
KEPT = 60_000
#: Bands by script: least and most letters per token, most byte-fallback share, least token entropy in bits.
BANDS: dict[str, tuple[float, float, float, float]] = {
    "latin": (1.45, 9.0, 0.30, 2.0),
    "cyrillic": (0.80, 8.0, 0.30, 2.0),
    "greek": (0.60, 8.0, 0.60, 2.0),
    "arabic": (0.50, 8.0, 0.80, 2.0),
    "cjk": (0.25, 6.0, 0.95, 2.0),
    "other": (0.20, 12.0, 1.00, 1.5),
}
SCRIPTS = {
    "latin": r"\p{Script=Latin}",
    "cyrillic": r"\p{Script=Cyrillic}",
    "greek": r"\p{Script=Greek}",
    "arabic": r"\p{Script=Arabic}",
    "cjk": r"[\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}\p{Script=Hangul}]",
}
SYMBOL_CODES = np.array([ord(c) for c in "#*$%&|<>"])
SPACE_CODES = np.array([9, 10, 11, 12, 13, 32])
SPACES = regex.compile(r"[\x09-\x0d\x20]*").fullmatch
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, chars_per_token double, byte_share double, token_entropy double, base_failed boolean, kept boolean"


class Pieces:
    """Piece ids of words as 32-bit integers; a worker keeps those of the last ones it met."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        names = [self.model.id_to_piece(i).strip("\u2581") for i in range(len(self.is_byte))]
        self.is_number = np.array([not x or x.isdigit() for x in names])
        self.kept = Kept(KEPT)

    def of(self, found: list[bytes]) -> list[bytes]:
        get = self.kept.get
        out = [get(w) for w in found]
        miss = [i for i, x in enumerate(out) if x is None]
        if miss:
            for i, ids in zip(miss, self.model.encode([found[i].decode() for i in miss], num_threads=1), strict=True):
                out[i] = np.array(ids, np.int32).tobytes()
                if len(found[i]) <= 64:
                    self.kept.put(found[i], out[i])
        return out


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(1)
def letter_table() -> tuple[list[str], np.ndarray]:
    """Script names, and for each code point 1 + its script's place if it is a letter, 15 for digits, else 0."""
    names = [*SCRIPTS, "other"]
    table = np.zeros(0x110000, np.uint8)
    for i in range(0x32000):
        c = chr(i)
        if c.isalpha():
            table[i] = len(names)
        elif c.isdigit():
            table[i] = 15
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x32000))))
    for k, name in enumerate(SCRIPTS, 1):
        for m in regex.finditer(SCRIPTS[name] + "+", every):
            at = np.frombuffer(m[0].encode("utf-32-le"), np.uint32)
            table[at[table[at] == len(names)]] = k
    return names, table


def repeat_words(ids: np.ndarray, window: int = 5) -> int:
    """Words that some window found twice or more covers, the first finding included; ids number the words of a text."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    size = int(ids.max()) + 1
    rank = ids
    if size**window < 1 << 63:
        for k in range(1, window):
            rank = rank[:n] * size + ids[k : k + n]
        s = np.sort(rank)
        if (s[1:] != s[:-1]).all():
            return 0
        rank = np.unique(rank, return_inverse=True)[1]
    else:  # numbers the windows exactly, one more word at a time
        for k in range(1, window):
            rank = np.unique(rank[:n].astype(np.int64) * size + ids[k : k + n], return_inverse=True)[1]
    again = np.bincount(rank)[rank] > 1
    cover = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def numbered(found: list[bytes]) -> tuple[dict[bytes, int], np.ndarray]:
    """Numbers of distinct words by first occurrence, and the number of each word."""
    number: dict[bytes, int] = {}
    put = number.setdefault
    return number, np.array([put(w, len(number)) for w in found], np.int64)


def measure(text: str | None, vocabulary: Pieces) -> tuple:
    """The row of COLUMNS for one text."""
    found = text.encode("utf-8").split() if text else []
    n_words = len(found)
    letters = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
    low_count = np.bincount(letters[letters < 128], minlength=128)
    n_symbols = int(low_count[SYMBOL_CODES].sum())
    if not n_words:
        return 0, 0, n_symbols, 0, 0, "other", None, None, None, True, False
    lines = [x for x in text.split("\n") if x and not SPACES(x)]
    exact, ids = numbered(found)
    word_chars = len(letters) - int(low_count[SPACE_CODES].sum())
    n_repeat = repeat_words(ids) if len(exact) < n_words else 0
    base_failed = n_words < 10 or 100 * n_repeat > 20 * n_words
    number, ids = numbered([w.lower() for w in found])  # pieces are those of lower-cased words, repeats are sought as written
    got = vocabulary.of(list(number))
    sizes = np.array([len(x) // 4 for x in got])
    pieces_of = np.frombuffer(b"".join(got), np.int32)
    times = np.repeat(np.bincount(ids, minlength=len(number)), sizes)
    n_tokens = max(1, int(times.sum()))
    byte_share = float(times[vocabulary.is_byte[pieces_of]].sum()) / n_tokens
    tokens = np.bincount(pieces_of, weights=times) if len(pieces_of) else np.zeros(1)
    p = tokens[tokens > 0] / n_tokens
    entropy = float(-(p * np.log2(p)).sum()) if len(p) else 0.0
    names, kinds = letter_table()
    count = np.bincount(kinds[letters], minlength=16)
    per = float(count[1:15].sum()) / max(1, int(times[~vocabulary.is_number[pieces_of]].sum()))
    script = names[int(count[1 : len(names) + 1].argmax())] if count[1 : len(names) + 1].any() else "other"
    low, high, most_bytes, least_entropy = BANDS[script]
    verdict = low <= per <= high and byte_share <= most_bytes and entropy >= least_entropy
    return n_words, word_chars, n_symbols, len(lines) - len(set(lines)), n_repeat, script, per, byte_share, entropy, base_failed, bool(verdict and not base_failed)


def score_quality(docs: DataFrame, pieces_model: str, text_col: str = "text") -> DataFrame:
    """docs with the columns of COLUMNS, clashing ones replaced; row order and number are kept.

    A null or empty text has no words and fails. Whole texts count, however long. Two
    equal rows get equal results; an empty table gives an empty result. Of two scripts with as many letters
    the first in SCRIPTS counts. chars_per_token counts letters,
    over the pieces that are no digits or lone spaces: numbers are cut digit by digit in any text. base_failed holds the fixed rules, kept also needs the
    fertility bands of the script most of the text's letters belong to ("other" if none).
    """
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    docs = docs.drop(*names)
    schema = plus(docs, COLUMNS)
    kinds = [pa.int64()] * 5 + [pa.string()] + [pa.float64()] * 3 + [pa.bool_()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(pieces_model)
        for big in batches:
            for at in range(0, big.num_rows, 512):
                batch = big.slice(at, 512)
                rows = [measure(t, vocabulary) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
                more = [pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def filter_quality(docs: DataFrame, pieces_model: str) -> DataFrame:
    """The rows of docs that score_quality keeps, with the columns of docs."""
    return score_quality(docs, pieces_model).filter("kept").select(docs.columns)


def op7(docs: DataFrame, pieces_model: str) -> DataFrame:
    out = score_quality(docs.select("doc_id", "text"), pieces_model)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "script", *(F.round(c, 6).alias(c) for c in ("chars_per_token", "byte_share", "token_entropy")))
