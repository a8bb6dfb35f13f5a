"""Operator 3: BPE encoding and decoding with forced-boundary splitting.

A pair of adjacent bytes that occurs inside no vocabulary token can be inside no output
token either, so a cut there is certain: the fragments between such cuts are merged on
their own and their ids are concatenated. The words of a batch that are not known yet are cut and
merged together, one merge of every fragment in a round; long words one by one. Each worker
keeps the ids of chunks between white space in a bounded table.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assurance.llm.common import Kept, plus

#: Encoded chunks that a worker keeps: about 30 MB.
CHUNKS = 60_000
#: Bytes of the longest word that is merged beside others, and letters of the longest fragment whose merges are sought one by one; longer ones take a heap.
SHORT = 100
#: Bytes of words that are merged together; several times as much is held.
TOGETHER = 1 << 19
#: White space as the vocabulary's own pattern has it; str.split() also cuts at \x1c-\x1f.
SPACE = r"[\t-\r \x85\xa0  -     　]"


def byte_letters() -> dict[int, str]:
    """The public byte-to-letter table of byte-level BPE: printable bytes stand for themselves, others for 256, 257, ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ForcedBoundaryBPE:
    """A tokenizers JSON file with a BPE model that has an end-of-word suffix, read once per worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.rank = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.never = len(self.rank)
        self.token = {i: t for t, i in self.vocab.items()}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.added.items()}
        self.letters = byte_letters()
        inside = set()
        for t in self.vocab:
            t = t.removesuffix(self.suffix) if self.suffix else t
            inside.update(zip(t, t[1:], strict=False))
        self.inside = inside
        letters = [self.letters[b] for b in range(256)]
        self.bytes_of = {x: b for b, x in self.letters.items()}
        self.forced = np.array([[(a, b) not in inside for b in letters] for a in letters])
        self.single, self.final = (np.array([self.vocab[x + end] for x in letters]) for end in ("", self.suffix))
        merges = sorted((self.vocab[a] << 32 | self.vocab[b], i, self.vocab[a + b]) for (a, b), i in self.rank.items())
        self.pairs, self.ranks, self.merged = (np.array(x, np.int64) for x in zip(*merges, strict=True))
        self.pieces = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}\n]+").findall  # of chunks, one in a line
        self.simple = regex.compile(r"[!-~\xa1-\u024f]+").fullmatch
        library = Tokenizer.from_file(path)
        self.clean, self.cut = library.normalizer, library.pre_tokenizer
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.odd_space = regex.compile(r"[\x1c-\x1f]")
        self.space = regex.compile(SPACE + "+")
        self.chunks = Kept(CHUNKS)

    def fragment(self, letters: str, last: bool) -> list[int]:
        """Merges of one fragment, lowest rank first, leftmost first among equals."""
        s = list(letters)
        if last:
            s[-1] += self.suffix
        get, never = self.rank.get, self.never
        ranks = [get(p, never) for p in zip(s, s[1:], strict=False)]
        if len(s) > SHORT:
            return [self.vocab[x] for x in self._merge_long(s, ranks)]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            i = ranks.index(best)
            s[i] += s.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((s[i], s[i + 1]), never)
            if i:
                ranks[i - 1] = get((s[i - 1], s[i]), never)
        return [self.vocab[x] for x in s]

    def _merge_long(self, s: list[str], ranks: list[int]) -> list[str]:
        """The same merges by a heap of (rank, place) and links between the symbols that are left: n log n."""
        get, never, n = self.rank.get, self.never, len(s)
        heap = [r << 40 | i for i, r in enumerate(ranks) if r < never]
        heapq.heapify(heap)
        ranks.append(never)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heapq.heappop(heap)
            i = top & (1 << 40) - 1
            if ranks[i] != top >> 40:
                continue  # merged or changed since
            j = after[i]
            s[i] += s[j]
            s[j], ranks[j] = "", never
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = ranks[i] = get((s[i], s[k]), never)
                if r < never:
                    heapq.heappush(heap, r << 40 | i)
            else:
                ranks[i] = never
            h = before[i]
            if h >= 0:
                r = ranks[h] = get((s[h], s[i]), never)
                if r < never:
                    heapq.heappush(heap, r << 40 | h)
        return [x for x in s if x]

    def word(self, text: str) -> list[int]:
        """One long pre-token in byte letters: cut at pairs that no token holds, merge the fragments, concatenate."""
        ids, start, inside = [], 0, self.inside
        for i, pair in enumerate(zip(text, text[1:], strict=False), 1):
            if pair not in inside:
                ids += self.fragment(text[start:i], False)
                start = i
        return ids + self.fragment(text[start:], True)

    def place(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of pairs of ids among the merges, -1 for those that do not merge."""
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, at, -1)

    def short_words(self, words: list[bytes]) -> list[bytes]:
        """Ids, as 32-bit integers, of pre-tokens of 1 to SHORT bytes: the same cuts and merges, side by side.

        A round merges in each fragment the leftmost of its pairs of lowest rank; a fragment without one is done.
        """
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        ids, head = self.single[flat], np.r_[True, self.forced[flat[:-1], flat[1:]]]
        ids[ends - 1] = self.final[flat[ends - 1]]
        head[ends[:-1]] = True
        done, home = np.full(len(flat), -1, np.int64), np.arange(len(flat))
        pair = np.r_[np.where(head[1:], -1, self.place(ids[:-1], ids[1:])), -1]  # of each symbol and the next one
        while len(ids):
            starts = np.flatnonzero(head)
            size = np.diff(starts, append=len(ids))
            rank = np.where(pair < 0, self.never, self.ranks[pair])
            least = np.repeat(np.minimum.reduceat(rank, starts), size)
            going = least < self.never
            done[home[~going]] = ids[~going]
            best = np.flatnonzero(going & (rank == least))
            if not len(best):
                break
            fragment = np.repeat(np.arange(len(starts)), size)[best]
            best = best[np.r_[True, fragment[1:] != fragment[:-1]]]
            ids[best] = self.merged[pair[best]]
            going[best + 1] = False
            best = (np.cumsum(going) - 1)[best]
            ids, head, home, pair = ids[going], head[going], home[going], pair[going]
            before = best[~head[best]] - 1
            ended = np.r_[head[1:], True]
            for left in (best, before):  # what stands beside a merged symbol is a new pair
                pair[left] = np.where(ended[left], -1, self.place(ids[left], ids[np.minimum(left + 1, len(ids) - 1)]))
        kept = done >= 0
        upto = (np.cumsum(kept)[ends - 1] * 4).tolist()
        out = done[kept].astype(np.int32).tobytes()
        return [out[a:b] for a, b in zip([0, *upto], upto, strict=False)]

    def encode_words(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of pre-tokens by their bytes."""
        ids, held, size = {}, [], 0
        for w in words:
            if len(w) > SHORT:
                ids[w] = np.array(self.word("".join(map(self.letters.__getitem__, w))), np.int32).tobytes()
                continue
            held.append(w)
            size += len(w)
            if size > TOGETHER:
                ids.update(zip(held, self.short_words(held), strict=True))
                held, size = [], 0
        if held:
            ids.update(zip(held, self.short_words(held), strict=True))
        return ids

    def learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of texts without white space; those of usual length are kept."""
        simple, odd = [], []
        for c in chunks:
            (simple if self.simple(c) else odd).append(c)
        words: list[list[bytes]] = [[]] if simple else []
        for w in self.pieces(unicodedata.normalize("NFC", "\n".join(simple)).lower()):
            if w == "\n":
                words.append([])
            else:
                words[-1].append(w.encode())
        for c in odd:  # letters of the library's own Unicode version
            words.append([bytes(map(self.bytes_of.__getitem__, w)) for w, _ in self.cut.pre_tokenize_str(self.clean.normalize_str(c))])
        ids = self.encode_words({w for ws in words for w in ws})
        out = {c: b"".join(map(ids.__getitem__, ws)) for c, ws in zip([*simple, *odd], words, strict=True)}
        for c, x in out.items():
            if len(c) <= 64:
                self.chunks.put(c, x)
        return out

    def split(self, text: str | None) -> list[str]:
        """Chunks between white space; strings of added tokens are chunks of their own."""
        if not text:
            return []
        parts = self.split_added.split(text) if self.split_added and any(a in text for a in self.added) else [text]
        return [c for p in parts for c in (filter(None, self.space.split(p)) if self.odd_space.search(p) else p.split())]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text as little-endian 32-bit integers; strings of added tokens count as those tokens."""
        split = [self.split(t) for t in texts]
        known, new = {a: np.int32(i).tobytes() for a, i in self.added.items()}, []
        for c in set().union(*split):
            ids = self.chunks.get(c)
            if ids is not None:
                known.setdefault(c, ids)
            elif c not in known:
                new.append(c)
        get = (known | self.learn(new)).__getitem__
        return [b"".join(map(get, s)) for s in split]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by one space, suffixes and special tokens included."""
        return " ".join(map(self.token.__getitem__, ids))


@lru_cache(4)
def codec(path: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(path)


def encode_decode(docs: DataFrame, tokenizer: str, text_col: str = "text", decode: bool = True) -> DataFrame:
    """docs with its columns, and bpe_ids array<int> and bpe_decoded string (null unless decode).

    tokenizer: path of the vocabulary file, readable on every executor. A null or empty
    text gives no ids and an empty string; whole texts of any length are encoded;
    repeated rows are encoded alike; an empty table gives an empty result. A clashing column of docs gives way to the new one.
    """
    docs = docs.drop("bpe_ids", "bpe_decoded")
    schema = plus(docs, "bpe_ids array<int>, bpe_decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer)
        for big in batches:
            for at in range(0, big.num_rows, 512):
                batch = big.slice(at, 512)
                coded = bpe.encode_all(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
                ends = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32)
                flat = np.frombuffer(b"".join(coded), np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                text = [bpe.decode(flat[a:b].tolist()) if decode else None for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*batch.columns, ids, pa.array(text, pa.string())], [*batch.schema.names, "bpe_ids", "bpe_decoded"])

    return docs.mapInArrow(run, schema)


def op3(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Digest columns of encode_decode, made by Spark."""
    out = encode_decode(docs.select("doc_id", "text"), tokenizer)
    return out.select(
        "doc_id",
        F.size("bpe_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("bpe_ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("bpe_decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
