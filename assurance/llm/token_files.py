"""Operator 10: token ids in Arrow IPC files of fixed-size-list batches.

One file per range of doc_id. A row is a sequence of seq_len ids (16 bits each where the
vocabulary allows, else 32) and its mask of bits, both fixed-size lists, so sequence k of a file is row k % rows of batch k // rows and is read
without a copy from a memory map. Documents run on from sequence to sequence; only the
last sequence of a file is padded (id 0, mask 0). Beside each file lies its index (doc_id,
start, n_tokens in the file), and a manifest table lists the files that count: a task that
is tried again writes new names, so what a lost executor left behind is never read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assurance.llm.common import shared_dir

#: Chunks that a worker keeps with their ids, the longest of them in bytes, and bytes of text that are encoded together.
CACHE, KEPT, LOT = 600_000, 64, 8 << 20
#: Chunks that one call of the library encodes; it holds much more than ids until it returns.
CALL = 256


def bytes_of(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 bytes lie in some range, ends included."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


SPACE, LETTER, VISIBLE = bytes_of((9, 13), (32, 32)), bytes_of((65, 90), (97, 122)), bytes_of((33, 126))
MARK = VISIBLE & ~LETTER
#: First bytes of two whose characters are letters (but for the signs of times and division): Latin and Cyrillic.
LEAD = bytes_of((0xC3, 0xC8), (0xD0, 0xD1))
#: Bytes that a word must not hold to be encoded with others: controls, spaces, and first bytes of characters that may be spaces.
ODD = bytes_of((0, 32), (127, 127), (0xC2, 0xC2), (0xE1, 0xE3))
MANIFEST = "part int, path string, index_path string, n_docs long, n_ids long"


def cuts(data: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at a byte of UTF-8 whatever stands around: a space after another character, or an ASCII mark or digit after a letter.

    Spaces after a character that is a space itself, or might be one, are no cut.
    """
    cut = np.zeros(len(data), bool)
    last, here = data[:-1], data[1:]
    space, mark = SPACE[here], MARK[here]
    cut[1:] = space & VISIBLE[last] | mark & LETTER[last]
    at = np.flatnonzero((space | mark) & (last >= 0x80)) + 1  # after a character of several bytes
    at = at[at >= 3]
    u, v, w = data[at - 3], data[at - 2], data[at - 1]
    blank = (v == 0xC2) & ((w == 0x85) | (w == 0xA0)) | (u == 0xE1) & ((v == 0x9A) | (v == 0xA0)) | (u == 0xE3) & (v == 0x80) & (w == 0x80)
    blank |= (u == 0xE2) & ((v == 0x80) & ((w <= 0x8F) | (w >= 0xA8) & (w <= 0xAF)) | (v == 0x81) & (w >= 0x9F))
    letter = LEAD[v] & ~((v == 0xC3) & ((w == 0x97) | (w == 0xB7)))
    cut[at] = np.where(SPACE[data[at]], ~blank, letter)
    return cut


class Chunks:
    """Distinct chunks of text with their ids, all ids in one array."""

    def __init__(self, chunks: pa.Array, ids: np.ndarray, lengths: np.ndarray):
        self.chunks, self.ids, self.lengths = chunks, ids, lengths

    def take(self, at: np.ndarray) -> np.ndarray:
        """Ids of the chunks at these places, one after the other."""
        lengths = self.lengths[at]
        starts = (np.cumsum(self.lengths) - self.lengths)[at]
        return self.ids[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]

    def only(self, at: np.ndarray) -> Chunks:
        return Chunks(self.chunks.take(pa.array(at)), self.take(at), self.lengths[at])

    def plus(self, other: Chunks) -> Chunks:
        return Chunks(pa.concat_arrays([self.chunks, other.chunks]), np.concatenate([self.ids, other.ids]), np.concatenate([self.lengths, other.lengths]))


class ByteLevelEncoder:
    """The tokenizers library behind a table of encoded chunks; one per worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        size = self.library.get_vocab_size()
        self.after_space = np.array([(self.library.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        self.known = self.none = Chunks(pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def holds_added(self, texts: pa.Array) -> np.ndarray:
        return np.any([np.zeros(len(texts), bool), *(pc.match_substring(texts, a).to_numpy(zero_copy_only=False) for a in self.added)], axis=0)

    def alone(self, chunks: pa.Array, call: int) -> Chunks:
        parts = (chunks.slice(at, call).to_pylist() for at in range(0, len(chunks), call))
        found = [np.array(e.ids, np.uint32) for part in parts for e in self.library.encode_batch_fast(part, add_special_tokens=False)]
        return Chunks(chunks, np.concatenate([self.none.ids, *found]), np.array([len(x) for x in found], np.int64))

    def together(self, words: pa.Array) -> Chunks:
        """Words that start with the only space they have: where a token starts with one, a word does."""
        texts = words.to_pylist()
        found = [np.array(self.library.encode("".join(texts[at : at + CALL]), add_special_tokens=False).ids, np.uint32) for at in range(0, len(texts), CALL)]
        ids = np.concatenate([self.none.ids, *found])
        lengths = np.diff(np.flatnonzero(self.after_space[ids]), append=len(ids))
        if len(lengths) != len(words):
            raise ValueError(f"{len(words)} words were encoded as {len(lengths)}")
        return Chunks(words, ids, lengths)

    def new(self, chunks: pa.Array) -> tuple[Chunks, np.ndarray]:
        """The chunks encoded, those of over KEPT bytes last, and where each stood."""
        if not len(chunks):
            return self.none, np.zeros(0, np.int64)
        ends = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset :][: len(chunks) + 1]
        data = np.frombuffer(chunks.buffers()[2], np.uint8)
        size, odd = np.diff(ends), np.diff(np.r_[0, np.cumsum(ODD[data])][ends])
        kept = size <= KEPT
        word = kept & (size > 1) & (data[ends[:-1]] == 32) & (odd == 1) & ~self.holds_added(chunks)
        words, short, long = (np.flatnonzero(x) for x in (word, kept & ~word, ~kept))
        found = self.together(chunks.take(pa.array(words))).plus(self.alone(chunks.take(pa.array(short)), CALL))
        return found.plus(self.alone(chunks.take(pa.array(long)), 1)), np.r_[words, short, long]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts one after the other, and how many each text has (null: none)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
        if not len(texts) or ends[0] == ends[-1]:
            return self.none.ids, np.zeros(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        cut = np.r_[cuts(data), True]
        for i in np.flatnonzero(self.holds_added(texts)):
            cut[ends[i] : ends[i + 1]] = False
        cut[ends] = True
        at = np.flatnonzero(cut).astype(np.int32)
        chunks = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data)).dictionary_encode()
        distinct = chunks.dictionary
        place = pc.fill_null(pc.index_in(distinct, value_set=self.known.chunks), -1).to_numpy().astype(np.int64)
        unknown = np.flatnonzero(place < 0)
        new, order = self.new(distinct.take(pa.array(unknown)))
        table = self.known.plus(new)
        place[unknown[order]] = np.arange(len(self.known.lengths), len(table.lengths))
        which = place[chunks.indices.to_numpy()]
        lengths = np.diff(np.r_[0, np.cumsum(table.lengths[which])][np.searchsorted(at, ends)])
        ids = table.take(which)
        short = pc.binary_length(table.chunks).to_numpy() <= KEPT
        keep = np.sort(place) if short.sum() > CACHE else np.arange(len(short))  # if too many, only those of these texts
        self.known = table.only(keep[short[keep]])
        return ids, lengths


@lru_cache(2)
def encoder(path: str) -> ByteLevelEncoder:
    return ByteLevelEncoder(path)


class SequenceWriter:
    """Packs a run of ids into fixed-size lists, a batch of rows at a time."""

    def __init__(self, sink, seq_len: int, rows: int, wide: bool):
        self.seq_len, self.rows, self.kind = seq_len, rows, np.uint32 if wide else np.uint16
        self.schema = pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.out = ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.n_ids = 0

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (ids.astype(self.kind), mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        full = self.rows * self.seq_len
        if self.n_held >= full:
            flat = np.concatenate(self.held)
            for at in range(0, len(flat) - full + 1, full):
                self._batch(flat[at : at + full], full)
            rest = flat[len(flat) // full * full :].copy()
            self.held, self.n_held = [rest], len(rest)

    def close(self) -> None:
        flat = np.concatenate([np.zeros(0, np.uint32), *self.held])
        if len(flat):
            self._batch(np.r_[flat, np.zeros(-len(flat) % self.seq_len, np.uint32)], len(flat))
        self.out.close()


def lots(batch: pa.RecordBatch, most: int = LOT) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, none empty, with less than most bytes of text after their first row."""
    if batch.num_rows:
        lot = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)) // most
        for low, high in pairwise([0, *(np.flatnonzero(np.diff(lot)) + 1).tolist(), batch.num_rows]):
            yield batch.slice(low, high - low)


def write_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, seq_len: int = 2048, rows: int = 128) -> DataFrame:
    """Encode docs (doc_id, text) in ascending doc_id order into files; returns the manifest, which is written there too.

    A null or empty text gives end_id alone. Equal doc_ids stand in the order of their
    texts, null first; a null doc_id stands first. Other columns of docs are not written.
    An empty table gives an empty manifest. folder lies in the shared checkpoint folder if
    not given.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    spark.range(0).write.parquet(f"{folder}/made")  # makes the folder, wherever it is

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        store, root = fs.FileSystem.from_uri(folder)
        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        path, index_path = f"{root}/{part:06d}-{name}.arrow", f"{root}/{part:06d}-{name}.docs.arrow"
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        code, n_docs = encoder(tokenizer), 0
        with store.open_output_stream(path) as sink, store.open_output_stream(index_path) as index_sink, ipc.new_file(index_sink, schema) as index:
            out = SequenceWriter(sink, seq_len, rows, wide=len(code.after_space) > 1 << 16)
            for big in (b for some in ([first], batches) for b in some):
                for batch in lots(big):
                    start = out.n_ids
                    ids, lengths = code.encode(batch.column(1))
                    out.add(np.insert(ids, np.cumsum(lengths), end_id))
                    starts = start + np.cumsum(lengths + 1) - lengths - 1
                    index.write_batch(pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts, pa.int64()), pa.array(lengths + 1, pa.int64())], schema=schema))
                    n_docs += batch.num_rows
            out.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "index_path": [index_path], "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([out.n_ids], pa.int64())})

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").withColumn("folder", F.lit(folder))


def read_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; start counts all ids of earlier documents.

    The running total is taken over the manifest, which has one row for each file.
    """
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("before", before)
    files = files.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, _ = fs.FileSystem.from_uri(row["folder"])
                yield from read_one(store, row["path"], row["index_path"], row["before"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_one(store: fs.FileSystem, path: str, index_path: str, before: int) -> Iterator[pa.RecordBatch]:
    """Documents of one file; a document's sequences are gathered batch by batch, in order."""
    local = isinstance(store, fs.LocalFileSystem)
    with (pa.memory_map(path) if local else store.open_input_file(path)) as source, store.open_input_file(index_path) as index_source:
        data, index = ipc.open_file(source), ipc.open_file(index_source)
        at, flat, base = 0, np.zeros(0, np.uint32), 0  # next batch; ids from position base on
        for k in range(index.num_record_batches):
            docs = index.get_batch(k)
            starts, lengths = docs.column(1).to_numpy(), docs.column(2).to_numpy()
            crcs = []
            for s, n in zip(starts.tolist(), lengths.tolist(), strict=True):
                while base + len(flat) < s + n:
                    batch = data.get_batch(at)
                    ids, mask = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().true_count
                    keep = flat[max(0, s - base) :]
                    base += len(flat) - len(keep)
                    flat = np.r_[keep, ids[:mask]]
                    at += 1
                crcs.append(zlib.crc32(flat[s - base : s - base + n].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(starts + before), docs.column(2), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def sequence(store: fs.FileSystem, path: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of sequence k of a file, as views of the mapped batch."""
    with pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path) as source:
        data = ipc.open_file(source)
        rows = data.get_batch(0).num_rows
        batch = data.get_batch(k // rows)
        return tuple(batch.column(c)[k % rows].values.to_numpy(zero_copy_only=not c) for c in (0, 1))
