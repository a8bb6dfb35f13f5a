"""Documents as files: scan of a folder of systems, chunking, and the partitioned store."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

# What is read, and the sizes of chunks.
SUFFIXES = ("txt", "md", "markdown", "csv", "json", "log", "rst")
MOST_BYTES = 8 * 1024 * 1024
TARGET, LEAST, MOST = 700, 220, 1200


def scan(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) under root/<system>/<file> (SRC3): UTF-8, else Latin-1; rejects keep their reason.

    Names and sizes alone decide on most rejects: the content of a file with another suffix
    or over MOST_BYTES is never read.
    """

    def files(**options: str) -> DataFrame:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").options(**options).load(root)

    names = [F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("system_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("filename")]
    suffix = F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1))
    reason = F.when(~suffix.isin(*SUFFIXES), "suffix").when(F.col("length") > MOST_BYTES, "too large")
    refused = files().select(*names, "length").withColumn("reason", reason).filter("reason is not null").select("system_id", "filename", "reason")
    any_case = ",".join("".join(f"[{c}{c.upper()}]" for c in s) for s in SUFFIXES)
    read = files(pathGlobFilter=f"*.{{{any_case}}}").filter(F.col("length") <= MOST_BYTES)
    text = F.coalesce(F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    f = read.select(*names, text.alias("text"))
    empty = f.filter(F.trim("text") == "").select("system_id", "filename", F.lit("empty").alias("reason"))
    return f.filter(F.trim("text") != ""), refused.unionByName(empty)


#: Texts that a worker holds as Python strings at once while it normalises them.
AT_ONCE = 256


def nfkc(text: Column) -> Column:
    """NFKC form of a text (TX1); plain ASCII, the common case, never leaves the JVM.

    A function of Python is called for every row, whatever condition stands before it, so plain
    texts go to it as null; of the others a worker turns AT_ONCE into strings at a time.
    """

    def slow(texts: pa.Array) -> pa.Array:
        done = [pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in texts.slice(at, AT_ONCE).to_pylist()], pa.string()) for at in range(0, len(texts), AT_ONCE)]
        return pa.concat_arrays(done) if done else pa.array([], pa.string())

    plain = text.rlike(r"^\p{ASCII}*$")
    return F.when(plain, text).otherwise(arrow_udf(slow, "string")(F.when(~plain, text)))


def split(text: str) -> list[str]:
    """Chunks of a text: short paragraphs are merged, long ones divided at sentences, no sentence is cut (TX10)."""
    chunks: list[str] = []
    held = ""
    for para in filter(None, (p.strip() for p in re.split(r"\n\s*\n", text.replace("\r\n", "\n").replace("\r", "\n")))):
        if len(para) > MOST:
            parts = re.split(r"(?<=[.!?])\s+", para)
            done, piece = [], parts[0]
            for part in parts[1:]:
                if len(piece) + len(part) + 1 > TARGET:
                    done.append(piece)
                    piece = part
                else:
                    piece += " " + part
            chunks += ([held] if held else []) + done + [piece]
            held = ""
        elif not held:
            held = para
        elif len(held) < LEAST or len(held) + len(para) + 2 <= TARGET:
            held += "\n\n" + para
        else:
            chunks.append(held)
            held = para
    return [c.strip() for c in [*chunks, held] if c.strip()]


def chunk(docs: DataFrame) -> DataFrame:
    """(system_id, doc_id, chunk_id, ord, text) of docs (system_id, doc_id, text) (TX10, F5)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(s, str(i), f"{i}#{n:03d}", n, c) for s, i, t in zip(b["system_id"], b["doc_id"], b["text"], strict=True) for n, c in enumerate(split(unicodedata.normalize("NFKC", t or "")))]
            yield pd.DataFrame(rows, columns=["system_id", "doc_id", "chunk_id", "ord", "text"])

    return docs.select("system_id", "doc_id", "text").mapInPandas(run, "system_id string, doc_id string, chunk_id string, ord int, text string")


def store(docs: DataFrame, path: str) -> None:
    """Documents by system (SRC4); writing a system again replaces that system alone."""
    docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("system_id").parquet(path)
