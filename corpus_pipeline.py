"""The corpus pipeline: quality rules, language, near-dedup, mixing, tokens; each stage reads what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assurance.llm import bpe, langid, mixing, neardup, quality
from assurance.llm.common import park
from assurance.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and the fertility bands.

    A null, empty or white text has too few words and goes; repeated rows are judged alike, a
    very long text is read whole; an empty table stays empty.
    """
    return quality.filter_quality(docs, tokenizer_path("piece_bpe_32k.model"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; learned from the labelled ones among them.

    Texts without a letter are not recognised; null labels are not learned from, and without
    any label nothing is recognised; ties go to the first language by name; repeated rows are
    judged alike; an empty table stays empty.
    """
    return langid.filter_language(docs, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at five words and 0.8.

    The least id stays, of repeated rows one; empty texts are in no group; rows without an id
    stay once for each text that no row with an id holds or resembles; an empty table stays empty.
    """
    return neardup.dedup(docs, k=5, percent=80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it, no source over twice.

    Null sources are one source; repeated rows are rows of their own; an empty table stays empty.
    """
    return mixing.mixed(docs, most_repeats=2.0)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and the digest of what they decode to.

    A null or empty text has no ids, repeated rows are encoded alike, an empty table gives an
    empty result. Rows go to the workers 1000 at a time: the buffers of a batch lie outside of
    the heap, where nothing but a collection of garbage frees them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    out = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), tokenizer_path("word_bpe_49k.json"))
    return out.select("doc_id", "lang", "source", "bpe_ids", F.sha2(F.col("bpe_decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", source_mixing),
    ("BPE encoding", bpe_tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each but the last returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = park(docs)
    return docs
