"""The numbered queries of this subpackage; each applies its operator to whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files lie; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assurance.llm.langid import op1

    return op1(table(spark, sf_dir, "documents"))


def op2_lm_bloom_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assurance.llm.ngram_lm import op2

    return op2(table(spark, sf_dir, "documents"))


def op3_bpe_forced_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assurance.llm.bpe import op3

    return op3(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assurance.llm.mixing import op4

    return op4(table(spark, sf_dir, "documents"))


def op5_minhash_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assurance.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op6_licence_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assurance.llm.licences import op6

    return op6(table(spark, sf_dir, "documents"))


def op7_quality_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assurance.llm.quality import op7

    return op7(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_html_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assurance.llm.html_text import op8

    return op8(table(spark, sf_dir, "pages"))


def op9_vectors_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assurance.llm.vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assurance.llm.token_files import read_files, write_files

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_files(write_files(docs, tokenizer_path("byte_bpe_50k.json"), end_id=2))


def op11_cover_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assurance.llm.codebooks import op11

    return op11(table(spark, sf_dir, "embeddings"))


def op12_divergence_skyband(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assurance.llm.divergence import op12

    return op12(table(spark, sf_dir, "documents"))


def op13_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assurance.llm.imatch import op13

    return op13(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_language_kneser_ney, op2_lm_bloom_filter, op3_bpe_forced_boundaries, op4_temperature_mixing, op5_minhash_chosen_path, op6_licence_dice, op7_quality_fertility, op8_html_suffix_array, op9_vectors_cross_polytope, op10_token_files, op11_cover_tree_codes, op12_divergence_skyband, op13_imatch_fingerprints]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from assurance.llm.codebooks import op11_sql
    from assurance.llm.divergence import op12_sql
    from assurance.llm.licences import op6_sql

    return {"op6_licence_dice": op6_sql(), "op11_cover_tree_codes": op11_sql(), "op12_divergence_skyband": op12_sql()}
